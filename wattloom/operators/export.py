"""Per-building documents, curation, search and counts for exploration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import ASSETS
from wattloom.functions import exprs as X
from wattloom.operators import reasons as R

KEY = "gp_nr"


def day_grid(series: DataFrame, days: DataFrame, minutes: int = 15, value: str = "net_kw") -> DataFrame:
    """(gp_nr, day, i, ts, value) for every interval of each building's day: missing is 0, rounded to 3."""
    n = 1440 // minutes
    grid = days.select(KEY, "day", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    grid = grid.withColumn("ts", F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("i") * minutes))
    return grid.join(series.select(KEY, "ts", value), [KEY, "ts"], "left").select(KEY, "day", "i", "ts", F.coalesce(F.round(value, 3), F.lit(0.0)).alias(value))


def day_events(events: DataFrame, days: DataFrame, most: int = 8, lead_hours: int = 6) -> DataFrame:
    """The first events that touch each building's day: begun from 18:00 the evening before, over after midnight."""
    j = events.join(days.select(KEY, "day"), KEY)
    day = F.col("day").cast("timestamp_ntz")
    inside = j.filter((F.col("start") >= day - F.expr(f"INTERVAL {lead_hours} HOURS")) & (F.col("end") > day) & (F.col("start") < day + F.expr("INTERVAL 1 DAY")))
    w = Window.partitionBy(KEY, "day").orderBy("start", "type", "end")
    return inside.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def ground_truth(labels: DataFrame) -> DataFrame:
    """Flags as booleans in a struct that is null where nothing is known."""
    names = [f"label_{a}" for a in ASSETS]
    return labels.select(KEY, F.when(X.any_of([F.col(n).isNotNull() for n in names]), F.struct(*[(F.col(n) == 1).alias(a) for n, a in zip(names, ASSETS, strict=True)])).alias("groundTruth"))


def percents(predictions: DataFrame) -> DataFrame:
    return predictions.select(KEY, *[X.percent(f"prob_{a}").alias(a) for a in ASSETS])


def building_id(key: str | Column, prefix: str = "AG") -> Column:
    return F.concat(F.lit(f"{prefix}-"), X.col(key).cast("string"))


def parse_building_id(text: str | Column, prefix: str = "AG") -> Column:
    return F.nullif(F.regexp_extract(X.col(text), rf"^{prefix}-(\d+)$", 1), F.lit("")).try_cast("bigint")


#: Names of the assets in documents, in their order there, and what documents say of the method.
DOCUMENT_ASSETS = {"pv": "pv", "battery": "battery", "heatpump": "heatPump", "ev": "ev"}
MODEL = "LightGBM gradient-boosted trees, one per asset"
INPUTS = ("15-minute import and export load profiles",)
ADDITIONAL_DATA = ("Open-Meteo hourly weather per postcode",)
METHOD = "SHAP"
METHOD_DESCRIPTION = "SHAP shows which features contributed most to the prediction."
EVENT_KINDS = ("ev_charging", "pv_generation", "heat_pump_heating", "battery_cycle", "high_consumption")


def documents(buildings: DataFrame, predictions: DataFrame, grid: DataFrame, events: DataFrame, truth: DataFrame, featured: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Nested documents: (gp_nr, featured, document: JSON), featured first when written in order.

    predictions: prob_ and, if any, shap_ of each asset; a null probability is 0.  features: the feature table, from
    which reasons are made; a building that it lacks gets one general sentence.  Null fields stay in the JSON.
    """
    iso = X.local_iso
    points = grid.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "ts", "net_kw"))), lambda p: F.struct(iso(p["ts"]).alias("timestamp"), p["net_kw"].alias("powerKw"))).alias("electricity"), F.min("day").alias("profileDate"))
    shown = events.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "start", "end", "confidence"))), lambda e: F.struct(e["type"].alias("type"), iso(e["start"]).alias("start"), iso(e["end"]).alias("end"), F.bround(e["confidence"], 3).alias("confidence"))).alias("events"))
    scores = [F.coalesce(F.col(f"prob_{a}"), F.lit(0.0)).alias(f"_w_prob_{a}") for a in DOCUMENT_ASSETS]
    shap = [(F.col(f"shap_{a}") if f"shap_{a}" in predictions.columns else F.lit(None).cast("array<struct<feature:string,contribution:double>>")).alias(f"_w_shap_{a}") for a in DOCUMENT_ASSETS]
    table = predictions.select(KEY).withColumn("_w_known", F.lit(False)).limit(0) if features is None else features.drop("plz", *[c for c in features.columns if c.startswith("label_")]).withColumn("_w_known", F.lit(True))
    names = [c for c, t in table.dtypes if c not in (KEY, "_w_known") and t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    table = table.select(F.col(KEY), "_w_known", F.struct(*[F.col(c) for c in names], F.lit(0).alias("_w")).alias("_w_f"))
    j = buildings.join(predictions.select(KEY, *scores, *shap), KEY).join(points, KEY, "left").join(shown, KEY, "left").join(truth, KEY, "left").join(table, KEY, "left")
    j = j.join(featured.select(KEY).distinct().withColumn("featured", F.lit(True)), KEY, "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<type:string,start:string,end:string,confidence:double>>")))

    def explained(asset: str) -> Column:
        lines = R.reasons(asset, {n: F.col(f"_w_f.`{n}`") for n in names}, F.col(f"_w_prob_{asset}"), R.has_type(F.col("events"), R.EVENT_TYPES[asset]), F.col("_w_known"))
        return F.struct(lines.alias("reasons"), R.labelled(F.col(f"_w_shap_{asset}")).alias("shap"))

    texts = lambda values: F.array(*[F.lit(v) for v in values])
    explanation = F.struct(
        F.lit(MODEL).alias("model"), texts(INPUTS).alias("inputs"), texts(ADDITIONAL_DATA).alias("additionalData"), F.lit(METHOD).alias("method"), F.lit(METHOD_DESCRIPTION).alias("methodDescription"),
        F.struct(*[explained(a).alias(n) for a, n in DOCUMENT_ASSETS.items()]).alias("assets"),
    )
    doc = F.struct(
        building_id(KEY).alias("id"), F.col("plz").alias("postcode"), F.coalesce("city", "plz").alias("city"), F.coalesce("canton", F.lit("AG")).alias("canton"),
        F.struct(*[X.percent(f"_w_prob_{a}").alias(n) for a, n in DOCUMENT_ASSETS.items()]).alias("predictions"), "electricity", "events", explanation.alias("explanation"),
        F.coalesce("featured", F.lit(False)).alias("featured"), F.col("profileDate").cast("string").alias("profileDate"),
        F.when(F.col("groundTruth").isNotNull(), F.struct(*[F.col(f"groundTruth.{a}").alias(n) for a, n in DOCUMENT_ASSETS.items()])).alias("groundTruth"), F.array().cast("array<string>").alias("history"),
    )
    return j.select(KEY, F.coalesce("featured", F.lit(False)).alias("featured"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


#: The schema that documents must have.
_EXPLAINED = "struct<reasons:array<string>,shap:array<struct<feature:string,contribution:double>>>"
DOCUMENT = (
    "id string, postcode string, city string, canton string, predictions struct<pv:int,battery:int,heatPump:int,ev:int>, electricity array<struct<timestamp:string,powerKw:double>>, "
    "events array<struct<type:string,start:string,end:string,confidence:double>>, explanation struct<model:string,inputs:array<string>,additionalData:array<string>,method:string,methodDescription:string,"
    f"assets:struct<pv:{_EXPLAINED},battery:{_EXPLAINED},heatPump:{_EXPLAINED},ev:{_EXPLAINED}>>, featured boolean, profileDate string, groundTruth struct<pv:boolean,battery:boolean,heatPump:boolean,ev:boolean>, "
    "history array<struct<year:int,predictions:struct<pv:int,battery:int,heatPump:int,ev:int>>>"
)


def document_violations(docs: DataFrame) -> DataFrame:
    """(gp_nr, problem) of documents that miss a field, have one too many on top, a percent outside 0..100, an event of
    an unknown kind or a confidence outside 0..1; text that is no such JSON is a problem too."""
    top = ("id", "postcode", "city", "canton", "predictions", "electricity", "events", "explanation", "featured", "profileDate", "groundTruth", "history")
    d = docs.select(KEY, F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), F.json_object_keys("document").alias("keys"))
    has = lambda c, text: F.when(F.coalesce(c, F.lit(True)), F.lit(text))
    bad = [has(F.col(f"d.{f}").isNull(), f"{f} is missing") for f in ("id", "postcode", "city", "canton", "electricity", "events", "explanation")]
    bad += [has(~F.col(f"d.predictions.{a}").between(0, 100), f"{a} is no percent") for a in DOCUMENT_ASSETS.values()]
    bad += [has(F.size(F.array_except("keys", F.array(*[F.lit(t) for t in top]))) > 0, "unknown field")]
    bad += [has(F.exists("d.events", lambda e: ~e["type"].isin(*EVENT_KINDS)), "unknown kind of event"), has(F.exists("d.events", lambda e: F.coalesce(~e["confidence"].between(0, 1), F.lit(False))), "confidence out of range")]
    return d.select(KEY, F.explode(F.array_compact(F.array(*bad))).alias("problem"))


def pinned(selection: str | None) -> tuple[list[int], list[int]] | None:
    """Featured and other buildings of a selection file's text; None without one."""
    if selection is None:
        return None
    data = json.loads(selection)
    return [int(k) for k in data.get("featured", [])], [int(k) for k in data.get("others", [])]


def selection_text(featured: list[int], others: list[int]) -> str:
    return json.dumps({"featured": featured, "others": others}, indent=1)


def place_label(code: str | Column, name: str | Column) -> Column:
    """Code and name of a place; the bare code where the name is unknown."""
    return F.concat_ws(" ", X.col(code), X.col(name))


def highlighted(areas: DataFrame, hovered: str | None, chosen: str | None, key: str = "plz", count: str = "n") -> DataFrame:
    """Areas with has_buildings, is_active (hovered or chosen) and outlined (hovered and not chosen as well)."""
    active = [x for x in dict.fromkeys([hovered, chosen]) if x is not None]
    k = F.col(key)
    return areas.select("*", (F.col(count) > 0).alias("has_buildings"), k.isin(*active).alias("is_active") if active else F.lit(False).alias("is_active"), (k == hovered if hovered is not None and hovered != chosen else F.lit(False)).alias("outlined"))


def featured_candidates(predictions: DataFrame, labels: DataFrame, n_types: DataFrame, meters: DataFrame, least_types: int = 3, least_assets: int = 2, sure: float = 0.8) -> DataFrame:
    """Labelled single-meter buildings with enough kinds of events and of assets that are surely and rightly
    predicted (``agree``); ranked by that count, then by the sum of all probabilities (``total``)."""
    j = predictions.join(labels, KEY).join(n_types, KEY).join(meters, KEY)
    agree = X.total_of([F.when((F.col(f"prob_{a}") >= sure) & (F.col(f"label_{a}") == 1), 1).otherwise(0) for a in ASSETS])
    out = j.withColumn("agree", agree).withColumn("total", X.total_of([F.col(f"prob_{a}") for a in ASSETS]))
    return out.filter((F.col("num_mp_ids") == 1) & (F.col("n_event_types") >= least_types) & (F.col("agree") >= least_assets))


def round_robin(ranked: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The best of every group, then the second of every group, until ``n`` rows; groups take their turns in the
    order of their best rows, in every turn.  A null group is a group."""
    rows = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    # a group whose best isn't among the first n takes no turn; so the places are those of n rows
    best = rows.filter("turn = 1").orderBy(*order, group).limit(n)
    places = best.withColumn("_w_place", F.row_number().over(Window.orderBy(*order, group))).select(F.col(group).alias("_w_group"), "_w_place")
    return rows.join(places, F.col(group).eqNullSafe(F.col("_w_group"))).orderBy("turn", "_w_place").limit(n).drop("_w_group", "_w_place")


def sample_others(ids: DataFrame, taken: DataFrame, n: int, seed: int = 0, key: str = KEY) -> DataFrame:
    """``n`` keys that aren't taken, in the order of a seeded hash."""
    return ids.select(key).distinct().join(taken.select(key), key, "left_anti").orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def search(df: DataFrame, query: str, cols: list[str]) -> DataFrame:
    """Rows whose columns together hold every token of the query; case and accents don't matter."""
    hay = F.expr("concat_ws(' ', " + ", ".join(f"`{c}`" for c in cols) + ") COLLATE UNICODE_CI_AI")
    for token in query.split():
        df = df.filter(F.contains(hay, F.collate(F.lit(token), "UNICODE_CI_AI")))
    return df


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def with_counts(areas: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    return areas.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bounding_boxes(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    return points.groupBy(key).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def ring_boxes(areas: DataFrame, key: str, rings: str = "coordinates") -> DataFrame:
    """Boxes of array<array<array<double>>> polygons."""
    return bounding_boxes(areas.select(key, F.explode(rings).alias("r")).select(key, F.explode("r").alias("p")).select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), key)


def union_box(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def primary_row(rows: DataFrame, key: str, by: str, cols: list[str]) -> DataFrame:
    """The row of each key with the largest share; ties by the columns."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(by), *[F.col(c) for c in cols])).alias("r")).select(key, "r.*")


def fold_bands(events: DataFrame) -> DataFrame:
    """Events (gp_nr, s, e: minutes, which may leave the day) as bands of the day: what sticks out on one side
    comes in on the other.  An event outside the day has none, one that covers it is the whole day, empty bands go."""
    s, e = F.col("s"), F.col("e")
    covers = (s <= 0) & (e >= 1440)
    band = lambda a, b, when: F.when(when, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    day = F.lit(1440)
    inside = band(F.greatest(s, F.lit(0)), F.least(e, day), F.lit(True))
    parts = F.array_compact(F.array(inside, band(F.lit(0), e - day, ~covers & (e > day)), band(s + day, day, ~covers & (s < 0))))
    cols = [c for c in events.columns if c not in ("s", "e")]
    return events.filter((e > 0) & (s < day)).select(*cols, F.explode(parts).alias("p")).select(*cols, "p.a", "p.b").filter("a < b")


def contribution_bars(shap: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Positive contributions as a share of the largest of their group."""
    return shap.filter(F.col(value) > 0).withColumn("share", F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*group))))


def profile(series: DataFrame, key: int, day: str, minutes: int = 15) -> DataFrame:
    """One building's grid of one day."""
    days = series.filter(F.col(KEY) == key).select(KEY).distinct().withColumn("day", F.lit(day).cast("date"))
    return day_grid(series.filter(F.col(KEY) == key), days, minutes)
