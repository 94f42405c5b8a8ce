"""All queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import DetectorConfig, Thresholds
from wattloom.functions import exprs as X
from wattloom.operators import detectors as D
from wattloom.operators import export, features, ingest, quality, reasons, registry, runs, scoring, weather
from wattloom.plans import adapters as A
from wattloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T60 = Thresholds(interval_minutes=60)
D60 = DetectorConfig(interval_minutes=60, export_kw=2.0, ev_window=8, hp_window=4, hp_run=3, dip_run=3, battery_run=1, battery_kw=2.0, high_run=2, day_rows=24)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[(F.round(c, digits) if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes])


def q(x: str, p: float, where: str = "true") -> str:
    """Nearest-rank quantile in the oracle's SQL."""
    v = f"list_sort(list({x}) FILTER (WHERE ({x}) IS NOT NULL AND ({where})))"
    return f"{v}[CAST(round((count({x}) FILTER (WHERE {where}) - 1) * {p}) AS INTEGER) + 1]"


def corr(a: str, b: str, where: str = "true", least: int = 30) -> str:
    f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND ({where}))"
    return f"CASE WHEN count(*) {f} >= {least} THEN covar_pop({a}, {b}) {f} / nullif(sqrt(var_pop({a}) {f} * var_pop({b}) {f}), 0) END"


def islands(cond: str, source: str = "series", extra: str = "") -> str:
    """Runs of a condition over hourly rows of a building, as CTEs flagged and runs."""
    return f"""flagged AS (SELECT *{extra}, coalesce({cond}, false) AS flag FROM {source}),
starts AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w <> INTERVAL 1 HOUR OR lag(flag) OVER w <> flag THEN 1 ELSE 0 END AS st FROM flagged WINDOW w AS (PARTITION BY gp_nr ORDER BY ts)),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY gp_nr ORDER BY ts) AS run_id FROM starts),
runs AS (SELECT *, count(*) OVER (PARTITION BY gp_nr, run_id) AS run_len FROM numbered)"""


# ---- ingest ----------------------------------------------------------------------------------


@query("""WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v, hour(ts) AS h FROM events GROUP BY 1, 2, 3, 5)
SELECT user_id AS mp_id, event_type, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS ts, v AS value FROM d""")
def unpivot_slots(spark, sf):
    """Wide days with a column for each hour's end, unpivoted again; empty cells go."""
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("mp_id"), "event_type", F.to_date("ts").alias("day"), F.lpad(((F.hour("ts") + 1) % 24).cast("string"), 2, "0").alias("h"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    labels = [f"{h:02d}" for h in range(24)]
    wide = e.groupBy("mp_id", "event_type", "day").pivot("h", labels).agg(F.sum("v"))
    wide = wide.select("mp_id", "event_type", "day", *[F.col(f"`{h}`").alias(f"{h}:00") for h in labels])
    return ingest.unpivot_slots(wide, ["mp_id", "event_type"], "day", 60).filter("value is not null")


@query(f"""WITH {A.READINGS}, m AS (
  SELECT mp_id, gp_nr, date_trunc('hour', ts) AS ts, CAST(sum(cents) FILTER (WHERE channel = 'import') AS BIGINT) AS import_kw,
         coalesce(CAST(sum(cents) FILTER (WHERE channel = 'export') AS BIGINT), 0) AS export_kw FROM readings GROUP BY 1, 2, 3)
SELECT mp_id, gp_nr, ts, import_kw, export_kw, import_kw - export_kw AS net_kw FROM m""")
def pivot_channels_complete(spark, sf):
    r = A.readings(spark, sf).withColumn("ts", F.date_trunc("hour", F.col("ts"))).withColumn("kw", F.col("cents"))
    out = ingest.pivot_channels(r, ["mp_id", "gp_nr", "ts"])
    return out.select("mp_id", "gp_nr", "ts", *[F.col(c).cast("bigint").alias(c) for c in ("import_kw", "export_kw", "net_kw")])


@query(f"""WITH {A.READINGS}, m AS (SELECT mp_id, gp_nr * 100 + mp_id % 97 AS gp_nr, CAST(ts AS DATE) AS ts, CASE WHEN bool_or(channel = 'import') THEN CAST(sum(cents) AS BIGINT) END AS v FROM readings GROUP BY 1, 2, 3),
e AS (SELECT gp_nr * 100 + mp_id % 97 AS gp_nr, count(DISTINCT mp_id) AS n FROM readings GROUP BY 1)
SELECT m.gp_nr, m.ts, CASE WHEN count(*) = max(n) AND count(v) = count(*) THEN CAST(sum(v) AS BIGINT) END AS total, count(DISTINCT CASE WHEN v IS NOT NULL THEN mp_id END) AS num_mp_with_data
FROM m JOIN e ON m.gp_nr = e.gp_nr GROUP BY 1, 2""")
def complete_sums(spark, sf):
    """Building sums that are null unless every meter is there, by day, for small groups of meters."""
    r = A.readings(spark, sf).withColumn("gp_nr", F.col("gp_nr") * 100 + F.col("mp_id") % 97)
    m = r.groupBy("mp_id", "gp_nr", F.to_date("ts").alias("ts")).agg(F.when(F.bool_or(F.col("channel") == "import"), F.sum("cents")).alias("net_kw")).withColumns({"import_kw": F.col("net_kw"), "export_kw": F.col("net_kw")})
    e = r.groupBy("gp_nr").agg(F.count_distinct("mp_id").alias("expected_meters"))
    return ingest.sum_meters(m, e).select("gp_nr", "ts", F.col("net_kw").alias("total"), "num_mp_with_data")


@query(f"""WITH {A.READINGS} SELECT gp_nr, date_trunc('hour', ts) AS ts, CAST(sum(CASE WHEN channel = 'import' THEN cents END) AS BIGINT) AS import_kw, CAST(sum(CASE WHEN channel = 'export' THEN cents END) AS BIGINT) AS export_kw,
CAST(sum(cents) AS BIGINT) AS net_kw, CAST(count(DISTINCT mp_id) FILTER (WHERE mp_id % 2 = 0) + count(DISTINCT mp_id) FILTER (WHERE mp_id % 2 = 1) AS BIGINT) AS num_mp_with_data FROM readings GROUP BY 1, 2""")
def resum_parts(spark, sf):
    """Two overlapping parts of one series, summed up again."""
    r = A.readings(spark, sf).withColumn("ts", F.date_trunc("hour", F.col("ts")))
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("cents")))
    part = lambda k: r.filter(F.col("mp_id") % 2 == k).groupBy("gp_nr", "ts").agg(side("import").alias("import_kw"), side("export").alias("export_kw"), F.sum("cents").alias("net_kw"), F.count_distinct("mp_id").alias("num_mp_with_data"))
    return ingest.resum_parts(part(0).unionByName(part(1)))


@query(f"""WITH {A.SERIES} SELECT gp_nr, ts, net_kw, greatest(net_kw, 0) AS import_kw, greatest(-net_kw, 0) AS export_kw, CASE WHEN net_kw = 0 THEN 'missing' ELSE 'ok' END AS quality
FROM series""")
def layout_and_quality(spark, sf):
    """A single power column split at zero; missing values filled with 0 and marked."""
    s = A.series(spark, sf).select("gp_nr", "ts", F.when(F.col("net_kw") != 0, F.col("net_kw")).alias("power_kw"))
    return ingest.detector_series(ingest.split_layouts(s)).select("gp_nr", "ts", "net_kw", "import_kw", F.abs(F.col("export_kw")).alias("export_kw"), "quality")


# ---- registry and labels ---------------------------------------------------------------------

_CHAIN = "mp AS (SELECT DISTINCT user_id AS mp_id, user_id AS point FROM events), ins AS (SELECT DISTINCT c_custkey AS point, c_nationkey AS gp_nr FROM customer)"


def _points(spark, sf):
    return A.table(spark, sf, "events").select(F.col("user_id").alias("mp_id"), F.col("user_id").alias("point"))


def _installations(spark, sf):
    return A.table(spark, sf, "customer").select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("gp_nr"))


@query(f"WITH {_CHAIN} SELECT mp_id, mp.point, gp_nr FROM mp LEFT JOIN ins ON mp.point = ins.point")
def meter_mapping_resolved(spark, sf):
    return registry.resolve_meters(_points(spark, sf), _installations(spark, sf))


@query("SELECT l_orderkey AS mp_id, count(DISTINCT l_suppkey) AS n_buildings FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def ambiguous_meters(spark, sf):
    return registry.ambiguous(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mp_id"), F.col("l_suppkey").alias("gp_nr")))


@query("SELECT l_orderkey AS mp_id, min(l_suppkey) AS gp_nr FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def unambiguous_meters(spark, sf):
    return registry.unambiguous(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mp_id"), F.col("l_suppkey").alias("gp_nr")))


@query(f"WITH {_CHAIN} SELECT mp_id, point FROM mp WHERE point IN (SELECT o_custkey FROM orders)")
def cohort_semi(spark, sf):
    wanted = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("point"))
    return _points(spark, sf).distinct().join(wanted, "point", "left_semi").select("mp_id", "point")


@query("SELECT DISTINCT user_id AS mp_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def unmapped_anti(spark, sf):
    m = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mp_id"))
    return registry.unmapped(_points(spark, sf), m)


@query(f"WITH {A.FLAGS} SELECT gp_nr, CAST(max(CASE pv WHEN 'x' THEN 1 WHEN '-' THEN 0 END) AS INTEGER) AS label_pv, CAST(max(CASE battery WHEN 'x' THEN 1 WHEN '-' THEN 0 END) AS INTEGER) AS label_battery FROM flags GROUP BY 1")
def labels_three_valued(spark, sf):
    out = registry.fold_labels(A.flags(spark, sf), {"label_pv": "PV", "label_battery": "Batterie"})
    return out.select("gp_nr", *[F.col(c).cast("int").alias(c) for c in ("label_pv", "label_battery")])


@query("""SELECT l_suppkey AS gp_nr, min(CASE WHEN l_returnflag = 'R' THEN coalesce(CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) END, CAST(l_receiptdate AS DATE), CAST(l_commitdate AS DATE)) END) AS commissioned
FROM (SELECT * , CAST(l_shipdate AS DATE) + 10 AS l_receiptdate, CAST(l_shipdate AS DATE) - 5 AS l_commitdate FROM (SELECT l_suppkey, l_returnflag, l_linenumber, l_shipdate FROM lineitem)) GROUP BY 1""")
def first_commission_date(spark, sf):
    """Earliest of each row's first readable date: text dates, some unreadable, over flagged rows."""
    li = A.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    text = lambda c: F.date_format(c, "dd.MM.yyyy")
    rows = li.select(F.col("l_suppkey").alias("gp_nr"), "l_returnflag", F.when(F.col("l_linenumber") % 3 == 0, text("d")).otherwise("unknown").alias("a"), text(F.date_add("d", 10)).alias("b"), text(F.date_sub("d", 5)).alias("c"))
    return registry.first_date(rows, ["a", "b", "c"], F.col("l_returnflag") == "R")


@query(f"""WITH {A.FLAGS}, f AS (SELECT doc_id AS gp_nr, CASE pv WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS label_pv, CASE battery WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS label_battery, CASE WHEN doc_id % 4 = 0 THEN CAST('2025-01-01' AS DATE) WHEN doc_id % 4 = 1 THEN CAST('2025-12-01' AS DATE) END AS d FROM flags),
k AS (SELECT *, CASE WHEN label_pv = 1 AND (d IS NULL OR d <= DATE '2025-07-01') THEN 'p' WHEN label_pv = 0 THEN 'n' WHEN label_pv IS NULL AND label_battery IS NULL THEN 'u' END AS kind FROM f)
SELECT gp_nr, 'pv' AS asset, CASE kind WHEN 'p' THEN 1 ELSE 0 END AS label, CASE kind WHEN 'u' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight, CASE kind WHEN 'u' THEN 'unlabeled' ELSE 'registry' END AS source FROM k WHERE kind IS NOT NULL""")
def training_labels(spark, sf):
    f = A.flags(spark, sf)
    date = F.when(F.col("doc_id") % 4 == 0, F.lit("2025-01-01")).when(F.col("doc_id") % 4 == 1, F.lit("2025-12-01")).cast("date")
    rows = f.select(F.col("doc_id").alias("gp_nr"), X.mark_to_flag("PV").alias("label_pv"), X.mark_to_flag("Batterie").alias("label_battery"), date.alias("commissioned_pv"))
    out = registry.training_labels(rows, "pv", others=["pv", "battery"])
    return out.select("gp_nr", "asset", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), "source")


@query(f"WITH {A.READINGS}, c AS (SELECT mp_id % 20 AS gp_nr, plz, count(*) AS n FROM readings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY n DESC, plz) AS k FROM c) SELECT gp_nr, plz FROM r WHERE k = 1")
def mode_plz(spark, sf):
    """Most frequent place, the smallest on ties."""
    return A.readings(spark, sf).groupBy((F.col("mp_id") % 20).alias("gp_nr")).agg(F.mode("plz", True).alias("plz"))


@query("""SELECT count(*) AS compared, count(*) FILTER (WHERE x = y) AS agree, count(*) FILTER (WHERE x <> y) AS disagree
FROM (SELECT c_custkey AS k, c_nationkey % 5 AS x FROM customer) a JOIN (SELECT s_suppkey AS k, s_nationkey % 5 AS y FROM supplier) b ON a.k = b.k""")
def plz_agreement(spark, sf):
    a = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("v"))
    return registry.agreement(a, A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 5).alias("v")), "k", "v")


@query("""WITH one AS (SELECT DISTINCT user_id AS hop FROM events), two AS (SELECT DISTINCT one.hop, c_nationkey AS k FROM one JOIN customer ON hop = c_custkey), three AS (SELECT * FROM two WHERE k IN (SELECT s_nationkey FROM supplier))
SELECT 'first' AS step, count(*) AS n_rows, count(DISTINCT hop) AS n_keys FROM one UNION ALL SELECT 'second', count(*), count(DISTINCT k) FROM two UNION ALL SELECT 'third', count(*), count(DISTINCT k) FROM three""")
def join_step_counts(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("hop"))
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("hop"), F.col("c_nationkey").alias("k"))
    return registry.hop_counts(e, c, A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "hop", "k")


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(100000 + o_custkey AS VARCHAR) || ' / ' || CAST(100001 + o_custkey AS VARCHAR) WHEN 1 THEN 'GP ' || CAST(100000 + o_custkey AS VARCHAR) || ' (old)' ELSE 'n/a' END AS cell FROM orders),
k AS (SELECT o_orderkey, CAST(unnest(CASE WHEN len(regexp_extract_all(cell, '\\d{6}')) = 0 THEN [NULL] ELSE regexp_extract_all(cell, '\\d{6}') END) AS BIGINT) AS gp FROM c)
SELECT k.o_orderkey, k.gp, c_nationkey FROM k LEFT JOIN customer ON c_custkey = gp - 100000""")
def key_explode_join(spark, sf):
    """Cells with several identifiers, one row each, joined to what they name."""
    o, k = A.table(spark, sf, "orders"), (F.col("o_custkey") + 100000)
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" / ", k.cast("string"), (k + 1).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("GP "), k.cast("string"), F.lit(" (old)"))).otherwise("n/a")
    rows = registry.explode_keys(o.select("o_orderkey", cell.alias("cell")), "cell", 6, "gp")
    return rows.join(A.table(spark, sf, "customer").select((F.col("c_custkey") + 100000).alias("gp"), "c_nationkey"), "gp", "left").select("o_orderkey", "gp", "c_nationkey")


# ---- time, calendar, weather -----------------------------------------------------------------


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) AS INTEGER) AS weekday, isodow(ts) >= 6 AS is_weekend, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day,
CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 16 THEN 'midday' ELSE 'evening' END AS daypart,
CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 16 THEN 'midday' WHEN hour(ts) >= 17 AND hour(ts) < 22 THEN 'evening' ELSE 'other' END AS detector_daypart,
CASE WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (12, 1, 2) THEN 'winter' END AS season FROM events""")
def calendar_flags(spark, sf):
    from wattloom.config import DETECTOR_DAYPARTS

    ts = F.col("ts")
    return A.table(spark, sf, "events").select(
        "event_id", F.hour(ts).alias("hour"), F.month(ts).alias("month"), (F.weekday(ts) + 1).alias("weekday"), (F.weekday(ts) >= 5).alias("is_weekend"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute_of_day"),
        X.daypart("ts").alias("daypart"), X.daypart("ts", DETECTOR_DAYPARTS, "other").alias("detector_daypart"), X.season("ts").alias("season"),
    )


@query("""WITH t AS (SELECT event_id, ts + to_days(CAST((event_id * 7) % 365 AS INTEGER)) AS utc FROM events) SELECT event_id, timezone('Europe/Zurich', timezone('UTC', utc)) AS local_ts FROM t""")
def utc_to_local(spark, sf):
    t = A.table(spark, sf, "events").select("event_id", (F.col("ts") + F.make_dt_interval((F.col("event_id") * 7 % 365).cast("int"))).alias("local_ts"))
    return weather.to_local(t, "local_ts")


_WX = f"WITH {A.SERIES}, {A.WEATHER}, j AS (SELECT s.*, temperature_2m, shortwave_radiation, sunshine_duration FROM series s LEFT JOIN weather w ON s.plz = w.plz AND date_trunc('hour', s.ts) = w.ts)"


def _joined(spark, sf):
    return weather.join_hourly(A.series(spark, sf), A.weather(spark, sf), ["temperature_2m", "shortwave_radiation", "sunshine_duration"])


@query(f"{_WX} SELECT gp_nr, ts, net_kw, round(temperature_2m, 9) AS temperature_2m, round(shortwave_radiation, 9) AS shortwave_radiation FROM j")
def weather_hourly_join(spark, sf):
    return rounded(_joined(spark, sf).select("gp_nr", "ts", "net_kw", "temperature_2m", "shortwave_radiation"))


_BINS = "".join(f", CASE WHEN count(net_kw) FILTER (WHERE {c}) >= 20 THEN round(avg(net_kw) FILTER (WHERE {c}), 9) END AS mean_consumption_T_{n}" for n, c in (("below_minus5", "t < -5"), ("minus5_to_0", "t >= -5 AND t < 0"), ("0_to_5", "t >= 0 AND t < 5"), ("5_to_10", "t >= 5 AND t < 10"), ("10_to_15", "t >= 10 AND t < 15"), ("above_15", "t >= 15")))


@query(f"{_WX} SELECT gp_nr{_BINS} FROM (SELECT *, temperature_2m * 3 - 15 AS t FROM j) GROUP BY 1")
def temperature_bins(spark, sf):
    """Temperatures spread so that all bins have rows."""
    j = _joined(spark, sf).withColumn("temperature_2m", F.col("temperature_2m") * 3 - 15)
    return rounded(features.aggregate(j, features.temperature_means()))


def _sun(group: str) -> str:
    return f"""WITH {A.DAILY}, d AS (SELECT *, CAST(month(day) AS INTEGER) AS month, CAST(year(day) AS INTEGER) AS year FROM daily), b AS (SELECT plz, {group}, {q('daily', 0.25)} AS lo, {q('daily', 0.75)} AS hi FROM d GROUP BY 1, 2)
SELECT d.plz, d.day, d.daily, coalesce(daily >= hi, false) AS is_sunny_day, coalesce(daily <= lo, false) AS is_cloudy_day FROM d JOIN b ON d.plz = b.plz AND d.{group} = b.{group}"""


@query(_sun("month"))
def sun_class_month(spark, sf):
    d = A.daily(spark, sf).withColumn("month", F.month("day"))
    return weather.sun_class(d, ["plz", "month"]).drop("month")


@query(_sun("year"))
def sun_class_year(spark, sf):
    d = A.daily(spark, sf).withColumn("year", F.year("day"))
    return weather.sun_class(d, ["plz", "year"]).drop("year")


@query(f"WITH {A.WEATHER} SELECT plz, ts, round(coalesce(lead(shortwave_radiation) OVER (PARTITION BY plz ORDER BY ts), shortwave_radiation), 9) AS shortwave_radiation FROM weather")
def relabel_lead(spark, sf):
    return rounded(weather.relabel_by_row(A.weather(spark, sf), ["shortwave_radiation"]).select("plz", "ts", "shortwave_radiation"))


@query(f"WITH {A.WEATHER} SELECT a.plz, a.ts, round(b.shortwave_radiation, 9) AS shortwave_radiation FROM weather a LEFT JOIN weather b ON a.plz = b.plz AND b.ts - INTERVAL 1 HOUR = a.ts")
def relabel_time_shift(spark, sf):
    return rounded(weather.relabel_by_time(A.weather(spark, sf), ["shortwave_radiation"]).select("plz", "ts", "shortwave_radiation"))


_GRID = f"WITH {A.WEATHER}, g AS (SELECT plz, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM weather GROUP BY plz), j AS (SELECT g.plz, g.ts, w.temperature_2m AS t, w.shortwave_radiation AS r FROM g LEFT JOIN weather w ON w.plz = g.plz AND w.ts = g.ts)"


@query(f"{_GRID} SELECT plz, ts, round(last_value(r IGNORE NULLS) OVER (PARTITION BY plz ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) AS shortwave_radiation FROM j")
def upsample_ffill(spark, sf):
    return rounded(weather.fill_grid(A.weather(spark, sf), 15, ["shortwave_radiation"]).select("plz", "ts", "shortwave_radiation"))


@query(f"""{_GRID}, k AS (SELECT plz, ts, t, last_value(t IGNORE NULLS) OVER b AS x0, first_value(t IGNORE NULLS) OVER a AS x1, last_value(CASE WHEN t IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN t IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1
FROM j WINDOW b AS (PARTITION BY plz ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY plz ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT plz, ts, round(coalesce(t, x0 + (x1 - x0) * (CAST(epoch(ts) - epoch(t0) AS DOUBLE) / nullif(CAST(epoch(t1) - epoch(t0) AS DOUBLE), 0))), 9) AS temperature_2m FROM k""")
def interpolate_linear(spark, sf):
    return rounded(weather.fill_grid(A.weather(spark, sf), 15, [], ["temperature_2m"]).select("plz", "ts", "temperature_2m"))


@query("""WITH w AS (SELECT user_id % 5 AS plz, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY plz ORDER BY ts) <> INTERVAL 1 HOUR, false) AS gap FROM w)
SELECT plz, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE gap) AS gaps FROM g GROUP BY 1""")
def hour_gap_report(spark, sf):
    return weather.gap_report(A.table(spark, sf, "events").select((F.col("user_id") % 5).alias("plz"), F.date_trunc("hour", F.col("ts")).alias("ts")))


# ---- features --------------------------------------------------------------------------------


@query(f"""WITH {A.SERIES}, {islands('abs(net_kw) <= 0.2')} SELECT gp_nr, round(CAST(count(*) FILTER (WHERE flag) AS DOUBLE) / nullif(count(net_kw), 0), 9) AS near_zero_interval_ratio, count(*) FILTER (WHERE flag AND st = 1 AND run_len >= 2) AS number_of_near_zero_blocks,
round(CAST(count(*) FILTER (WHERE flag AND hour(ts) >= 10 AND hour(ts) < 16) AS DOUBLE) / nullif(count(net_kw) FILTER (WHERE hour(ts) >= 10 AND hour(ts) < 16), 0), 9) AS daytime_near_zero_ratio,
round(CAST(count(*) FILTER (WHERE flag AND hour(ts) >= 16 AND hour(ts) < 22) AS DOUBLE) / nullif(count(net_kw) FILTER (WHERE hour(ts) >= 16 AND hour(ts) < 22), 0), 9) AS evening_near_zero_ratio FROM runs GROUP BY 1""")
def near_zero_blocks(spark, sf):
    return rounded(features.aggregate(features.prepare(A.series(spark, sf), T60), features.near_zero(T60)))


def _count_above(k: int) -> str:
    return f"(WITH {islands(f'net_kw > {k}')} SELECT gp_nr, count(*) FILTER (WHERE flag AND st = 1 AND run_len >= 2) AS n FROM runs GROUP BY 1)"


@query(f"WITH {A.SERIES} SELECT a.gp_nr, a.n AS count_events_above_3kw, b.n AS count_events_above_5kw, c.n AS count_events_above_7kw, d.n AS count_events_above_11kw FROM {_count_above(3)} a JOIN {_count_above(5)} b ON a.gp_nr = b.gp_nr JOIN {_count_above(7)} c ON a.gp_nr = c.gp_nr JOIN {_count_above(11)} d ON a.gp_nr = d.gp_nr")
def event_counts(spark, sf):
    return features.aggregate(features.prepare(A.series(spark, sf), T60), features.events(T60))


_RAMP = f"WITH {A.SERIES}, r AS (SELECT *, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN net_kw - lag(net_kw) OVER w END AS ramp FROM series WINDOW w AS (PARTITION BY gp_nr ORDER BY ts))"


@query(f"""{_RAMP} SELECT gp_nr, round(max(ramp) FILTER (WHERE ramp > 0), 9) AS max_positive_ramp, round(min(ramp) FILTER (WHERE ramp < 0), 9) AS max_negative_ramp, round({q('ramp', 0.95, 'ramp > 0')}, 9) AS p95_positive_ramp, round({q('ramp', 0.99, 'ramp > 0')}, 9) AS p99_positive_ramp,
round({q('-ramp', 0.95, 'ramp < 0')}, 9) AS p95_negative_ramp, round({q('-ramp', 0.99, 'ramp < 0')}, 9) AS p99_negative_ramp FROM r GROUP BY 1""")
def ramp_stats(spark, sf):
    p = A.series(spark, sf).withColumn("ramp", runs.ramp("net_kw", ["gp_nr"], "ts", 60))
    return rounded(features.aggregate(p, {k: v for k, v in features.distribution().items() if "ramp" in k}))


@query(f"WITH {A.SERIES} SELECT gp_nr, round(median(net_kw), 9) AS median_consumption, {q('net_kw', 0.95)} AS p95_consumption, {q('net_kw', 0.99)} AS p99_consumption, max(net_kw) AS max_consumption FROM series GROUP BY 1")
def power_distribution(spark, sf):
    p = A.series(spark, sf).withColumn("ramp", F.lit(0.0))
    return rounded(features.aggregate(p, {k: v for k, v in features.distribution().items() if "ramp" not in k}))


def _mean(name: str, where: str) -> str:
    return f"round(avg(net_kw) FILTER (WHERE {where}), 9) AS {name}"


_MID, _NIGHT = "hour(ts) >= 10 AND hour(ts) < 16", "(hour(ts) >= 22 OR hour(ts) < 6)"
_SUM, _WIN = "month(ts) IN (6, 7, 8)", "month(ts) IN (12, 1, 2)"


@query(f"""WITH {A.SERIES} SELECT gp_nr, {_mean('daytime_mean_power', _MID)}, {_mean('morning_mean_power', 'hour(ts) >= 6 AND hour(ts) < 10')}, {_mean('evening_mean_power', 'hour(ts) >= 16 AND hour(ts) < 22')}, {_mean('summer_midday_mean', _MID + ' AND ' + _SUM)}, {_mean('winter_midday_mean', _MID + ' AND ' + _WIN)},
round(avg(net_kw) FILTER (WHERE {_MID} AND {_WIN}) - avg(net_kw) FILTER (WHERE {_MID} AND {_SUM}), 9) AS summer_vs_winter_midday_diff, {_mean('winter_night_mean_consumption', _NIGHT + ' AND ' + _WIN)}, {_mean('summer_night_mean_consumption', _NIGHT + ' AND ' + _SUM)} FROM series GROUP BY 1""")
def daypart_means(spark, sf):
    from wattloom.config import FEATURE_DAYPARTS

    s = A.series(spark, sf)
    s = s.withColumns({f"is_{k}": X.in_hours(F.hour("ts"), w) for k, w in FEATURE_DAYPARTS.items()} | {"season": X.season("ts")})
    return rounded(features.aggregate(s, features.daypart_means()))


@query(f"""WITH {A.SERIES} SELECT gp_nr, round(CAST(count(*) FILTER (WHERE net_kw < -0.2) AS DOUBLE) / nullif(count(net_kw), 0), 9) AS negative_consumption_ratio, round(CAST(count(*) FILTER (WHERE net_kw < -0.2 AND {_MID}) AS DOUBLE) / nullif(count(net_kw) FILTER (WHERE {_MID}), 0), 9) AS negative_daytime_consumption_ratio,
round(coalesce(sum(-net_kw) FILTER (WHERE net_kw < 0), 0), 9) AS total_export_kwh FROM series GROUP BY 1""")
def negative_ratios(spark, sf):
    s = A.series(spark, sf).withColumn("is_midday", X.in_hours(F.hour("ts"), (10, 16)))
    return rounded(features.aggregate(s, features.negative(T60)))


@query(f"""{_WX} SELECT gp_nr, round(median(net_kw / shortwave_radiation) FILTER (WHERE shortwave_radiation >= 100), 9) AS consumption_per_unit_solar_radiation, round({corr('net_kw', 'shortwave_radiation', 'shortwave_radiation >= 100')}, 9) AS correlation_solar_radiation_consumption,
round({corr('net_kw', 'sunshine_duration')}, 9) AS correlation_sunshine_duration_consumption, round({corr('net_kw', 'temperature_2m')}, 9) AS correlation_outside_temperature_consumption FROM j GROUP BY 1""")
def solar_correlation(spark, sf):
    return rounded(features.aggregate(_joined(spark, sf), features.solar()))


@query(f"""WITH {A.SERIES}, d AS (SELECT gp_nr, CAST(ts AS DATE) AS day, count(net_kw) AS n, bool_or(net_kw < -0.2) AS x FROM series GROUP BY 1, 2) SELECT gp_nr, round(CAST(count(*) FILTER (WHERE x) AS DOUBLE) / count(*), 9) AS days_with_export_ratio, CAST(count(*) FILTER (WHERE n >= 20) AS INTEGER) AS n_valid_days FROM d WHERE n > 0 GROUP BY 1""")
def export_day_ratio(spark, sf):
    return rounded(features.day_features(A.series(spark, sf), T60, 20))


@query(f"""WITH {A.SERIES}, d AS (SELECT plz, CAST(ts AS DATE) AS day, sum(import_kw) AS x FROM series GROUP BY 1, 2), b AS (SELECT plz, {q('round(x, 9)', 0.25)} AS lo, {q('round(x, 9)', 0.75)} AS hi FROM d GROUP BY 1)
SELECT gp_nr, round(avg(net_kw) FILTER (WHERE {_MID} AND round(x, 9) >= hi), 9) AS sunny_day_midday_mean, round(avg(net_kw) FILTER (WHERE {_MID} AND round(x, 9) <= lo), 9) AS cloudy_day_midday_mean FROM series s JOIN d ON s.plz = d.plz AND CAST(s.ts AS DATE) = d.day JOIN b ON b.plz = d.plz GROUP BY 1""")
def sunny_midday_means(spark, sf):
    s = A.series(spark, sf)
    days = weather.daily_sum(s, "import_kw").withColumn("daily", F.round("daily", 9))
    j = weather.join_days(s, weather.sun_class(days, ["plz"])).withColumn("is_midday", X.in_hours(F.hour("ts"), (10, 16)))
    return rounded(features.aggregate(j, features.sunny_means()))


_SESS = f"""WITH {A.SERIES}, {islands('net_kw >= 3')}, sess AS (SELECT gp_nr, min(ts) AS start_timestamp, max(ts) + INTERVAL 1 HOUR AS end_timestamp, avg(net_kw) AS mean_power, median(net_kw) AS median_power, stddev_samp(net_kw) AS std_power, var_samp(net_kw) AS variance_power, sum(net_kw) AS energy_kwh,
CAST(count(*) * 60 AS BIGINT) AS duration_minutes, stddev_samp(net_kw) / nullif(avg(net_kw), 0) AS cv_power FROM runs WHERE flag AND run_len >= 2 GROUP BY gp_nr, run_id)"""


@query(f"{_SESS} SELECT gp_nr, start_timestamp, end_timestamp, round(mean_power, 9) AS mean_power, round(median_power, 9) AS median_power, round(std_power, 9) AS std_power, round(variance_power, 9) AS variance_power, round(energy_kwh, 9) AS energy_kwh, duration_minutes, round(cv_power, 9) AS cv_power FROM sess")
def sessions(spark, sf):
    return rounded(features.sessions(A.series(spark, sf), T60))


def _share(name: str, c: str, a: int, b: int) -> str:
    h = f"hour({c}_timestamp)"
    inside = f"{h} >= {a} AND {h} < {b}" if a < b else f"({h} >= {a} OR {h} < {b})"
    return f"round(CAST(count(*) FILTER (WHERE {inside}) AS DOUBLE) / count(*), 9) AS {name}"


_SHARES = ", ".join(_share(f"{w}_{k}_ratio", c, a, b) for w, (a, b) in (("night", (22, 6)), ("morning", (6, 10)), ("midday", (10, 16)), ("evening", (16, 22))) for k, c in (("start", "start"), ("finish", "end")))


@query(f"""{_SESS}, f AS (SELECT gp_nr, count(*) AS session_count, round(avg(mean_power), 9) AS session_mean, round(median(mean_power), 9) AS session_median, round(stddev_samp(mean_power), 9) AS session_std, round(var_samp(mean_power), 9) AS session_variance, round(stddev_samp(mean_power) / nullif(avg(mean_power), 0), 9) AS session_cv, {_SHARES} FROM sess GROUP BY 1),
sp AS (SELECT gp_nr, (epoch(max(ts)) - epoch(min(ts))) / 604800.0 AS weeks FROM series GROUP BY 1)
SELECT sp.gp_nr, f.* EXCLUDE (gp_nr, session_count), coalesce(session_count, 0) AS session_count, CASE WHEN session_count IS NULL THEN CAST(0 AS DOUBLE) ELSE round(session_count / nullif(weeks, 0), 9) END AS sessions_per_week FROM sp LEFT JOIN f ON sp.gp_nr = f.gp_nr""")
def session_features(spark, sf):
    s = A.series(spark, sf)
    return rounded(features.session_features(features.sessions(s, T60), features.spans(s)))


@query(f"WITH {A.SERIES} SELECT gp_nr, " + ", ".join(f"round(CAST(count(*) FILTER (WHERE net_kw >= 3 AND {c}) AS DOUBLE) / nullif(count(*) FILTER (WHERE net_kw >= 3), 0), 9) AS {n}_high_load_ratio" for n, c in (("night", _NIGHT), ("morning", "hour(ts) >= 6 AND hour(ts) < 10"), ("midday", _MID), ("evening", "hour(ts) >= 16 AND hour(ts) < 22"))) + " FROM series GROUP BY 1")
def high_load_ratios(spark, sf):
    from wattloom.config import FEATURE_DAYPARTS

    s = A.series(spark, sf)
    return rounded(features.aggregate(s.withColumns({f"is_{k}": X.in_hours(F.hour("ts"), w) for k, w in FEATURE_DAYPARTS.items()}), features.high_load(T60)))


def _whole() -> str:
    """Cohort, the parts' own SQL, and labels, joined by building."""
    bins = _BINS.replace("t < ", "temperature_2m < ").replace("t >= ", "temperature_2m >= ")
    sun = f"""{_WX}, d AS (SELECT plz, CAST(ts AS DATE) AS day, sum(shortwave_radiation) AS x FROM weather GROUP BY 1, 2), b AS (SELECT plz, {q('x', 0.25)} AS lo, {q('x', 0.75)} AS hi FROM d GROUP BY 1), c AS (SELECT d.plz, day, x >= hi AS sunny, x <= lo AS cloudy FROM d JOIN b ON d.plz = b.plz)
SELECT gp_nr, round(avg(net_kw) FILTER (WHERE {_MID} AND sunny), 9) AS sunny_day_midday_mean, round(avg(net_kw) FILTER (WHERE {_MID} AND cloudy), 9) AS cloudy_day_midday_mean FROM j LEFT JOIN c ON j.plz = c.plz AND CAST(ts AS DATE) = c.day GROUP BY 1"""
    names = ("near_zero_blocks", "daypart_means", "negative_ratios", "solar_correlation", "event_counts", "power_distribution", "ramp_stats", "high_load_ratios", "export_day_ratio", "session_features")
    parts = [ORACLES[n] for n in names] + [sun, f"{_WX} SELECT gp_nr{bins} FROM j GROUP BY 1"]
    labels = ORACLES["labels_three_valued"]
    joins = " ".join(f"LEFT JOIN ({sql}) AS p{i} USING (gp_nr)" for i, sql in enumerate(parts))
    return f"SELECT * FROM (WITH {A.SERIES} SELECT gp_nr, min(plz) AS plz FROM series GROUP BY 1) AS c {joins} LEFT JOIN (SELECT * REPLACE (gp_nr + 100000 AS gp_nr) FROM ({labels})) AS l USING (gp_nr)"


@query(_whole())
def feature_table(spark, sf):
    """The whole table: cohort, all features, labels."""
    s = weather.join_days(_joined(spark, sf), weather.sun_class(weather.daily_sum(A.weather(spark, sf), "shortwave_radiation"), ["plz"]))
    cohort = s.groupBy("gp_nr").agg(F.mode("plz", True).alias("plz"))
    labels = registry.fold_labels(A.flags(spark, sf).withColumn("gp_nr", F.col("gp_nr") + 100000), {"label_pv": "PV", "label_battery": "Batterie"})
    return rounded(features.feature_table(s.drop("plz"), cohort, labels, T60, 20))


# ---- runs and detectors ----------------------------------------------------------------------


@query(f"WITH {A.SERIES} SELECT gp_nr, ts, round(median(import_kw) OVER (PARTITION BY gp_nr ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING), 9) AS med FROM series")
def rolling_median(spark, sf):
    return rounded(A.series(spark, sf).select("gp_nr", "ts", runs.rolling_median("import_kw", ["gp_nr"], "ts", 32).alias("med")))


def _index_runs(cond: str, source: str, name: str = "ir", keys: str = "gp_nr") -> str:
    return f"{name} AS (SELECT {keys}, min(i) AS s, max(i) + 1 AS e, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS g FROM {source} WHERE {cond}) GROUP BY {keys}, g)"


def _merged(gap: int) -> str:
    return f"mg AS (SELECT gp_nr, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY gp_nr ORDER BY s) AS g FROM (SELECT *, CASE WHEN coalesce(s - lag(e) OVER (PARTITION BY gp_nr ORDER BY s) > {gap}, true) THEN 1 ELSE 0 END AS nw FROM ir)) GROUP BY gp_nr, g)"


_IDX = f"WITH {A.SERIES}, x AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY ts) - 1 AS i FROM series)"


@query(f"{_IDX}, {_index_runs('net_kw >= 3', 'x')}, {_merged(2)} SELECT gp_nr, s, e FROM mg")
def merge_runs(spark, sf):
    s = runs.with_index(A.series(spark, sf), ["gp_nr"], "ts")
    return runs.merge_runs(runs.index_runs(s, F.col("net_kw") >= 3, ["gp_nr"], "i"), ["gp_nr"], 2)


def _wide_events(spark, sf):
    s = _joined(spark, sf).withColumn("quality", F.when(F.col("import_kw") > 0, "ok").otherwise("missing"))
    days = A.series(spark, sf).groupBy("plz", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(days.select("plz", "day", (F.pmod(F.dayofyear("day"), F.lit(3)) != 0).alias("is_sunny_day")), (s["plz"] == days["plz"]) & (F.to_date("ts") == F.col("day"))).select(s["gp_nr"], s["plz"], "ts", "import_kw", "export_kw", "net_kw", "temperature_2m", "shortwave_radiation", "quality", "is_sunny_day")


_EV = f"""{_WX}, ev AS (SELECT *, CASE WHEN import_kw > 0 THEN 'ok' ELSE 'missing' END AS quality, dayofyear(ts) % 3 <> 0 AS is_sunny_day, CAST(ts AS DATE) AS day FROM j)"""


def _events_out(df: DataFrame) -> DataFrame:
    return rounded(df, 5)


_EVC = f"""{_EV}, xr AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY ts) - 1 AS i, import_kw - median(import_kw) OVER (PARTITION BY gp_nr ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS resid FROM ev), {_index_runs('resid >= 2.5', 'xr')}, {_merged(2)},
st AS (SELECT m.gp_nr, m.s, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", median(resid) AS pk, stddev_pop(resid) AS sd, sum(resid) AS en FROM mg m JOIN xr ON xr.gp_nr = m.gp_nr AND i >= m.s AND i < m.e WHERE m.e - m.s >= 3 GROUP BY m.gp_nr, m.s),
evc AS (SELECT gp_nr, 'ev_charging' AS type, "start", "end", greatest(0, least(1, 0.5 * (1 - cv / 0.25) + 0.5 * (1 - least(1, least(abs(pk - 3.7) / 3.7, abs(pk - 7) / 7.0, abs(pk - 11) / 11.0))))) AS confidence, pk AS peak_kw, en AS energy_kwh FROM (SELECT *, CASE WHEN pk > 0 THEN sd / pk ELSE 9 END AS cv FROM st) WHERE cv <= 0.25)"""
_PICK = 'SELECT gp_nr, type, "start", "end", round(CAST(confidence AS DOUBLE), 5) AS confidence, round(peak_kw, 5) AS peak_kw, round(CAST(energy_kwh AS DOUBLE), 5) AS energy_kwh FROM'


@query(f"{_EVC} {_PICK} evc")
def ev_sessions(spark, sf):
    return _events_out(D.ev_charging(_wide_events(spark, sf), D60))


_PVX = """pvx AS (SELECT gp_nr, 'pv_generation' AS type, min(ts) FILTER (WHERE export_kw > 2) AS "start", max(ts) FILTER (WHERE export_kw > 2) + INTERVAL 1 HOUR AS "end",
CASE WHEN count(shortwave_radiation) > 0 AND coalesce(covar_pop(export_kw, coalesce(shortwave_radiation, 0)) / nullif(sqrt(var_pop(export_kw) * var_pop(coalesce(shortwave_radiation, 0))), 0), 0) > 0.5 THEN 0.9 ELSE 0.7 END AS confidence,
max(export_kw) AS peak_kw, sum(export_kw) FILTER (WHERE export_kw > 2) AS energy_kwh FROM ev GROUP BY gp_nr, day HAVING max(export_kw) > 2)"""


@query(f"{_EV}, {_PVX} {_PICK} pvx")
def pv_export_days(spark, sf):
    return _events_out(D.pv_export_days(_wide_events(spark, sf), D60))


_NB = "nb AS (SELECT gp_nr, coalesce(median(import_kw) FILTER (WHERE hour(ts) < 6 AND quality = 'ok'), 0) AS baseline FROM ev GROUP BY 1)"


@query(f"{_EV}, {_NB} SELECT gp_nr, round(baseline, 9) AS baseline FROM nb")
def night_baseline(spark, sf):
    return rounded(D.night_baseline(_wide_events(spark, sf)))


def _dip(top: float = 2, share: float = 0.5) -> str:
    return f"""{_NB}, qt AS (SELECT e.*, baseline FROM (SELECT *, max(export_kw) OVER (PARTITION BY gp_nr, day) AS top FROM ev) e JOIN nb ON nb.gp_nr = e.gp_nr WHERE is_sunny_day AND top <= {top}), qh AS (SELECT *, row_number() OVER (PARTITION BY gp_nr, day ORDER BY ts) - 1 AS i FROM qt WHERE hour(ts) >= 9 AND hour(ts) < 17),
{_index_runs(f'net_kw < baseline * {share}', 'qh', 'dr', 'gp_nr, day')}, db AS (SELECT *, row_number() OVER (PARTITION BY gp_nr, day ORDER BY n DESC, s) AS r FROM dr WHERE n >= 3),
dip AS (SELECT q.gp_nr, 'pv_generation' AS type, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", 0.5 AS confidence, -min(net_kw) AS peak_kw, sum(greatest(baseline - net_kw, 0)) AS energy_kwh FROM qh q JOIN db ON q.gp_nr = db.gp_nr AND q.day = db.day AND i >= s AND i < e WHERE r = 1 GROUP BY q.gp_nr, q.day)"""


_DIP = _dip()


@query(f"{_EV}, {_dip(1000)} {_PICK} dip")
def pv_dip_windows(spark, sf):
    """With a bound on export above what these buildings give back, so that there are days to look at."""
    return _events_out(D.pv_dip_windows(_wide_events(spark, sf), replace(D60, export_kw=1000.0)))


_HP = f"""hb AS (SELECT gp_nr, coalesce(median(import_kw) FILTER (WHERE hour(ts) < 6 AND {_SUM}), {q('import_kw', 0.1, 'hour(ts) < 6')}, 0) AS base, {corr('temperature_2m', 'import_kw', _WIN, 2)} AS r FROM ev GROUP BY 1),
hw AS (SELECT ev.*, base, r, row_number() OVER (PARTITION BY ev.gp_nr, day ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY ev.gp_nr, day) AS rws, import_kw - base >= 0.8 AS ison FROM ev JOIN hb ON hb.gp_nr = ev.gp_nr WHERE {_WIN}),
hs AS (SELECT *, CASE WHEN lag(ison) OVER (PARTITION BY gp_nr, day ORDER BY i) <> ison THEN 1 ELSE 0 END AS sw FROM hw), hn AS (SELECT *, sum(sw) OVER (PARTITION BY gp_nr, day ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS sws FROM hs),
{_index_runs('ison', 'hn', 'hr', 'gp_nr, day')}, he AS (SELECT hr.gp_nr, hr.day, max(hr.n) AS early FROM hr JOIN hn a ON a.gp_nr = hr.gp_nr AND a.day = hr.day AND a.i = hr.s JOIN hn b ON b.gp_nr = hr.gp_nr AND b.day = hr.day AND b.i = hr.e - 1 WHERE hour(a.ts) >= 4 AND hour(b.ts) < 10 GROUP BY 1, 2),
hd AS (SELECT gp_nr, day, max(sws) FILTER (WHERE i >= 4 OR rws <= 4) AS most, min(ts) FILTER (WHERE ison) AS "start", max(ts) FILTER (WHERE ison) + INTERVAL 1 HOUR AS "end", max(import_kw) FILTER (WHERE ison) AS peak_kw, sum(import_kw - base) FILTER (WHERE ison) AS energy_kwh, max(r) AS r FROM hn GROUP BY 1, 2),
hp AS (SELECT hd.gp_nr, 'heat_pump_heating' AS type, "start", "end", coalesce(greatest(0.3, least(0.9, -r)), 0.5) AS confidence, peak_kw, energy_kwh FROM hd LEFT JOIN he ON he.gp_nr = hd.gp_nr AND he.day = hd.day WHERE "start" IS NOT NULL AND (most >= 3 OR coalesce(early, 0) >= 3))"""


@query(f"{_EV}, {_HP} {_PICK} hp")
def hp_heating_days(spark, sf):
    return _events_out(D.heating_days(_wide_events(spark, sf), D60))


_BAT = f"""bi AS (SELECT *, coalesce(shortwave_radiation, 0) AS rad, row_number() OVER (PARTITION BY gp_nr, day ORDER BY ts) - 1 AS i, max(export_kw) OVER (PARTITION BY gp_nr, day) AS top FROM ev), bp AS (SELECT gp_nr, day, i AS peak_i FROM (SELECT *, row_number() OVER (PARTITION BY gp_nr, day ORDER BY rad DESC, i) AS k FROM bi) WHERE k = 1),
bx AS (SELECT bi.*, peak_i FROM bi JOIN bp ON bp.gp_nr = bi.gp_nr AND bp.day = bi.day WHERE is_sunny_day AND top > 2), {_index_runs('abs(net_kw) < 2 AND i < peak_i AND rad > 50', 'bx', 'bc', 'gp_nr, day')}, {_index_runs('abs(net_kw) < 2 AND hour(ts) >= 17 AND hour(ts) < 23', 'bx', 'bd', 'gp_nr, day')},
bu AS (SELECT *, 'charging' AS kind FROM bc UNION ALL SELECT *, 'discharging' AS kind FROM bd), bb AS (SELECT *, min(kind) OVER (PARTITION BY gp_nr, day) <> max(kind) OVER (PARTITION BY gp_nr, day) AS both_kinds FROM bu),
bat AS (SELECT bb.gp_nr, 'battery_cycle' AS type, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", max(CASE WHEN both_kinds THEN 0.8 ELSE 0.6 END) AS confidence, max(abs(net_kw)) AS peak_kw, sum(abs(net_kw)) AS energy_kwh FROM bb JOIN bx ON bx.gp_nr = bb.gp_nr AND bx.day = bb.day AND bx.i >= s AND bx.i < e GROUP BY bb.gp_nr, bb.day, kind, s)"""


@query(f"{_EV}, {_BAT} {_PICK} bat")
def battery_cycles(spark, sf):
    return _events_out(D.battery_cycles(_wide_events(spark, sf), D60))


_HL = f"""hx AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY ts) - 1 AS i FROM ev), hbn AS (SELECT gp_nr, day, {q('import_kw', 0.95)} AS bound FROM hx GROUP BY 1, 2), hit AS (SELECT hx.*, i - row_number() OVER (PARTITION BY hx.gp_nr ORDER BY i) AS g FROM hx JOIN hbn ON hbn.gp_nr = hx.gp_nr AND hbn.day = hx.day WHERE import_kw >= bound),
hl AS (SELECT gp_nr, g, count(*) AS n, min(day) AS day, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", max(import_kw) AS peak_kw, sum(import_kw) AS energy_kwh FROM hit GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) < 24)"""


@query(f'{_EV}, {_HL} SELECT gp_nr, n, day, "start", "end", round(peak_kw, 9) AS peak_kw, round(energy_kwh, 9) AS energy_kwh FROM hl')
def high_load_band(spark, sf):
    return rounded(D.high_load_runs(_wide_events(spark, sf), D60))


@query(f"""{_EV}, {_HL}, c AS (SELECT gp_nr, "start", "end" FROM (SELECT gp_nr, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end" FROM ev WHERE hour(ts) >= 12 AND hour(ts) < 18 GROUP BY gp_nr, day))
SELECT gp_nr, "start", "end" FROM hl WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.gp_nr = hl.gp_nr AND hl."start" < c."end" AND hl."end" > c."start")""")
def overlap_anti(spark, sf):
    s = _wide_events(spark, sf)
    afternoon = s.filter(X.in_hours(F.hour("ts"), (12, 18))).groupBy("gp_nr", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))
    return D.not_overlapping(D.high_load_runs(s, D60), afternoon).select("gp_nr", "start", "end")


_ALL = f"{_EVC}, {_PVX}, {_DIP}, {_HP}, {_BAT}, {_HL}, cl AS (SELECT * FROM evc UNION ALL SELECT * FROM pvx UNION ALL SELECT * FROM dip UNION ALL SELECT * FROM hp UNION ALL SELECT * FROM bat)" + """,
fr AS (SELECT *, row_number() OVER (PARTITION BY gp_nr, day ORDER BY n DESC, "start") AS r FROM hl WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.gp_nr = hl.gp_nr AND hl."start" < cl."end" AND hl."end" > cl."start")),
allev AS (SELECT * FROM cl UNION ALL SELECT gp_nr, 'high_consumption', "start", "end", 0.5, peak_kw, energy_kwh FROM fr WHERE r = 1)"""


@query(f"{_ALL} {_PICK} allev")
def all_events(spark, sf):
    """Five detectors and the fallback on what they leave."""
    return _events_out(D.detect(_wide_events(spark, sf), D60))


@query(f"""{_EV}, {_PVX}, d AS (SELECT gp_nr, CAST("start" AS DATE) AS day, count(DISTINCT type) AS types, round(sum(CAST(confidence AS DOUBLE)), 9) AS sure FROM pvx WHERE confidence >= 0.6 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY types DESC, sure DESC, day DESC) AS k FROM d)
SELECT gp_nr, day AS showcase_date, CAST(types AS INTEGER) AS n_event_types FROM r WHERE k = 1""")
def showcase_day(spark, sf):
    return D.showcase_day(D.pv_export_days(_wide_events(spark, sf), D60), D60)


@query(f"{_EV} SELECT gp_nr, coalesce(max(day) FILTER (WHERE n >= 20), max(day)) AS day FROM (SELECT gp_nr, day, count(*) FILTER (WHERE quality = 'ok') AS n FROM ev GROUP BY 1, 2) GROUP BY 1")
def last_full_day(spark, sf):
    from dataclasses import replace

    return D.last_full_day(_wide_events(spark, sf), replace(D60, day_rows=20))


# ---- export, curation, search ----------------------------------------------------------------

_DAY = "CAST('2024-01-10' AS DATE)"


def _days(spark, sf):
    return A.series(spark, sf).select("gp_nr").distinct().withColumn("day", F.lit("2024-01-10").cast("date"))


@query(f"""WITH {A.SERIES}, g AS (SELECT gp_nr, i, CAST({_DAY} AS TIMESTAMP) + to_minutes(CAST(i * 15 AS INTEGER)) AS ts FROM (SELECT DISTINCT gp_nr FROM series), range(96) t(i))
SELECT g.gp_nr, {_DAY} AS day, CAST(i AS INTEGER) AS i, g.ts, coalesce(round(net_kw, 3), 0) AS net_kw FROM g LEFT JOIN series s ON s.gp_nr = g.gp_nr AND s.ts = g.ts""")
def day_grid_96(spark, sf):
    return export.day_grid(A.series(spark, sf), _days(spark, sf))


@query(f"""{_SESS}, r AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY start_timestamp, end_timestamp) AS k FROM sess WHERE start_timestamp >= CAST({_DAY} AS TIMESTAMP) - INTERVAL 6 HOUR AND end_timestamp > CAST({_DAY} AS TIMESTAMP) AND start_timestamp < CAST({_DAY} AS TIMESTAMP) + INTERVAL 1 DAY)
SELECT gp_nr, CAST(k AS INTEGER) AS rank, start_timestamp AS "start", end_timestamp AS "end" FROM r WHERE k <= 8""")
def event_window_top8(spark, sf):
    ev = features.sessions(A.series(spark, sf), T60).select("gp_nr", F.lit("session").alias("type"), F.col("start_timestamp").alias("start"), F.col("end_timestamp").alias("end"))
    return export.day_events(ev, _days(spark, sf)).select("gp_nr", "rank", "start", "end")


@query(f"""WITH {A.FLAGS}, f AS (SELECT doc_id AS gp_nr, CASE pv WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS a, CASE battery WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS b FROM flags) SELECT gp_nr, a IS NOT NULL OR b IS NOT NULL AS known, a = 1 AS pv, b = 1 AS battery FROM f""")
def ground_truth_struct(spark, sf):
    f = A.flags(spark, sf).select(F.col("doc_id").alias("gp_nr"), X.mark_to_flag("PV").alias("label_pv"), X.mark_to_flag("Batterie").alias("label_battery"), F.lit(None).cast("tinyint").alias("label_ev"), F.lit(None).cast("tinyint").alias("label_heatpump"))
    g = export.ground_truth(f)
    return g.select("gp_nr", F.col("groundTruth").isNotNull().alias("known"), F.col("groundTruth.pv").alias("pv"), F.col("groundTruth.battery").alias("battery"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(greatest(least(l_discount * 10 + 0.005, 1), 0) * 100, 0) AS INTEGER) AS pct FROM lineitem")
def percent_probs(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.percent(F.col("l_discount") * 10 + 0.005).alias("pct"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN round(l_discount * 1000) >= 80 THEN 'Likely' WHEN round(l_discount * 1000) >= 50 THEN 'Possible' ELSE 'Unlikely' END AS label FROM lineitem""")
def prediction_labels(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.confidence_label(F.round(F.col("l_discount") * 1000)).alias("label"))


@query("""WITH r AS (SELECT s_suppkey AS gp_nr, s_nationkey AS plz, CAST(round(s_acctbal * 100) AS BIGINT) AS score FROM supplier), t AS (SELECT *, row_number() OVER (PARTITION BY plz ORDER BY score DESC, gp_nr) AS turn FROM r)
, g AS (SELECT plz AS p, row_number() OVER (ORDER BY score DESC, gp_nr) AS place FROM t WHERE turn = 1)
SELECT gp_nr, plz, score, CAST(turn AS INTEGER) AS turn FROM t JOIN g ON p = plz ORDER BY turn, place LIMIT 30""")
def featured_round_robin(spark, sf):
    r = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gp_nr"), F.col("s_nationkey").alias("plz"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("score"))
    return export.round_robin(r, "plz", [F.desc("score"), F.col("gp_nr")], 30)


@query("SELECT page_id FROM pages WHERE strip_accents(lower(url || ' ' || html)) LIKE '%the%' AND strip_accents(lower(url || ' ' || html)) LIKE '%ing%'")
def search_tokens(spark, sf):
    return export.search(A.table(spark, sf, "pages"), "THE Íng", ["url", "html"]).select("page_id")


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def counts_by_plz(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return export.with_counts(A.table(spark, sf, "nation").select("n_nationkey", "n_name"), export.count_by(c, "n_nationkey"), "n_nationkey")


@query("SELECT label, CAST(min(embedding[1]) AS DOUBLE) AS west, CAST(min(embedding[2]) AS DOUBLE) AS south, CAST(max(embedding[1]) AS DOUBLE) AS east, CAST(max(embedding[2]) AS DOUBLE) AS north FROM embeddings GROUP BY 1")
def bbox(spark, sf):
    rings = A.table(spark, sf, "embeddings").select("label", F.array(F.array(F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")))).alias("coordinates"))
    return export.ring_boxes(rings, "label")


@query("""WITH e AS (SELECT event_id, CAST(hour(ts) * 60 + (event_id * 37) % 600 - 400 AS INTEGER) AS s, CAST(hour(ts) * 60 + (event_id * 37) % 600 - 400 + (event_id * 91) % 1700 AS INTEGER) AS e FROM events),
k AS (SELECT *, s <= 0 AND e >= 1440 AS whole FROM e WHERE e > 0 AND s < 1440),
p AS (SELECT event_id, greatest(s, 0) AS a, least(e, 1440) AS b FROM k UNION ALL SELECT event_id, 0, e - 1440 FROM k WHERE NOT whole AND e > 1440 UNION ALL SELECT event_id, s + 1440, 1440 FROM k WHERE NOT whole AND s < 0)
SELECT event_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM p WHERE a < b""")
def fold_event_bands(spark, sf):
    s = (F.hour("ts") * 60 + F.col("event_id") * 37 % 600 - 400).cast("int")
    return export.fold_bands(A.table(spark, sf, "events").select("event_id", s.alias("s"), (s + (F.col("event_id") * 91 % 1700)).cast("int").alias("e")))


@query("""WITH d AS (SELECT l_suppkey AS gp_nr, CAST(year(CAST(l_shipdate AS DATE)) AS INTEGER) AS year, CAST(round(sum(l_quantity)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gp_nr ORDER BY year DESC) AS k FROM d) SELECT gp_nr, year, total FROM r WHERE k = 1""")
def latest_per_key(spark, sf):
    d = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gp_nr"), F.year(F.to_date("l_shipdate")).alias("year")).agg(F.round(F.sum("l_quantity")).cast("bigint").alias("total"))
    return ingest.latest_per_key(d, ["gp_nr"], ["year"])


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part), r AS (SELECT s % 10 AS g, k, b, row_number() OVER (PARTITION BY s % 10 ORDER BY s DESC, k DESC, b DESC) AS n FROM p) SELECT CAST(g AS BIGINT) AS g, k, b FROM r WHERE n = 1""")
def primary_rows(spark, sf):
    p = A.table(spark, sf, "part").select((F.col("p_size") % 10).cast("bigint").alias("g"), F.col("p_size").alias("s"), F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"))
    return export.primary_row(p, "g", "s", ["k", "b"])


@query()
def document_json(spark, sf):
    """Nested documents of all buildings on one day."""
    s = A.series(spark, sf)
    buildings = s.groupBy("gp_nr").agg(F.min("plz").alias("plz")).withColumns({"city": F.lit(None).cast("string"), "canton": F.lit(None).cast("string")})
    probs = buildings.select("gp_nr", *[((F.col("gp_nr") * k % 101) / 100).alias(f"prob_{a}") for k, a in ((3, "pv"), (5, "ev"), (7, "heatpump"), (11, "battery"))])
    ev = D.pv_export_days(_wide_events(spark, sf), D60)
    truth = export.ground_truth(buildings.select("gp_nr", *[F.when(F.col("gp_nr") % 2 == 0, 1).cast("tinyint").alias(f"label_{a}") for a in ("pv", "ev", "heatpump", "battery")]))
    return export.documents(buildings, probs, export.day_grid(s, _days(spark, sf)), export.day_events(ev, _days(spark, sf)), truth, buildings.filter("gp_nr % 3 = 0"))


# ---- metrics ---------------------------------------------------------------------------------


@query(f"""WITH {A.SCORES}, a AS (SELECT source, score, coalesce(sum(w) FILTER (WHERE y = 1), 0) AS p, coalesce(sum(w) FILTER (WHERE y = 0), 0) AS n FROM scores GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
SELECT source, round(CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / nullif(CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE), 0), 9) AS roc_auc FROM b GROUP BY 1""")
def roc_auc_weighted(spark, sf):
    return rounded(scoring.roc_auc(A.scores(spark, sf), ["source"]))


@query(f"""WITH {A.SCORES}, a AS (SELECT source, score, coalesce(sum(w) FILTER (WHERE y = 1), 0) AS p, sum(w) AS a FROM scores GROUP BY 1, 2), b AS (SELECT *, sum(p) OVER z AS cp, sum(a) OVER z AS ca FROM a WINDOW z AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT source, round(sum(CAST(p AS DOUBLE) * CAST(cp AS DOUBLE) / CAST(ca AS DOUBLE)) / nullif(CAST(sum(p) AS DOUBLE), 0), 9) AS average_precision FROM b GROUP BY 1""")
def average_precision(spark, sf):
    return rounded(scoring.average_precision(A.scores(spark, sf), ["source"]))


def _pr(t: float) -> str:
    n = round(t * 100)
    hit = f"CAST(sum(w) FILTER (WHERE score >= {t} AND y = 1) AS DOUBLE)"
    return f"round({hit} / nullif(CAST(sum(w) FILTER (WHERE score >= {t}) AS DOUBLE), 0), 9) AS precision_{n}, round({hit} / nullif(CAST(sum(w) FILTER (WHERE y = 1) AS DOUBLE), 0), 9) AS recall_{n}"


@query(f"WITH {A.SCORES} SELECT source, round(sum(w * (score - y) * (score - y)) / CAST(sum(w) AS DOUBLE), 9) AS brier, {_pr(0.5)}, {_pr(0.8)} FROM scores GROUP BY 1")
def brier_precision_recall(spark, sf):
    return rounded(scoring.threshold_metrics(A.scores(spark, sf), ["source"]))


_FEATURES = """f AS (SELECT p_partkey AS gp_nr, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 21) / 100.0 END AS ex, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 10) / -10.0 END AS rc, p_partkey % 7 AS su, p_partkey % 5 AS cl,
  (p_partkey % 4) / 2.0 AS sw, p_partkey % 6 AS sm, p_partkey % 9 AS wn, CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 3 END AS sn, (p_partkey % 8) / -10.0 AS tc, (p_partkey % 31) / 100.0 AS nz FROM part)"""


@query(f"""WITH {_FEATURES} SELECT gp_nr, CAST(CASE WHEN ex > 0.05 THEN 0.9 WHEN rc < -0.4 AND su < cl THEN 0.7 ELSE 0.2 END AS DOUBLE) AS base_pv, CAST(CASE WHEN ex > 0.05 AND nz > 0.15 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS base_battery,
CAST(CASE WHEN wn > 2 * sn AND tc < -0.3 THEN 0.8 ELSE 0.15 END AS DOUBLE) AS base_heat_pump, CAST(CASE WHEN sw >= 1 AND sm >= 3 THEN 0.85 ELSE 0.15 END AS DOUBLE) AS base_ev FROM f""")
def baseline_scores(spark, sf):
    """Parts as buildings whose features take all sides of the rules, nulls included."""
    k = F.col("p_partkey")
    rows = A.table(spark, sf, "part").select(
        k.alias("gp_nr"), F.when(k % 13 != 0, k % 21 / F.lit(100.0)).alias("days_with_export_ratio"), F.when(k % 17 != 0, k % 10 / F.lit(-10.0)).alias("correlation_solar_radiation_consumption"), (k % 7).alias("sunny_day_midday_mean"), (k % 5).alias("cloudy_day_midday_mean"),
        (k % 4 / F.lit(2.0)).alias("sessions_per_week"), (k % 6).alias("session_median"), (k % 9).alias("winter_night_mean_consumption"), F.when(k % 19 != 0, k % 3).alias("summer_night_mean_consumption"), (k % 8 / F.lit(-10.0)).alias("correlation_outside_temperature_consumption"), (k % 31 / F.lit(100.0)).alias("evening_near_zero_ratio"),
    )
    return rounded(scoring.baseline_scores(rows))


@query("""WITH m AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1) SELECT y, CAST(k AS BIGINT) AS fold, CAST(n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM m, range(5) t(k)""")
def stratified_fold_sizes(spark, sf):
    li = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.xxhash64(*A.table(spark, sf, "lineitem").columns).alias("id"))
    return scoring.stratified_folds(li, "y", 5, "id").groupBy("y", F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT s_suppkey AS gp_nr, CAST(s_suppkey % 97 AS DOUBLE) / 97 AS score FROM supplier), o AS (SELECT s_suppkey AS gp_nr, CAST(s_suppkey % 89 AS DOUBLE) / 89 AS score FROM supplier WHERE s_suppkey % 3 = 0)
SELECT f.gp_nr, round(coalesce(o.score, f.score), 9) AS pv_prob FROM f LEFT JOIN o ON o.gp_nr = f.gp_nr""")
def stacked_scores(spark, sf):
    """Out-of-fold scores where there are any, else the final model's, over fixed scores."""
    k = F.col("s_suppkey")
    scores = lambda m: A.table(spark, sf, "supplier").select(k.alias("gp_nr"), ((k % m) / F.lit(float(m))).alias("score"))
    return rounded(scoring.stack(scores(89).filter("gp_nr % 3 = 0"), scores(97), "gp_nr", scoring.SECOND_STAGE))


@query()
def boosted_scores(spark, sf):
    """Out-of-fold scores of class-weighted trees, calibrated: suppliers' returns from their line items."""
    li = A.table(spark, sf, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("gp_nr")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_extendedprice").alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label")).withColumn("weight", F.lit(1.0))
    oof = scoring.train_boosted(f, ["q", "d", "p"]).oof
    return scoring.calibrated(scoring.calibrate(oof), oof).select("gp_nr", "fold", "label", "score", "prob")


# ---- quality ---------------------------------------------------------------------------------


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def value_vocab(spark, sf):
    return quality.vocabulary(A.table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_phone IS NULL) AS n_null, count(DISTINCT c_phone) AS n_distinct, count(*) FILTER (WHERE regexp_matches(c_phone, '^\\d{2}-')) AS two_digits, count(*) FILTER (WHERE regexp_matches(c_phone, '0$')) AS ends_in_0 FROM (SELECT CAST(10 + c_custkey % 30 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS c_phone FROM customer)")
def key_pattern_profile(spark, sf):
    c = A.table(spark, sf, "customer").select(F.concat_ws("-", (F.col("c_custkey") % 30 + 10).cast("string"), F.col("c_custkey").cast("string")).alias("c_phone"))
    return quality.key_patterns(c, "c_phone", {"two_digits": r"^\d{2}-", "ends_in_0": "0$"})


@query("SELECT length(n_name) AS length, count(*) AS n FROM nation GROUP BY 1")
def length_histogram(spark, sf):
    return quality.length_histogram(A.table(spark, sf, "nation"), "n_name").select(F.col("length").cast("bigint").alias("length"), "n")


@query("SELECT 'dd.MM.yy' AS format, count(*) AS n_parsed, min(CAST(o_orderdate AS DATE)) AS \"first\", max(CAST(o_orderdate AS DATE)) AS \"last\" FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 6")
def date_format_profile(spark, sf):
    o = A.table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 10
    text = F.when(kind == 0, "?").when(kind <= 6, F.date_format("o_orderdate", " dd.MM.yy ")).when(kind == 7, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return quality.best_date_format(o.select(text.alias("d")), "d")


@query(f"WITH {A.DAILY}, p AS (SELECT CAST(median(daily) AS DOUBLE) AS median, {q('daily', 0.1)} AS p10, {q('daily', 0.5)} AS p50, {q('daily', 0.9)} AS p90 FROM daily) SELECT *, CASE WHEN median < 40 THEN 'kwh_per_15min' ELSE 'kw' END AS unit FROM p")
def unit_guess(spark, sf):
    return quality.unit_guess(A.daily(spark, sf), "daily")


@query("""SELECT event_type, count(*) AS n_rows, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, CAST(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_cells, count(DISTINCT user_id) AS n_places FROM events GROUP BY 1""")
def file_profile(spark, sf):
    e = A.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", F.when(F.col("value") >= 50, F.col("value")).alias("00:15"), F.when(F.col("user_id") % 2 != 0, F.col("value")).alias("00:30"))
    return quality.file_profile(e, "event_type", "day", ["00:15", "00:30"], "user_id")


@query(f"WITH {A.FLAGS} SELECT * FROM (SELECT 'PV' AS \"column\", count(*) FILTER (WHERE pv = 'x') AS n FROM flags UNION ALL SELECT 'Batterie', count(*) FILTER (WHERE battery = 'x') FROM flags) WHERE n > 0")
def affirmative_counts(spark, sf):
    return quality.yes_counts(A.flags(spark, sf), ["gp_nr", "PV", "Batterie", "plz"])  # a number 1 is no mark


@query("SELECT 'l_comment' AS \"column\", 0 AS n_null WHERE false UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_counts(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id").join(A.table(spark, sf, "labels"), "doc_id", "left")
    return quality.null_profile(d, ["doc_id"])


@query("SELECT i AS year, CAST(date_trunc('month', make_date(CAST(i AS BIGINT), 4, 1)) AS DATE) - CAST(dayofweek(make_date(CAST(i AS BIGINT), 3, 31)) AS INTEGER) - 1 AS day FROM range(2018, 2035) t(i)")
def dst_forward_days(spark, sf):
    return spark.range(2018, 2035).select(F.col("id").alias("year"), X.last_sunday(F.col("id").cast("int"), 3).alias("day"))


# ---- cells, keys and paths -------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || ',25' WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || '.5 ' WHEN 2 THEN '  ' WHEN 3 THEN 'NaN' WHEN 4 THEN 'n/a' END AS cell FROM orders),
v AS (SELECT *, TRY_CAST(replace(trim(cell), ',', '.') AS DOUBLE) AS x FROM t) SELECT o_orderkey, CASE WHEN NOT isnan(x) THEN x * 4 END AS kw, nullif(trim(cell), '') AS text FROM v""")
def lenient_numbers(spark, sf):
    """Cells with decimal commas, blanks and junk as numbers, and blanks as nulls."""
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, F.concat(c, F.lit(",25"))).when(k == 1, F.concat(F.lit(" "), c, F.lit(".5 "))).when(k == 2, "  ").when(k == 3, "NaN").when(k == 4, "n/a")
    return A.table(spark, sf, "orders").select("o_orderkey", X.decimal(cell, 4.0).alias("kw"), X.blank_to_null(cell).alias("text"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '00' || CAST(o_custkey AS VARCHAR) || '.0' WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN 2 THEN 'GP ' || CAST(o_custkey AS VARCHAR) || ' (old 7)' ELSE '000' END AS cell FROM orders)
SELECT o_orderkey, nullif(regexp_replace(regexp_replace(trim(cell), '\\.0$', ''), '^0+', ''), '') AS key, TRY_CAST(nullif(regexp_extract(cell, '(\\d+)', 1), '') AS BIGINT) AS digits FROM t""")
def normal_keys(spark, sf):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("00"), c, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 2, F.concat(F.lit("GP "), c, F.lit(" (old 7)"))).otherwise("000")
    return A.table(spark, sf, "orders").select("o_orderkey", X.clean_key(cell).alias("key"), X.first_digits(cell).alias("digits"))


@query("SELECT o_orderkey, 'AG-' || CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS parsed FROM orders")
def building_ids(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", export.building_id("o_orderkey").alias("id"))
    return o.select("o_orderkey", "id", export.parse_building_id(F.when(F.col("o_orderkey") % 3 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))).alias("parsed"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/in/' || CAST(1000 + o_custkey % 8000 AS VARCHAR) || '/2024-03.csv.gz' WHEN 1 THEN '/in/2023/wx_' || CAST(1000 + o_custkey % 8000 AS VARCHAR) || '.csv' WHEN 2 THEN '/in/2022/load_202204.csv' ELSE '/in/notes.txt' END AS p FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN regexp_extract(p, '/([0-9]{4})/[^/]+$', 1) WHEN 1 THEN '2023' WHEN 2 THEN '2022' END AS place, CASE WHEN o_orderkey % 4 = 0 AND regexp_matches(p, '/(19|20)[0-9]{2}/[^/]+$') THEN CAST(regexp_extract(p, '/([0-9]{4})/', 1) AS INTEGER) WHEN o_orderkey % 4 = 1 THEN 2023 WHEN o_orderkey % 4 = 2 THEN 2022 END AS year,
CASE WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 4 = 2 THEN 4 WHEN o_orderkey % 4 = 1 THEN TRY_CAST(nullif(regexp_extract(p, '(?:19|20)[0-9]{2}[-_]?(0[1-9]|1[0-2])[^/]*$', 1), '') AS INTEGER) END AS month FROM t""")
def path_keys(spark, sf):
    """Places, years and months that paths name."""
    k, c = F.col("o_orderkey") % 4, (F.col("o_custkey") % 8000 + 1000).cast("string")
    path = F.when(k == 0, F.concat(F.lit("/in/"), c, F.lit("/2024-03.csv.gz"))).when(k == 1, F.concat(F.lit("/in/2023/wx_"), c, F.lit(".csv"))).when(k == 2, "/in/2022/load_202204.csv").otherwise("/in/notes.txt")
    year, month = files.period_from_path(path)
    return A.table(spark, sf, "orders").select("o_orderkey", files.place_from_path(path).alias("place"), year.alias("year"), month.alias("month"))


@query("SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS kind, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT s_nationkey, CAST(s_suppkey AS DOUBLE), NULL, s_name FROM supplier")
def relaxed_union(spark, sf):
    """Parts with other types and columns."""
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("kind"))
    return files.union_relaxed([c, A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"), F.col("s_name").alias("name"))])


@query(f"""WITH r AS (SELECT user_id AS mp_id, CAST(ts AS DATE) AS day, hour(ts) AS h, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2, 3)
SELECT mp_id, day, {", ".join(f'max(CASE WHEN h = {h} THEN v END) AS "{(h + 1) % 24:02d}:00"' for h in range(24))} FROM r GROUP BY 1, 2""")
def long_to_wide(spark, sf):
    e = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("mp_id"), F.date_trunc("hour", F.col("ts")).alias("ts")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value"))
    return ingest.to_wide(e, ["mp_id"], 60)


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_keys(spark, sf):
    return files.distinct_keys(A.table(spark, sf, "lineitem"), "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0)")
def key_look_up(spark, sf):
    wanted = A.table(spark, sf, "supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return files.look_up(A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", wanted)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS size, o_custkey % 7 AS mtime FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 5 = 0")
def unfinished_files(spark, sf):
    """Files that a manifest doesn't have with their size and time."""
    f = A.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), (F.col("o_custkey") % 7).alias("mtime"))
    done = f.filter(F.col("path").cast("bigint") % 3 == 0).withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return ingest.resume_filter(f, done)


# ---- places, labels, weather -----------------------------------------------------------------


@query("SELECT c_custkey AS gp_nr, coalesce(s_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END) AS plz FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def filled_places(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("gp_nr"), F.col("c_nationkey").alias("plz"))
    seen = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gp_nr"), F.col("s_nationkey").alias("plz"))
    return registry.fill_place(c.select("gp_nr"), seen, c.filter("gp_nr % 5 <> 0"))


@query(f"""WITH {A.FLAGS}, f AS (SELECT CASE pv WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS a, CASE battery WHEN 'x' THEN 1 WHEN '-' THEN 0 END AS b FROM flags), r AS (SELECT CASE WHEN a = 1 THEN 1 ELSE 0 END AS label, CASE WHEN a IS NULL THEN 'unlabeled' ELSE 'registry' END AS source FROM f WHERE a IS NOT NULL OR b IS NULL)
SELECT 'pv' AS asset, CAST(label AS TINYINT) AS label, source, count(*) AS n FROM r GROUP BY 2, 3""")
def label_counts(spark, sf):
    f = A.flags(spark, sf).select(F.col("doc_id").alias("gp_nr"), X.mark_to_flag("PV").alias("label_pv"), X.mark_to_flag("Batterie").alias("label_battery"), F.lit(None).cast("date").alias("commissioned_pv"))
    return registry.label_counts(registry.training_labels(f, "pv", others=["pv", "battery"]))


@query("SELECT round(CAST(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE) / sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 9) AS scale_pos_weight FROM lineitem")
def class_weight(spark, sf):
    li = A.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round("l_quantity").cast("bigint").alias("weight"))
    return rounded(scoring.class_weight(li))


@query(f"""WITH {A.WEATHER} SELECT plz, ts, round(coalesce(last_value(shortwave_radiation IGNORE NULLS) OVER (PARTITION BY plz ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(shortwave_radiation IGNORE NULLS) OVER (PARTITION BY plz ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS shortwave_radiation,
CASE WHEN temperature_2m IS NOT NULL THEN round(greatest(15 - temperature_2m, 0), 9) END AS heating FROM weather""")
def filled_weather(spark, sf):
    """Gaps filled forward, then backward; heating degrees of the temperature as it is."""
    w = weather.fill_both_ways(A.weather(spark, sf), ["shortwave_radiation"], "plz", "ts")
    return rounded(w.select("plz", "ts", "shortwave_radiation", weather.heating_degrees().alias("heating")))


_LOCAL = "WITH t AS (SELECT event_id, date_trunc('hour', ts) + to_days(CAST((event_id * 7) % 365 AS INTEGER)) + to_minutes(CAST((event_id * 13) % 240 AS INTEGER)) AS ts FROM events), u AS (SELECT *, timezone('UTC', timezone('Europe/Zurich', ts)) AS late FROM t), v AS (SELECT *, CASE WHEN timezone('Europe/Zurich', timezone('UTC', late - INTERVAL 1 HOUR)) = ts THEN late - INTERVAL 1 HOUR WHEN timezone('Europe/Zurich', timezone('UTC', late)) = ts THEN late END AS utc FROM u)"


@query(f"{_LOCAL} SELECT event_id, utc, CASE WHEN utc IS NOT NULL THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts - utc = INTERVAL 2 HOUR THEN '+02:00' ELSE '+01:00' END END AS iso FROM v")
def local_times(spark, sf):
    """Local times of a year as UTC and as ISO texts; times that the clock skips are null here."""
    e = F.col("event_id")
    shifted = F.date_trunc("hour", F.col("ts")) + F.make_dt_interval((e * 7 % 365).cast("int"), F.lit(0), (e * 13 % 240).cast("int"))
    t = A.table(spark, sf, "events").select("event_id", shifted.cast("timestamp_ntz").alias("ts")).withColumn("utc", X.local_to_utc("ts"))
    return t.select("event_id", "utc", F.when(F.col("utc").isNotNull(), X.local_iso("ts")).alias("iso"))


@query("""WITH t AS (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS m FROM events) SELECT event_id, CAST(m AS DOUBLE) AS minute, printf('%02d', CAST(floor(m / 60.0 + 0.5) AS BIGINT)) AS tick, printf('%02d:%02d', m // 60, m % 60) AS clock FROM t""")
def minute_axis(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", X.minutes_from(F.date_trunc("minute", F.col("ts")), F.date_trunc("day", F.col("ts"))).alias("minute"))
    return e.select("event_id", "minute", X.hour_tick("minute").alias("tick"), X.clock("minute").alias("clock"))


# ---- texts, contributions, areas -------------------------------------------------------------


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_discount * 100) AS BIGINT) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Heat pump — ' || CAST(k * 10 AS VARCHAR) || '% ' || CASE WHEN k >= 8 THEN 'likely' WHEN k >= 5 THEN 'possible' ELSE 'unlikely' END AS text,
CASE WHEN k < 5 THEN '−' ELSE '+' END || printf('%.2f', abs(k - 5) / 100.0) AS contribution FROM t""")
def prediction_texts(spark, sf):
    k = F.round(F.col("l_discount") * 100).cast("bigint")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.prediction_text("heatpump", k * 10).alias("text"), X.signed((k - 5) / F.lit(100.0)).alias("contribution"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Peak load' WHEN 1 THEN 'Mean load above 15 °C' ELSE 'Mean ' || lower(c_mktsegment) END AS label FROM customer")
def human_labels(spark, sf):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "max_consumption").when(k == 1, "mean_consumption_T_above_15").otherwise(F.concat(F.lit("mean_"), F.col("c_mktsegment")))
    return A.table(spark, sf, "customer").select("c_custkey", reasons.human_label(name).alias("label"))


_SAY_F = "f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 21) / 70.0 END AS ex, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 10 + 1) / -70.3 END AS rc, (p_partkey % 7) / 3.0 AS su, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 5) / 3.0 END AS cl, (p_partkey % 9 + 1) / 7.0 AS wn, CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey % 3) / 7.0 END AS sn FROM part)"
_PCT = "CAST(CAST(round_even(ex * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_FIRST = "list_filter([{}], lambda x: x IS NOT NULL)"


@query(f"""WITH {_SAY_F}, r AS (SELECT k, CASE WHEN k % 2 = 0 THEN {_FIRST.format(f"{_PCT} || ' of days feed power back to the grid', 'Net load correlates with solar radiation (r = ' || printf('%.2f', rc) || ')', 'Midday net load is ' || printf('%.1f', su) || ' kW on sunny days vs ' || printf('%.1f', cl) || ' kW on cloudy days'")}
ELSE {_FIRST.format(f"'Only ' || {_PCT} || ' of days show any export to the grid', 'Midday net load does not follow solar radiation (r = ' || printf('%.2f', rc) || ')', 'No midday reduction in net load'")} END AS pv,
CASE WHEN k % 2 = 0 THEN {_FIRST.format("CASE WHEN sn > 0 THEN 'Winter nights use ' || printf('%.1f', wn / sn) || '× the power of summer nights' END")} ELSE {_FIRST.format("CASE WHEN sn > 0 THEN 'Winter and summer night loads are similar (' || printf('%.1f', wn / sn) || '×)' END")} END AS hp FROM f)
SELECT k AS gp_nr, CASE WHEN len(pv) = 0 THEN 'Consumption pattern is consistent with a PV system' ELSE array_to_string(pv, '; ') END || CASE WHEN k % 4 = 0 THEN '; Visible on the selected day as a highlighted band' ELSE '' END AS pv,
CASE WHEN len(hp) > 0 THEN array_to_string(hp, '; ') WHEN k % 2 = 0 THEN 'Consumption pattern is consistent with a heat pump' ELSE 'No sign of a heat pump in the consumption pattern' END AS heatpump FROM r""")
def reason_lines(spark, sf):
    """Parts as buildings whose features take all sides of the sentences, nulls included."""
    k = F.col("p_partkey")
    x = {
        "days_with_export_ratio": F.when(k % 13 != 0, k % 21 / F.lit(70.0)), "correlation_solar_radiation_consumption": F.when(k % 17 != 0, (k % 10 + 1) / F.lit(-70.3)), "sunny_day_midday_mean": k % 7 / F.lit(3.0),
        "cloudy_day_midday_mean": F.when(k % 5 != 0, k % 5 / F.lit(3.0)), "winter_night_mean_consumption": (k % 9 + 1) / F.lit(7.0), "summer_night_mean_consumption": F.when(k % 19 != 0, k % 3 / F.lit(7.0)),
    }
    prob = F.when(k % 2 == 0, 0.5).otherwise(0.49)
    text = lambda asset, shown=None: F.array_join(reasons.reasons(asset, x, prob, shown), "; ").alias(asset)
    return A.table(spark, sf, "part").select(k.alias("gp_nr"), text("pv", k % 4 == 0), text("heatpump"))


@query("""WITH v AS (SELECT s_suppkey AS k, 'f' || CAST(i AS VARCHAR) AS feature, ((s_suppkey * 13 + i * 29) % 101 - 50) / 10.0 AS value FROM supplier, range(8) t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(value) DESC, feature) AS rank FROM v)
SELECT k, CAST(rank AS INTEGER) AS rank, feature, round(tanh(value / 2), 3) AS contribution FROM r WHERE rank <= 6""")
def top_contributions(spark, sf):
    k = F.col("s_suppkey")
    pairs = F.array(*[F.struct(F.lit(f"f{i}").alias("feature"), (((k * 13 + i * 29) % 101 - 50) / F.lit(10.0)).alias("value")) for i in range(8)])
    top = A.table(spark, sf, "supplier").select(k.alias("k"), F.posexplode(X.top_contributions(pairs)).alias("i", "x"))
    return top.select("k", (F.col("i") + 1).alias("rank"), "x.feature", "x.contribution")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS value, round(v / max(v) OVER (PARTITION BY l_orderkey), 9) AS share FROM (SELECT *, CAST(round(l_tax * 100) AS BIGINT) - 4 AS v FROM lineitem) WHERE v > 0")
def contribution_shares(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(F.col("l_tax") * 100).cast("bigint") - 4).alias("value"))
    return rounded(export.contribution_bars(li, ["l_orderkey"]))


@query("SELECT CAST(min(embedding[1]) AS DOUBLE) AS west, CAST(min(embedding[2]) AS DOUBLE) AS south, CAST(max(embedding[1]) AS DOUBLE) AS east, CAST(max(embedding[2]) AS DOUBLE) AS north FROM embeddings")
def union_box(spark, sf):
    return export.union_box(bbox(spark, sf))


@query("SELECT n_nationkey AS plz, count(c_custkey) AS n, concat_ws(' ', CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 4 <> 0 THEN n_name END) AS label, count(c_custkey) > 0 AS has_buildings, n_nationkey IN (3, 7) AS is_active, n_nationkey = 3 AS outlined FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 50 = 0 GROUP BY n_nationkey, n_name")
def map_areas(spark, sf):
    """Areas with counts, labels and what a pointer on 3 and a choice of 7 make of them."""
    areas = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("plz"), export.place_label(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))).alias("label"))
    c = A.table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.col("c_nationkey").alias("plz"))  # so that some areas have none
    return export.highlighted(export.with_counts(areas, export.count_by(c, "plz"), "plz"), "3", "7")


@query("""WITH f AS (SELECT s_suppkey AS k, [s_suppkey * 3 % 101, s_suppkey * 5 % 101, s_suppkey * 7 % 101, s_suppkey * 11 % 101] AS p, [s_suppkey % 2, s_suppkey % 3, s_suppkey % 5, s_suppkey % 2] AS l FROM supplier), a AS (SELECT *, CAST(list_sum([CASE WHEN p[i] >= 60 AND l[i] = 0 THEN 1 ELSE 0 END FOR i IN [1, 2, 3, 4]]) AS INTEGER) AS agree FROM f)
SELECT k AS gp_nr, agree, round(CAST(list_sum(p) AS DOUBLE) / 100, 9) AS total FROM a WHERE k % 7 > 0 AND k % 4 >= 1 AND agree >= 2""")
def featured_candidates(spark, sf):
    k = F.col("s_suppkey")
    s = A.table(spark, sf, "supplier")
    per = lambda f, name: s.select(k.alias("gp_nr"), *[f(m).alias(f"{name}_{a}") for a, m in name_of.items()])
    name_of = {"pv": 3, "ev": 5, "heatpump": 7, "battery": 11}
    probs = per(lambda m: k * m % 101 / F.lit(100.0), "prob")
    name_of = {"pv": 2, "ev": 3, "heatpump": 5, "battery": 2}
    labels = per(lambda m: (k % m == 0).cast("int"), "label")
    kinds, meters = s.select(k.alias("gp_nr"), (k % 4 + 2).cast("int").alias("n_event_types")), s.select(k.alias("gp_nr"), F.when(k % 7 == 0, 2).otherwise(1).alias("num_mp_ids"))
    return rounded(export.featured_candidates(probs, labels, kinds, meters, sure=0.6).select("gp_nr", "agree", "total"))


@query(f"""WITH {A.SERIES}, p AS (SELECT gp_nr, min(plz) AS plz, coalesce(sum(round(net_kw, 3)) FILTER (WHERE CAST(ts AS DATE) = {_DAY} AND minute(ts) = 0), 0) AS total FROM series GROUP BY 1)
SELECT gp_nr, 'AG-' || CAST(gp_nr AS VARCHAR) AS id, plz AS postcode, plz AS city, 'AG' AS canton, CAST(gp_nr * 3 % 101 AS INTEGER) AS pv, CAST(gp_nr * 11 % 101 AS INTEGER) AS battery, 96 AS points, round(total, 6) AS total, gp_nr % 3 = 0 AS featured, '2024-01-10' AS day,
CASE WHEN gp_nr % 2 = 0 THEN true END AS truth, 'Prediction based on the building''s 15-minute load profile' AS reason FROM p""")
def document_fields(spark, sf):
    """Fields of the documents, read back from their JSON."""
    d = document_json(spark, sf).select("gp_nr", F.from_json("document", export.DOCUMENT).alias("d"))
    return d.select(
        "gp_nr", "d.id", "d.postcode", "d.city", "d.canton", "d.predictions.pv", "d.predictions.battery", F.size("d.electricity").alias("points"),
        F.round(F.aggregate("d.electricity", F.lit(0.0), lambda a, x: a + x["powerKw"]), 6).alias("total"), "d.featured", F.col("d.profileDate").alias("day"), F.col("d.groundTruth.heatPump").alias("truth"), F.col("d.explanation.assets.ev.reasons")[0].alias("reason"),
    )
