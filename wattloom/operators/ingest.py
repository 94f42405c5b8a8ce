"""Wide daily meter rows to one gap-aware series for each building."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import exprs as X

#: Slot labels and channel codes of the input.
SLOT = re.compile(r"(?:[01]\d|2[0-3]):[0-5]\d")
IMPORT, EXPORT = "1-1:1.29.0*255", "1-1:2.29.0*255"


def slot_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if SLOT.fullmatch(c)]


def unpivot_slots(wide: DataFrame, ids: list[str], date: str, slot: int = 15) -> DataFrame:
    """Wide rows to (ids, ts, value): slot labels name the interval's end, ts is its start that day."""
    long = wide.unpivot([*ids, date], slot_columns(wide), "_w_label", "value")
    start = F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), X.slot_minutes("_w_label", slot))
    return long.select(*ids, start.alias("ts"), "value")


def to_wide(long: DataFrame, ids: list[str], slot: int = 15, ts: str = "ts", value: str = "value") -> DataFrame:
    """Long rows to a row for each day: a column for each slot, named after the interval's end; the last is 00:00."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    ends = {m: f"{(m + slot) // 60 % 24:02d}:{(m + slot) % 60:02d}" for m in range(0, 1440, slot)}
    cells = [F.max(F.when(F.col("_w_minute") == m, F.col(value))).alias(name) for m, name in ends.items()]
    return long.withColumns({"day": F.to_date(ts), "_w_minute": minute}).groupBy(*ids, "day").agg(*cells)


def pivot_channels(readings: DataFrame, meter: list[str], channel: str = "channel", value: str = "kw") -> DataFrame:
    """Rows by channel to import_kw and export_kw for each meter and time.

    A channel is null unless all its cells are there; no export row at all means export 0, no import
    row means a null import; net is null if either is.
    """
    def side(name: str):
        rows = F.count_if(F.col(channel) == name)
        cells = F.count(F.when(F.col(channel) == name, F.col(value)))
        return rows, F.when(rows == cells, F.sum(F.when(F.col(channel) == name, F.col(value))))

    (n_import, imported), (n_export, exported) = side("import"), side("export")
    out = readings.groupBy(*meter).agg(F.when(n_import > 0, imported).alias("import_kw"), F.when(n_export == 0, F.lit(0.0)).otherwise(exported).alias("export_kw"))
    return out.withColumn("net_kw", F.col("import_kw") - F.col("export_kw"))


#: How the meters of a building combine: a column and the number of meters to one value.
STRATEGIES = {"sum": X.complete_sum}


def sum_meters(series: DataFrame, expected: DataFrame, building: str = "gp_nr", ts: str = "ts", meter: str = "mp_id", strategy: str = "sum") -> DataFrame:
    """Meters to buildings: sums are null unless every expected meter is there with a value."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    joined = series.join(expected, building)
    sums = {c: STRATEGIES[strategy](c, F.max("expected_meters")) for c in ("import_kw", "export_kw", "net_kw")}
    return joined.groupBy(building, ts).agg(*[v.alias(k) for k, v in sums.items()], F.count_distinct(F.when(F.col("net_kw").isNotNull(), F.col(meter))).alias("num_mp_with_data"))


def resum_parts(parts: DataFrame, keys: list[str] = ("gp_nr", "ts")) -> DataFrame:
    """Overlapping parts of one series, from several files, to one row for each key: nulls stay null
    only if all parts are."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("import_kw", "export_kw", "net_kw")], F.sum("num_mp_with_data").alias("num_mp_with_data"))


def ingest(wide: DataFrame, mapping: DataFrame, cohort: DataFrame | None = None, factor: float = 4.0, ids: tuple[str, str] = ("MP ID", "OBIS-Code"), date: str = "Datum", date_format: str = "dd.MM.yyyy", codes: tuple[str, str] = (IMPORT, EXPORT)) -> DataFrame:
    """The whole chain: buildings are joined and channels filtered on the wide rows, before the unpivot.

    mapping: mp_id, gp_nr, one row for each meter.  Bad dates are errors, bad cells null.
    """
    mp, obis = ids
    if cohort is not None:
        mapping = mapping.join(cohort.select("gp_nr").distinct(), "gp_nr", "left_semi")
    expected = mapping.groupBy("gp_nr").agg(F.count_distinct("mp_id").alias("expected_meters"))
    rows = wide.withColumn("mp_id", F.trim(F.col(f"`{mp}`"))).join(mapping.select("mp_id", "gp_nr").distinct(), "mp_id")
    rows = rows.withColumn("channel", F.when(F.col(f"`{obis}`") == codes[0], "import").when(F.col(f"`{obis}`") == codes[1], "export")).filter("channel is not null")
    rows = rows.withColumn("day", F.to_date(F.col(f"`{date}`"), date_format))
    long = unpivot_slots(rows.select("mp_id", "gp_nr", "channel", "day", *[F.col(f"`{c}`") for c in slot_columns(rows)]), ["mp_id", "gp_nr", "channel"], "day")
    meters = pivot_channels(long.withColumn("kw", X.decimal("value", factor)), ["mp_id", "gp_nr", "ts"])
    return sum_meters(meters, expected).filter("num_mp_with_data > 0 or import_kw is null")


def select_cohort(mapping: DataFrame, labels: DataFrame, extra: int = 0, seed: int = 0, forced: list[int] = (), labelled_only: bool = False) -> DataFrame:
    """(gp_nr, is_labeled, plz): linked buildings with a label, ``extra`` others in seeded order, forced ones.

    The order is a hash of seed and identifier, so the draw needs no list on the driver.
    """
    linked = mapping.select("gp_nr").filter("gp_nr is not null").distinct()
    flags = [c for c in labels.columns if c.startswith("label_")]
    known = labels.filter(X.any_of([F.col(c).isNotNull() for c in flags])).groupBy("gp_nr").agg(F.min("plz").alias("plz"))
    labelled = linked.join(known, "gp_nr").withColumn("is_labeled", F.lit(True))
    rest = linked.join(known, "gp_nr", "left_anti")
    drawn = rest.orderBy(F.xxhash64(F.lit(seed), "gp_nr"), "gp_nr").limit(0 if labelled_only else extra)
    wanted = rest.filter(F.col("gp_nr").isin(list(forced))) if forced else rest.limit(0)
    others = drawn.unionByName(wanted).distinct().withColumn("plz", F.lit(None).cast("string")).withColumn("is_labeled", F.lit(False))
    return labelled.select("gp_nr", "is_labeled", "plz").unionByName(others.select("gp_nr", "is_labeled", "plz"))


def resume_filter(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, size, mtime) that the manifest of done ones doesn't have as they are."""
    return files.join(done, ["path", "size", "mtime"], "left_anti")


def split_layouts(series: DataFrame) -> DataFrame:
    """import/export/net from whichever layout is there; a single power column splits at zero."""
    if "import_kw" in series.columns:
        net = F.col("net_kw") if "net_kw" in series.columns else F.col("import_kw") - F.col("export_kw")
        return series.withColumn("net_kw", net)
    p = F.col("power_kw")
    return series.select(*[c for c in series.columns if c != "power_kw"], X.clip(p, low=0.0).alias("import_kw"), X.clip(-p, low=0.0).alias("export_kw"), p.alias("net_kw"))


def detector_series(series: DataFrame, drop_missing: bool = False) -> DataFrame:
    """For detectors: missing values become 0 and quality says so."""
    missing = F.col("net_kw").isNull() | F.col("import_kw").isNull()
    out = series.withColumn("quality", F.when(missing, "missing").otherwise("ok"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("import_kw", "export_kw", "net_kw")})
    return out.filter("quality = 'ok'") if drop_missing else out


def latest_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is last by ``by``; give enough columns for a total order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in by])
    return df.withColumn("_w_n", F.row_number().over(w)).filter("_w_n = 1").drop("_w_n")
