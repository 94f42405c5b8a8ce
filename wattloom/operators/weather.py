"""Hourly weather: relabelling, resampling, sun classes, joins onto series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import exprs as X


def to_local(df: DataFrame, ts: str, zone: str = "Europe/Zurich") -> DataFrame:
    return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts)))


def first_per_hour(df: DataFrame, keys: list[str], utc: str) -> DataFrame:
    """Where the clock goes back, the first of two equal local hours stays."""
    w = Window.partitionBy(*keys).orderBy(utc)
    return df.withColumn("_w_n", F.row_number().over(w)).filter("_w_n = 1").drop("_w_n")


def relabel_by_row(df: DataFrame, cols: list[str], key: str = "plz", ts: str = "ts") -> DataFrame:
    """Interval-end values to interval starts: each row takes the next row's; the last keeps its own."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumns({c: F.coalesce(F.lead(c).over(w), F.col(c)) for c in cols})


def relabel_by_time(df: DataFrame, cols: list[str], key: str = "plz", ts: str = "ts") -> DataFrame:
    """The same by time: values move an hour back and meet the rows there; where that hour is missing they are null."""
    moved = df.select(key, (F.col(ts) - F.expr("INTERVAL 1 HOUR")).alias(ts), *[F.col(c).alias(f"_w_{c}") for c in cols])
    kept = df.select(*[c for c in df.columns if c not in cols])
    return kept.join(moved, [key, ts], "left").select(*kept.columns, *[F.col(f"_w_{c}").alias(c) for c in cols])


def fill_grid(df: DataFrame, minutes: int, cols: list[str], interpolated: list[str] = (), key: str = "plz", ts: str = "ts") -> DataFrame:
    """Rows at every interval from a key's first to last time: ``cols`` carried forward,
    ``interpolated`` linear between known values and null outside them."""
    ends = df.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    grid = ends.select(key, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {minutes} MINUTES"))).alias(ts))
    joined = grid.join(df, [key, ts], "left")
    back = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    out = {c: F.last(c, True).over(back) for c in cols}
    for c in interpolated:
        known = F.when(F.col(c).isNotNull(), F.col(ts))
        x0, x1, t0, t1 = F.last(c, True).over(back), F.first(c, True).over(ahead), F.last(known, True).over(back), F.first(known, True).over(ahead)
        share = F.try_divide(F.timestamp_diff("SECOND", t0, F.col(ts)).cast("double"), F.timestamp_diff("SECOND", t0, t1).cast("double"))
        out[c] = F.coalesce(F.col(c), x0 + (x1 - x0) * share)
    return joined.withColumns(out)


def fill_both_ways(df: DataFrame, cols: list[str], key: str, ts: str) -> DataFrame:
    back = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in cols})


def daily_sum(df: DataFrame, x: str, key: str = "plz", ts: str = "ts") -> DataFrame:
    """Null for a day without a value."""
    return df.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(x).alias("daily"))


def sun_class(days: DataFrame, group: list[str], low: float = 0.25, high: float = 0.75, x: str = "daily") -> DataFrame:
    """Flags sunny and cloudy days by nearest quantiles of their group (place and month, or place and year)."""
    bounds = days.groupBy(*group).agg(X.quantile_nearest(x, low).alias("_w_low"), X.quantile_nearest(x, high).alias("_w_high"))
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    joined = days.alias("d").join(bounds.alias("b"), same, "left")
    return joined.select("d.*", F.coalesce(F.col(x) >= F.col("_w_high"), F.lit(False)).alias("is_sunny_day"), F.coalesce(F.col(x) <= F.col("_w_low"), F.lit(False)).alias("is_cloudy_day"))


def join_hourly(series: DataFrame, weather: DataFrame, cols: list[str], key: str = "plz", ts: str = "ts") -> DataFrame:
    hourly = weather.select(F.col(key).alias("_w_key"), F.col(ts).alias("_w_hour"), *cols)
    return series.join(hourly, (F.col(key) == F.col("_w_key")) & (F.date_trunc("hour", F.col(ts)) == F.col("_w_hour")), "left").drop("_w_key", "_w_hour")


def join_days(series: DataFrame, classes: DataFrame, key: str = "plz", ts: str = "ts") -> DataFrame:
    days = classes.select(F.col(key).alias("_w_key"), F.col("day").alias("_w_day"), "is_sunny_day", "is_cloudy_day")
    out = series.join(days, (F.col(key) == F.col("_w_key")) & (F.to_date(ts) == F.col("_w_day")), "left").drop("_w_key", "_w_day")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_sunny_day", "is_cloudy_day")})


def heating_degrees(t: str = "temperature_2m", base: float = 15.0):
    return F.when(F.col(t).isNotNull(), F.greatest(F.lit(0.0), F.lit(base) - F.col(t)))


def gap_report(df: DataFrame, key: str = "plz", ts: str = "ts") -> DataFrame:
    """(key, n_rows, duplicates, gaps): rows that repeat a time, and steps other than one hour between distinct times."""
    times = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"))
    step = F.col(ts) - F.lag(F.col(ts)).over(Window.partitionBy(key).orderBy(ts))
    marked = times.withColumn("gap", F.coalesce(step != F.expr("INTERVAL 1 HOUR"), F.lit(False)))
    return marked.groupBy(key).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if("gap").alias("gaps"))
