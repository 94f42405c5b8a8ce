"""Gaps and islands: runs of a condition along time or row order, and merging of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def add_runs(df: DataFrame, cond: Column, keys: list[str], ts: str, minutes: int, prefix: str = "run", every_condition: bool = True) -> DataFrame:
    """Adds <prefix>_id, <prefix>_start (first row of its run) and <prefix>_len.

    A run ends where the condition changes, or where the next row isn't exactly one interval later.
    Null conditions are false; runs of false are runs too.
    """
    w = _order(keys, ts)
    flag = F.coalesce(cond, F.lit(False))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    new = F.lag(F.col(ts)).over(w).isNull() | (F.col(ts) - F.lag(F.col(ts)).over(w) != step) | (F.lag("_w_flag").over(w) != F.col("_w_flag"))
    out = df.withColumn("_w_flag", flag).withColumn(f"{prefix}_start", new)
    out = out.withColumn(f"{prefix}_id", F.sum(F.col(f"{prefix}_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn(f"{prefix}_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, f"{prefix}_id")))
    return out.withColumnRenamed("_w_flag", f"{prefix}_flag")


def block_start(prefix: str, least: int) -> Column:
    """True on the first row of a run that holds the condition for ``least`` rows or more."""
    return F.col(f"{prefix}_flag") & F.col(f"{prefix}_start") & (F.col(f"{prefix}_len") >= least)


def ramp(x: str, keys: list[str], ts: str, minutes: int) -> Column:
    """Difference to the row exactly one interval earlier; null after a gap."""
    w = _order(keys, ts)
    return F.when(F.col(ts) - F.lag(F.col(ts)).over(w) == F.expr(f"INTERVAL {minutes} MINUTES"), F.col(x) - F.lag(x).over(w))


def index_runs(df: DataFrame, cond: Column, keys: list[str], index: str, *more: Column) -> DataFrame:
    """One row for each run of true by consecutive index: keys, s, e (exclusive), n, and ``more`` aggregates of its
    rows; gaps in time don't matter."""
    hits = df.filter(F.coalesce(cond, F.lit(False))).withColumn("_w_group", F.col(index) - F.row_number().over(_order(keys, index)))
    return hits.groupBy(*keys, "_w_group").agg(F.min(index).alias("s"), (F.max(index) + 1).alias("e"), F.count(F.lit(1)).alias("n"), *more).drop("_w_group")


def merge_runs(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Joins runs (s, e exclusive) whose gap to the one before is at most ``gap`` rows."""
    w = _order(keys, "s")
    new = F.coalesce(F.col("s") - F.lag("e").over(w) > gap, F.lit(True))
    marked = runs.withColumn("_w_new", new.cast("int")).withColumn("_w_group", F.sum("_w_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_w_group").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_w_group")


def with_index(df: DataFrame, keys: list[str], ts: str, name: str = "i") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(_order(keys, ts)) - 1).cast("bigint"))


def rolling_median(x: str, keys: list[str], ts: str, window: int) -> Column:
    """Median of ``window`` rows centred to the left: window / 2 before to window / 2 - 1 behind; shorter at the ends."""
    return F.percentile(F.col(x), F.lit(0.5)).over(_order(keys, ts).rowsBetween(-(window // 2), window - window // 2 - 1))
