"""Data-quality profiles as small result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import exprs as X

#: Date formats that are tried, in this order.
DATE_FORMATS = ("dd.MM.yyyy", "yyyy-MM-dd", "dd.MM.yy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")
#: Marks that count as yes.
YES = ("ja", "x", "1", "true", "yes")


def vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) of trimmed values; null is a value."""
    long = df.unpivot([], cols, "column", "value") if len(cols) > 1 else df.select(F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("value"))
    return long.groupBy("column", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def key_patterns(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """One row: rows, nulls, distinct values, and rows that match each pattern."""
    c = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct"), *[F.count_if(F.coalesce(c.rlike(p), F.lit(False))).alias(k) for k, p in patterns.items()])


def length_histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.char_length(col).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(column, n_null) with NaN as null."""
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if c not in excluded]
    counts = df.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("float", "double") else F.lit(False))).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "n_null")


def best_date_format(df: DataFrame, col: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """One row (format, n_parsed, first, last): the format that reads most trimmed values, the earlier one on ties,
    null if none reads any."""
    df = df.select(F.trim(F.col(col)).alias(col))

    def read(f: str):
        day = F.try_to_date(F.col(col), f)
        # two digits from 70 on are years of the last century
        return day if "yyyy" in f else F.when(F.year(day) >= 2070, F.add_months(day, -1200)).otherwise(day)

    parsed = df.agg(*[x for i, f in enumerate(formats) for x in (F.count(read(f)).alias(f"n{i}"), F.min(read(f)).alias(f"a{i}"), F.max(read(f)).alias(f"b{i}"))])
    rows = F.array(*[F.struct(F.col(f"n{i}").alias("n_parsed"), F.lit(-i).alias("o"), F.lit(f).alias("format"), F.col(f"a{i}").alias("first"), F.col(f"b{i}").alias("last")) for i, f in enumerate(formats)])
    return parsed.select(F.array_max(rows).alias("r")).select(F.when(F.col("r.n_parsed") > 0, F.col("r.format")).alias("format"), "r.n_parsed", "r.first", "r.last")


def file_profile(wide: DataFrame, code: str, date: str, slots: list[str], place: str | None = None, pattern: str = "dd.MM.yyyy") -> DataFrame:
    """By channel in one pass: rows, first and last day, empty cells, distinct places."""
    day = F.try_to_date(F.col(date), pattern) if dict(wide.dtypes)[date] == "string" else F.col(date)
    cells = X.total_of([F.col(f"`{s}`").isNull().cast("int") for s in slots])
    extra = [F.count_distinct(place).alias("n_places")] if place else []
    return wide.groupBy(code).agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.sum(cells).alias("empty_cells"), *extra)


def dst_days(years: tuple[int, int] = (2018, 2034)):
    """The days on which the clock goes forward, as an array column."""
    return F.transform(F.sequence(F.lit(years[0]), F.lit(years[1])), lambda y: X.last_sunday(y, 3))


def unit_guess(daily: DataFrame, total: str, limit: float = 40.0) -> DataFrame:
    """One row: the median and nearest quantiles of daily sums, and the unit that the median suggests: energy of
    each interval below ``limit``, power otherwise and without any sum."""
    at = [(n, q) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]
    out = daily.agg(F.percentile(total, F.lit(0.5)).alias("median"), *[X.quantile_nearest(total, q).alias(n) for n, q in at])
    return out.withColumn("unit", F.when(F.col("median") < limit, "kwh_per_15min").otherwise("kw"))


def yes_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n) of text columns with any affirmative mark; columns of other types have none."""
    cols = [c for c in cols if dict(df.dtypes)[c] == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n long")
    counts = df.agg(*[F.count_if(F.coalesce(F.lower(F.trim(c)).isin(*YES), F.lit(False))).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in cols])
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Small tables as one of (section, row: JSON)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in parts.items()])
