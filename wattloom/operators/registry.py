"""Entity resolution from meters to buildings, labels and dates of the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions import exprs as X


def resolve_meters(points: DataFrame, installations: DataFrame) -> DataFrame:
    """(mp_id, point, gp_nr): left joins over both hops; unresolved meters keep nulls for the audit."""
    return points.select("mp_id", "point").distinct().join(installations.select("point", "gp_nr").distinct(), "point", "left").select("mp_id", "point", "gp_nr")


def ambiguous(resolved: DataFrame) -> DataFrame:
    """Meters that lead to more than one building: (mp_id, n_buildings)."""
    return resolved.filter("gp_nr is not null").groupBy("mp_id").agg(F.count_distinct("gp_nr").alias("n_buildings")).filter("n_buildings > 1")


def unambiguous(resolved: DataFrame) -> DataFrame:
    return resolved.filter("gp_nr is not null").groupBy("mp_id").agg(F.min("gp_nr").alias("gp_nr"), F.max("gp_nr").alias("_w_most")).filter("gp_nr = _w_most").drop("_w_most")


def unmapped(meters: DataFrame, mapping: DataFrame, key: str = "mp_id") -> DataFrame:
    return meters.select(key).distinct().join(mapping, key, "left_anti")


def fold_labels(rows: DataFrame, marks: dict[str, str], key: str = "gp_nr") -> DataFrame:
    """Marks of all rows of a building to one three-valued label for each: any x is 1, else any - is 0."""
    return rows.groupBy(key).agg(*[F.max(X.mark_to_flag(mark)).alias(name) for name, mark in marks.items()])


def first_date(rows: DataFrame, dates: list[str], flag: Column, key: str = "gp_nr", name: str = "commissioned", pattern: str = "dd.MM.yyyy") -> DataFrame:
    """Earliest date for each key over rows with the flag, each row's being its first readable date."""
    parsed = F.coalesce(*[F.try_to_date(F.col(d), pattern) if dict(rows.dtypes)[d] == "string" else F.col(d) for d in dates])
    return rows.groupBy(key).agg(F.min(F.when(flag, parsed)).alias(name))


def hop_counts(first: DataFrame, second: DataFrame, third: DataFrame, hop: str, key: str) -> DataFrame:
    """(step, rows, keys) of the chain first -> second -> third over columns ``hop`` and ``key``."""
    one = first.select(hop).distinct()
    two = one.join(second.select(hop, key).distinct(), hop)
    three = two.join(third.select(key).distinct(), key, "left_semi")
    count = lambda df, step, k: df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("n_keys"))
    return reduce(DataFrame.unionByName, [count(one, "first", hop), count(two, "second", key), count(three, "third", key)])


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys in both, and how many agree or disagree on ``value``."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if(F.col("x") != F.col("y")).alias("disagree"))


def explode_keys(rows: DataFrame, cell: str, digits: int, name: str = "key") -> DataFrame:
    """A row for each identifier of ``digits`` digits in a messy cell; cells without one keep a null."""
    return rows.withColumn(name, F.explode_outer(F.regexp_extract_all(F.col(cell), F.lit(rf"(\d{{{digits}}})"), F.lit(1)))).withColumn(name, F.col(name).cast("bigint"))


def fill_place(frame: DataFrame, observed: DataFrame, registry: DataFrame, key: str = "gp_nr") -> DataFrame:
    """Observed place where known, else the registry's."""
    seen, said = observed.select(key, F.col("plz").alias("_w_seen")), registry.select(key, F.col("plz").alias("_w_said"))
    return frame.join(seen, key, "left").join(said, key, "left").withColumn("plz", F.coalesce("_w_seen", "_w_said")).drop("_w_seen", "_w_said")


def training_labels(flags: DataFrame, asset: str, until: str = "2025-07-01", key: str = "gp_nr", others: list[str] = ()) -> DataFrame:
    """(key, asset, label, weight, source) for one asset from label_<asset>, commissioned_<asset>.

    1 without a date or with one up to ``until``: positive; 1 with a later date: no row; 0: negative;
    unknown with another asset known: no row; all unknown: negative with weight 0.5, unlabeled.
    """
    flag, date = F.col(f"label_{asset}"), F.col(f"commissioned_{asset}")
    known = X.any_of([F.col(f"label_{o}").isNotNull() for o in others or [asset]])
    positive = (flag == 1) & (date.isNull() | (date <= F.lit(until).cast("date")))
    rows = flags.withColumn("_w_kind", F.when(positive, "positive").when(flag == 0, "negative").when(flag.isNull() & ~known, "unlabeled")).filter("_w_kind is not null")
    return rows.select(
        key, F.lit(asset).alias("asset"), F.when(F.col("_w_kind") == "positive", 1).otherwise(0).cast("tinyint").alias("label"),
        F.when(F.col("_w_kind") == "unlabeled", 0.5).otherwise(1.0).cast("float").alias("weight"), F.when(F.col("_w_kind") == "unlabeled", "unlabeled").otherwise("registry").alias("source"),
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("asset", "label", "source").agg(F.count(F.lit(1)).alias("n"))
