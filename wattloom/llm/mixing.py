"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_STRATUM = 200  # documents that share one quota, on average
_ADDED = ["size", "source_size", "target", "taken"]


def words(text: str | Column) -> Column:
    """Runs of other characters than ASCII white space: each becomes one mark, so no list of words is made."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets for (source, source_size, n): weights repeat over the sources in order of code points,
    null last; a target stops at ``cap`` times its source's size and the excess is shared anew by
    weight until none is above.

    In order of room per weight, the sources that stop at their caps are a prefix.  The level of a
    prefix is what its caps leave, by the weight left; it rises while the next source stops below it
    and falls from then on, so the final level is the highest.  The windows run over one row for each
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", nth.cast("long")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = (
        ranked.withColumn("before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("all_size").cast("double") - F.col("before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("level", F.max("level").over(everything))
    )
    return left.select("source", "source_size", "n", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """Adds size (words), source_size, target (of the source) and taken (words the mix takes).

    Each document is taken whole ``floor(target / source_size)`` times.  The fractional repetition is
    drawn in strata of a source, dealt by a seeded hash, in seeded order: documents are taken once
    more until the stratum's share is reached; the one on the boundary is taken in part.  So every
    stratum meets its target within a word, and no task holds a source.

    Columns of the added names give way.  Null texts have no words; null sources are one source, last
    in order; rows with a null key are dealt by their text; rows that share a key are ordered by size and
    then alike.  With no words
    at all, all targets are 0.  An empty input has no rows.
    """
    kept = C.adding(docs, _ADDED)
    # here, so that no text is needed after the shuffle
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.md5(text))))
    sized = docs.select(*kept, words(text).alias("size"), drawn.alias("_w_draw"))
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = water_fill(per, cap, weights).select(F.col("source").alias("_w_source"), "source_size", F.col("n").alias("_w_n"), "target")
    rows = (
        sized.join(plan, F.col(source).eqNullSafe(F.col("_w_source")))
        .withColumn("_w_salt", F.conv(F.substring("_w_draw", 1, 8), 16, 10).cast("long") % F.ceil(F.col("_w_n") / _STRATUM))
        .withColumn("_w_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )
    stratum = Window.partitionBy("_w_source", "_w_salt")
    ahead = F.coalesce(F.sum("size").over(stratum.orderBy("_w_draw", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.round((F.col("_w_rate") - F.floor("_w_rate")) * F.sum("size").over(stratum)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), share - ahead))
    return rows.withColumn("taken", (F.floor("_w_rate") * F.col("size") + part).cast("long")).select(*kept, *_ADDED)


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each repetition that ``mix`` takes; a repetition in part keeps its first words.

    Documents of which nothing is taken go.
    """
    whole = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, part), "")
    texts = F.concat(F.array_repeat(F.col(text), whole), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    cols = [c for c in mixed.columns if c not in (*_ADDED, text)]
    return mixed.select(*cols, F.explode(texts).alias(text)).select([c for c in mixed.columns if c not in _ADDED])


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(C.documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", *_ADDED)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('17:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents
),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1) AS weight, source_size * CAST(3.0 AS DOUBLE) AS most FROM per),
filled AS (
  SELECT *, coalesce(sum(most) OVER up, CAST(0 AS DOUBLE)) AS before, CAST(coalesce(sum(weight) OVER up, 0) AS BIGINT) AS weight_before,
         CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight
  FROM ranked WINDOW up AS (ORDER BY most / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT *, (CAST(all_size AS DOUBLE) - before) / CAST(all_weight - weight_before AS DOUBLE) AS lv FROM filled),
targets AS (
  SELECT source, source_size, n, least(most, level * weight) AS target FROM (SELECT *, max(lv) OVER () AS level FROM levels)
),
dealt AS (
  SELECT d.*, t.source_size, t.target, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % CAST(ceil(n / 200.0) AS BIGINT) AS salt,
         CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
ahead AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, salt ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CAST(round((rate - floor(rate)) * CAST(sum(size) OVER (PARTITION BY source, salt) AS DOUBLE)) AS BIGINT) AS share
  FROM dealt
)
SELECT doc_id, size, source_size, target,
       CAST(CAST(floor(rate) AS BIGINT) * size + greatest(0, least(size, share - before)) AS BIGINT) AS taken
FROM ahead
"""
