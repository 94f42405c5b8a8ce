"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
``documents``, in their order and types, whatever further columns there are: those travel along under one
name that no operator adds.  Between stages the rows are a Parquet table in the folder that all executors
share.  Every stage takes null, empty and very long texts, null keys and sources, ties and repeated rows; an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import common, line_dedup, mixing, ngram_join, packing, toxicity

_KEY, _TEXT = "doc_id", "text"


def _carrying(docs: DataFrame, change: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """``change`` applied to the columns it needs, with the other columns of ``docs`` beside them as one.

    ``n_chars``, where ``docs`` has it, is again the length of the text.
    """
    rest = [c for c in docs.columns if c not in needed]
    name = common.unused(docs, "_rest")
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    beside = [F.struct(*map(quoted, rest)).alias(name)] if rest else []
    changed = change(docs.select(*needed, *beside))

    def column(c: str):
        if c == "n_chars" and dict(docs.dtypes)[c] in ("int", "bigint"):
            return F.length(_TEXT).cast(docs.schema[c].dataType).alias(c)
        return F.col(c) if c in needed else F.col(f"{name}.{quoted(c)}").alias(c)

    return changed.select(*map(column, docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are.

    Null and empty texts score low and stay; equal texts fare alike; a null key is never drawn for the fit but is
    scored; repeated rows are each kept or each rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _carrying(docs, lambda d: toxicity.score(d, model).filter("predicted = 0"), _KEY, _TEXT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in one of them, that of the largest key.

    Every row stays, a text without lines left as an empty one; a null text becomes an empty one.  Rows that
    share a key are one document; rows with a null key are one document too, smaller than all others.
    """
    return _carrying(docs, line_dedup.drop_repeated_lines, _KEY, _TEXT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest key of each group of near copies stays, with all its rows.

    Null, empty and blank texts and rows with a null key are near nothing and stay.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target shares; a document comes as often as the mix takes it, the last time perhaps in part.

    Texts without words have nothing to take and go.  Null sources are one source; rows are drawn by their key, by
    their text where it is null.
    """
    return _carrying(docs, lambda d: mixing.repeated(mixing.mix(d)), _KEY, _TEXT, "source")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows, with their token ids.  A null or empty text is its end id; a null key stays
    null, and rows that share a key are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("source_mix", mix_sources), ("packing", pack_windows)]

#: Encoding isn't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
