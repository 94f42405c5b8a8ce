"""Token counts as rollups that signed deltas maintain.

A change is one document's count under one tokenizer version, before and after: no before is an
insert, no after a delete, both a revision (which may move the document to another source or
language).  A batch of changes is summed into signed rows for each source, language and tokenizer
version before it is shuffled, and committed as one folder of the rollup's delta table.  A batch that
is committed again replaces its folder with the same rows, so totals count it once.  Totals are sums
over deltas; compaction folds committed batches into one snapshot under a new generation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .mixing import words
from .tokens import encoder

DIMENSIONS = ["source", "lang", "tokenizer"]
MEASURES = ["documents", "tokens"]
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
CHANGE = "source string, lang string, tokenizer string, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Sums of (before, after: struct<source, lang, tokenizer, tokens> or null) as signed rows.

    Null sources and languages are values of their own; a null count adds a document and no tokens.
    Rows that cancel out stay out.
    """

    def side(column: str, sign: int) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(*[F.col(f"{column}.{d}").alias(d) for d in DIMENSIONS], F.lit(sign).cast("long").alias("documents"), (F.coalesce(F.col(f"{column}.tokens"), F.lit(0)) * sign).alias("tokens")))

    rows = changes.select(F.explode(F.array_compact(F.array(side("before", -1), side("after", 1)))).alias("d")).select("d.*")
    return rows.groupBy(*DIMENSIONS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("documents <> 0 or tokens <> 0")


class TokenRollup:
    """A rollup in a folder that all executors see: ``generation=N/batch=NAME`` folders of deltas.

    The newest generation is the one that is read.  One writer commits at a time; readers need no lock,
    since a batch appears when its job commits and a generation when its snapshot does.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str, prefix: str) -> list[str]:
        fs, p = self._folder(path)
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [x for x in found if x.getName().startswith(prefix) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return [x.getName()[len(prefix) :] for x in done]

    def _generations(self) -> list[int]:
        fs, p = self._folder(self.root)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(x.removeprefix("generation=")) for x in found if x.startswith("generation=")]

    def _now(self) -> int:
        """The newest generation whose snapshot is whole; 0 has none."""
        whole = [g for g in self._generations() if g == 0 or "_snapshot" in self._names(f"{self.root}/generation={g}", "batch=")]
        return max(whole, default=0)

    def committed(self) -> set[str]:
        """Names of all batches that totals count."""
        g = self._now()
        names = set(self._names(f"{self.root}/generation={g}", "batch=")) - {"_snapshot"}
        if g:
            names |= {r[0] for r in self.spark.read.schema("name string").parquet(f"{self.root}/generation={g}/folded").toLocalIterator()}
        return names

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; returns False, and does nothing, if a snapshot has it folded in."""
        g = self._now()
        at = f"{self.root}/generation={g}/batch={batch}"
        if batch in self.committed() and batch not in self._names(f"{self.root}/generation={g}", "batch="):
            return False
        signed(changes).write.mode("overwrite").parquet(at)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        g = self._now()
        folders = [f"{self.root}/generation={g}/batch={b}" for b in self._names(f"{self.root}/generation={g}", "batch=")]
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*folders)
        return rows.groupBy(*DIMENSIONS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into a snapshot of the next generation.

        The list of folded names is written before the snapshot, whose success mark makes the
        generation current; a failure before that leaves the old generation in use.
        """
        g, names = self._now(), sorted(self.committed())
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(f"{self.root}/generation={g + 1}/folded")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/generation={g + 1}/batch=_snapshot")


def counted(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and bpe_tokens and word_tokens (clashing ones give way);
    a null text has none of either."""
    kept = [c for c in C.adding(docs, ["bpe_tokens", "word_tokens"]) if c != text]
    sized = docs.select(*kept, words(text).alias("word_tokens"), F.col(text).alias("_w_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(ids) // 4 for ids in enc.encode_many(b.column(len(kept) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept) + 1], pa.array(n, pa.int64())], [*kept, "word_tokens", "bpe_tokens"])

    return sized.mapInArrow(C.tidy(run), docs.select(*kept).schema.add("word_tokens", "long").add("bpe_tokens", "long"))


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizer versions, by way of all kinds of change.

    Batch 1 inserts every document with its words and an estimate of its byte-pair tokens (bytes / 4);
    batch 2 revises the estimate to the real count; batch 3 deletes documents without words and batch 4
    inserts them again; batch 2 is then committed again, as after a lost acknowledgement.
    """
    import public_tokenizers

    where = C.shared_dir(spark, "token-rollup")
    docs = C.documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    sized = docs.withColumn("guess", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4))
    counts = C.durable(counted(sized, public_tokenizers.path("byte_bpe_50k.json")), "counts", f"{where}/counts")
    entry = lambda version, n: F.struct("source", "lang", F.lit(version).alias("tokenizer"), F.col(n).cast("long").alias("tokens"))
    none = F.lit(None).cast(f"struct<{CHANGE.replace(' ', ':').replace(',:', ',')}>")

    def changes(rows: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
        return rows.select(F.explode(F.array(*[F.struct(b.alias("before"), a.alias("after")) for b, a in pairs])).alias("c")).select("c.*")

    rollup = TokenRollup(spark, f"{where}/rollup")
    rollup.commit("0001", changes(counts, (none, entry("words-1", "word_tokens")), (none, entry("byte_bpe_50k", "guess"))))
    revise = changes(counts, (entry("byte_bpe_50k", "guess"), entry("byte_bpe_50k", "bpe_tokens")))
    rollup.commit("0002", revise)
    wordless = counts.filter("word_tokens = 0")
    rollup.commit("0003", changes(wordless, (entry("words-1", "word_tokens"), none), (entry("byte_bpe_50k", "bpe_tokens"), none)))
    rollup.commit("0004", changes(wordless, (none, entry("words-1", "word_tokens")), (none, entry("byte_bpe_50k", "bpe_tokens"))))
    rollup.commit("0002", revise)
    rollup.compact()
    rollup.commit("0002", revise)
    return rollup.totals()
