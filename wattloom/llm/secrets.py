"""Secret scans with an incremental blob ledger.

A ledger is a folder.  ``store`` holds contents, addressed by SHA-256, in shards of compressed blocks;
``blobs`` says where each content lies.  ``paths`` has every version of every path with the digest of its
content, ``scans`` the findings of each content under each rule version.  Contents and scans are only ever
added, so whatever a batch relies on stays.  A scan takes the contents, of all batches, that have none under
the current rules, each once, straight from their shards: texts are not shuffled.  The findings of a path are
those of its content.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed patterns: kind, pattern, group whose length counts, least length. In this order where starts are equal.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 20),
    ("login", r"[a-z][a-z0-9+]*://[^\s/:@]+:[^\s/:@]+@", 0, 10),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "2026-11-a"
_FOUND = "array<struct<kind:string,start:long,end:long>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: What must be in a text, in lower case, for a pattern to be tried at all.
_HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "jwt": ("eyj",), "pem": ("-----begin",), "login": ("://",)}
# For these, a match short of the least length never hides a longer one, so the length may go into the pattern.
_SHORT = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
_COMPILED = [(kind, re.compile(_SHORT.get(kind, pattern), re.ASCII), group, least) for kind, pattern, group, least in RULES]


def scan(text: str | None, kinds: tuple[str, ...] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings by start, then order of rules: code points, end exclusive.

    Each kind's matches are leftmost and don't overlap; a match whose counted group is too short is
    dropped after it has been consumed.  ``kinds``: those to look for, all if None.
    """
    if not text:
        return []
    low = text.lower()
    found = []
    for order, (kind, pattern, group, least) in enumerate(_COMPILED):
        if (kinds is not None and kind not in kinds) or (kind in _HINTS and not any(h in low for h in _HINTS[kind])):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


_BLOCK = 1 << 20  # bytes of contents that are compressed together
_SHARD = 64 << 20  # of a shard, about; a content is never cut
_KNOWN = 2 << 20  # digests of contents in the store that are sent to writers (32 MB), so that these skip them
_PLACE = "shard string, block long, packed long, at long, size long"


class _Store:
    """Writes contents into shards.  A shard's name is of one attempt and in all rows that point to it, so
    rows of a task that ran twice agree with the shards of the attempt that they come from."""

    def __init__(self, root: str, known: np.ndarray):  # two rows: the halves of 128 bits, sorted
        import zstandard

        self.root, self.known, self.pack = root, known, zstandard.ZstdCompressor(level=3).compress
        self.seen: set[bytes] = set()
        self.out: C.ShardWriter | None = None
        self.name, self.block, self.size, self.raw = "", [], 0, 0
        self.waiting: list[tuple[bytes, int, int]] = []  # digest, place in the block, size

    def add(self, digest: bytes, data: bytes) -> Iterator[dict]:
        short = digest[:16]
        if short in self.seen or self._has(short):
            return
        self.seen.add(short)
        if self.out is None:
            self.name = uuid.uuid4().hex
            self.out = C.ShardWriter(f"{self.root}/store/{self.name}")
        self.waiting.append((digest, self.size, len(data)))
        self.block.append(data)
        self.size += len(data)
        if self.size >= _BLOCK:
            yield from self.flush()
        if self.raw >= _SHARD:
            yield from self.close()

    def _has(self, short: bytes) -> bool:
        """Whether the store has a content whose digest begins so."""
        one, two = np.frombuffer(short, dtype=">u8")
        at = int(np.searchsorted(self.known[0], one))
        while at < len(self.known[0]) and self.known[0][at] == one:
            if self.known[1][at] == two:
                return True
            at += 1
        return False

    def flush(self) -> Iterator[dict]:
        if self.waiting:
            data = self.pack(b"".join(self.block))
            offset = self.out.write(data)
            for digest, at, size in self.waiting:
                yield {"sha": digest.hex(), "shard": self.name, "block": offset, "packed": len(data), "at": at, "size": size}
            self.raw += self.size
            self.block, self.size, self.waiting = [], 0, []

    def close(self) -> Iterator[dict]:
        yield from self.flush()
        if self.out is not None:
            self.out.close()
            self.out, self.raw = None, 0


@dataclass
class BlobLedger:
    """``root`` is a folder that all executors see; ``rules`` names the rules' version, ``kinds`` are the rules.

    One writer commits at a time.  A job that fails leaves nothing that readers see.
    """

    spark: SparkSession
    root: str
    rules: str = RULE_VERSION
    kinds: tuple[str, ...] | None = None

    def _read(self, table: str, schema: str) -> DataFrame:
        """The table, empty before the first commit."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def blobs(self) -> DataFrame:
        return self._read("blobs", f"sha string, {_PLACE}")

    def scans(self) -> DataFrame:
        return self._read("scans", f"sha string, findings {_FOUND}, rules string")

    def paths(self, kind: str = "string") -> DataFrame:
        return self._read("paths", f"path {kind}, version long, sha string, batch string")

    def commit(self, versions: DataFrame, batch: str) -> None:
        """Adds (path, version, content) rows under the name ``batch``, and scans all contents, of this and
        earlier batches, that have no scan under the current rules.

        A batch that is committed again replaces its paths; contents and scans that the ledger has are neither
        stored nor scanned anew, and none is removed.  Null contents are empty ones; null paths and repeated rows
        are kept as they come; other columns are not looked at.  A batch without rows is a batch.
        """
        spark, root = self.spark, self.root
        rows = versions.select("path", "version", "content")
        have = self.blobs().select("sha")
        few = have.limit(_KNOWN + 1).count()
        short = have.select(F.unhex(F.substring("sha", 1, 32)).alias("s")).toArrow().column("s").to_pylist() if few <= _KNOWN else []
        halves = np.frombuffer(b"".join(short), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        known = spark.sparkContext.broadcast(halves[np.lexsort((halves[:, 1], halves[:, 0]))].T.copy())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, names = _Store(root, known.value), [f.name for f in place]

            def placed(found: list[dict]) -> pa.RecordBatch:
                k = len(found)
                empty = [pa.nulls(k, t) for t in (b_type, pa.int64(), pa.string())]
                return pa.RecordBatch.from_arrays([*empty, *[pa.array([x[n] for x in found], t) for n, t in zip(names, place_types, strict=True)]], ["path", "version", "of", *names])

            b_type = None
            place_types = [pa.string(), pa.string(), *[pa.int64()] * 4]
            for b in batches:
                b_type = b.schema.field(0).type
                found, shas = [], []
                for t in b.column(2).cast(pa.binary()).to_pylist():
                    digest = hashlib.sha256(t or b"").digest()
                    shas.append(digest.hex())
                    found += store.add(digest, t or b"")
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(shas, pa.string()), *[pa.nulls(k, t) for t in place_types]], ["path", "version", "of", *names])
                if found:
                    yield placed(found)
            if found := list(store.close()):
                yield placed(found)

        place = spark.createDataFrame([], f"sha string, {_PLACE}").schema
        schema = spark.createDataFrame([], f"path {versions.schema['path'].dataType.simpleString()}, version long, of string, sha string, {_PLACE}").schema
        # rows of paths, and rows that say where contents lie
        taken = C.durable(rows.mapInArrow(C.tidy(run), schema), "taken", f"{root}/taken/{uuid.uuid4().hex}")
        new = taken.filter("of is null").groupBy("sha").agg(F.min(F.struct("shard", "block", "packed", "at", "size")).alias("x")).select("sha", "x.*")
        new.join(have, "sha", "left_anti").write.mode("append").parquet(f"{root}/blobs")
        taken.filter("of is not null").select("path", "version", F.col("of").alias("sha")).write.mode("overwrite").parquet(f"{root}/paths/batch={batch}")
        self.scan_unseen()

    def scan_unseen(self) -> None:
        """Scans every content in the store that has no scan under the current rules, each once."""
        root, kinds = self.root, self.kinds

        def own(table: pa.Table) -> pa.Table:
            import zstandard

            system, path = C.files_of(f"{root}/store/{table.column('shard')[0].as_py()}")
            out: list[tuple[str, list]] = []
            with system.open_input_file(path) as f:
                at, data = -1, b""
                for row in table.sort_by([("block", "ascending"), ("at", "ascending")]).to_pylist():
                    if row["block"] != at:
                        at = row["block"]
                        f.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(f.read(row["packed"]))
                    text = data[row["at"] : row["at"] + row["size"]].decode()
                    out.append((row["sha"], [{"kind": k, "start": s, "end": e} for k, s, e in scan(text, kinds)]))
            return pa.table({"sha": pa.array([x for x, _ in out], pa.string()), "findings": pa.array([x for _, x in out], _TYPE)})

        done = self.scans().filter(F.col("rules") == self.rules).select("sha")
        unseen = self.blobs().join(done, "sha", "left_anti")
        # a shard's contents are one group, and a shard is bounded
        unseen.groupBy("shard").applyInArrow(own, f"sha string, findings {_FOUND}").write.mode("append").parquet(f"{root}/scans/rules={self.rules}")

    def unscanned(self, kind: str = "string") -> DataFrame:
        """Versions (path, version, sha) whose content has no scan under the current rules; ``scan_unseen`` ends them."""
        return self.paths(kind).select("path", "version", "sha").join(self.scans().filter(F.col("rules") == self.rules).select("sha"), "sha", "left_anti").select("path", "version", "sha")

    def findings(self, kind: str = "string") -> DataFrame:
        """(path, version, sha, findings) for every path and version, under the current rules.

        Reading a version without a scan under these rules raises an error: no version seems clean for want of a scan.
        """
        now = self.scans().filter(F.col("rules") == self.rules).select("sha", "findings")
        found = F.coalesce("findings", F.raise_error(F.concat(F.lit("no scan under the current rules of "), "sha")).cast(_FOUND))
        return self.paths(kind).select("path", "version", "sha").join(now, "sha", "left").select("path", "version", "sha", found.alias("findings"))


def spans_text(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of a column of findings, comma-joined."""
    col = F.col(spans) if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.coalesce(F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, by way of two batches and two rule versions.

    Half of the documents (by a hash of the key) are committed under the base rules.  The other half comes with the
    newer rules: its contents, and those of the first half, are scanned under these.  The first batch is then
    committed again, as after a lost acknowledgement, which stores and scans nothing.  Null texts are empty ones.
    """
    where = C.shared_dir(spark, "secrets")
    versions = C.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(1).cast("long").alias("version"), F.col("text").alias("content"))
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    BlobLedger(spark, where, "base", BASE).commit(versions.filter(half), "0001")
    ledger = BlobLedger(spark, where)
    ledger.commit(versions.filter(~half), "0002")
    ledger.commit(versions.filter(half), "0001")
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return ledger.findings("long").select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(spans_text("findings", BASE), 256).alias("base_sha256"), spans_text("findings").alias("spans"))
