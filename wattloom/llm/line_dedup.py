"""Line deduplication with two Bloom filters.

Every task sends the 64-bit hashes of its long lines, each at most twice, to the hash segment that
owns them.  A segment keeps two Bloom filters, for hashes seen once and seen twice; only the second
leaves it.  Lines that the second filter knows are suspected repeats: they alone go on, as 128-bit
digests with their document, to be counted exactly.  Segments grow in number with the input, so each
filter stays small; all filters together are broadcast up to ``broadcast_bytes`` and met by a shuffle
of the hashes beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SEGMENT_BYTES = 4 << 20  # of input, for one segment


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _places(h: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return tuple(((h + np.uint64(k) * step) & np.uint64(m - 1)).astype(np.int64) for k in range(3))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def _long_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if is_long(k, min_chars)} if len(text) >= min_chars else set()


def twice_filters(docs: DataFrame, text: str, min_chars: int, segments: int) -> DataFrame:
    """(segment, twice: packed bits) of the hashes of long lines that two documents may hold."""
    import xxhash

    hashed = xxhash.xxh3_64_intdigest

    def start():
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found: list[int] = []
            for t in _texts(batch, 0):
                found.extend(map(hashed, _long_keys(t, min_chars)))
            if not found:
                return
            h, n = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
            h = np.concatenate([h, h[n > 1]])
            owner = (h % np.uint64(segments)).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
            cut = np.flatnonzero(np.diff(owner)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[np.concatenate([[0], cut])]), pa.array([x.tobytes() for x in np.split(h, cut)], pa.binary())], ["segment", "hashes"]
            )

        return one

    def own(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        m = 1 << max(10, int(sum(map(len, sent)) * 10 - 1).bit_length())
        once, twice = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
        for h in sent:
            h, n = np.unique(h, return_counts=True)
            at = _places(h, m)
            again = (n > 1) | (once[at[0]] & once[at[1]] & once[at[2]])
            for p in at:
                once[p] = True
                twice[p[again]] = True
        return pa.table({"segment": table.column("segment")[:1], "twice": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    sent = C.map_batches(docs.select(text), start, "segment int, hashes binary")
    return sent.groupBy("segment").applyInArrow(own, "segment int, twice binary")


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for p in _places(h, len(bits) * 8):
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def suspected(docs: DataFrame, text: str, key: str, min_chars: int, segments: int, broadcast_bytes: int) -> DataFrame:
    """(doc, digest): the long lines, once for each document, that the second filter knows."""
    import xxhash

    hashed = xxhash.xxh3_64_intdigest
    spark = docs.sparkSession
    filters = C.durable(twice_filters(docs, text, min_chars, segments), "line-filters")
    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    if (filters.agg(F.sum(F.octet_length("twice"))).first()[0] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r.segment: bytes(r.twice) for r in filters.toLocalIterator()})

        def start():
            bits = {k: np.frombuffer(v, dtype=np.uint8) for k, v in sent.value.items()}

            def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                rows, keys = [], []
                for i, t in enumerate(_texts(batch, 1)):
                    if new := _long_keys(t, min_chars):
                        keys.extend(new)
                        rows.extend([i] * len(new))
                if not keys:
                    return
                h = np.array([hashed(k) for k in keys], dtype=np.uint64)
                owner = (h % np.uint64(segments)).astype(np.int64)
                ok = np.zeros(len(h), dtype=bool)
                order = np.argsort(owner, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                    ok[part] = _known(bits[int(owner[part[0]])], h[part])
                hit = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.array(rows, dtype=np.int64)[hit])), pa.array([_digest(keys[i]) for i in hit], pa.binary())], ["doc", "digest"]
                )

            return one

        return C.map_batches(slim, start, f"doc {kind.simpleString()}, digest binary")

    def spread():
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, hs, ds = [], [], []
            for i, t in enumerate(_texts(batch, 1)):
                for k in _long_keys(t, min_chars):
                    rows.append(i)
                    hs.append(hashed(k))
                    ds.append(_digest(k))
            h = np.array(hs, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array((h % np.uint64(segments)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(ds, pa.binary())],
                ["doc", "segment", "h", "digest"],
            )

        return one

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h = left.column("h").to_numpy().view(np.uint64)
        bits = np.frombuffer(right.column("twice")[0].as_py(), dtype=np.uint8)
        return left.filter(pa.array(_known(bits, h))).select(["doc", "digest"])

    lines = C.map_batches(slim, spread, f"doc {kind.simpleString()}, segment int, h long, digest binary")
    return lines.groupBy("segment").cogroup(filters.groupBy("segment")).applyInArrow(probe, f"doc {kind.simpleString()}, digest binary")


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 40, min_docs: int = 5, segments: int | None = None, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """Drops long lines that ``min_docs`` documents or more hold, except in the largest ``key``.

    Texts are split at newlines.  A line's key is the line without ASCII white space at its ends,
    A-Z lower-cased; keys of ``min_chars`` code points or more count once for each distinct ``key``.
    Returns all columns of ``docs`` with ``text`` rewritten, and n_lines and n_dropped (columns of
    those names give way).  A null or empty text is one empty line and comes back empty.  A null
    ``key`` counts as a document smaller than all others.  Rows that share a ``key`` are treated as
    one document and all stay.  An empty input has no rows.
    """
    segments = segments or max(1, min(500_000, C.bytes_of(docs) // _SEGMENT_BYTES))
    held = C.durable(suspected(docs, text, key, min_chars, segments, broadcast_bytes).distinct(), "line-suspects")
    common = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc").alias("keep")).filter(F.col("n") >= min_docs).select("digest", "keep")
    common = C.durable(common, "common-lines")  # as a table, so that a join on a very common line is split
    drops = held.join(common, "digest").filter(~F.col("doc").eqNullSafe(F.col("keep"))).groupBy(F.col("doc").alias("_w_doc")).agg(F.collect_list("digest").alias("_w_drops"))
    kept = C.adding(docs, ["n_lines", "n_dropped"])
    rows = docs.select(*kept).join(drops, F.col(key).eqNullSafe(F.col("_w_doc")), "left").drop("_w_doc")
    at = kept.index(text)

    def start():
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, lines, gone = [], [], []
            for t, drop in zip(_texts(batch, at), batch.column(len(kept)).to_pylist(), strict=True):
                if drop:
                    drop, parts = set(drop), t.split(b"\n")
                    stay = [x for x in parts if not (is_long(k := line_key(x), min_chars) and _digest(k) in drop)]
                    lines.append(len(parts))
                    gone.append(len(parts) - len(stay))
                    t = b"\n".join(stay)
                else:
                    lines.append(t.count(b"\n") + 1)
                    gone.append(0)
                texts.append(t)
            cols = [batch.column(i) for i in range(len(kept))]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*kept, "n_lines", "n_dropped"])

        return one

    schema = docs.select(*kept).schema.add("n_lines", "long").add("n_dropped", "long")
    return C.map_batches(rows, start, schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)
),
common AS (SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keep AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
