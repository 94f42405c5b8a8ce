"""Token ids in sorted-string-table shards.

A shard holds, in key order: blocks of entries with prefix-compressed keys, a Bloom filter over all
keys, an index with each block's first key and place, and a footer of fixed length.  A lookup reads
the footer, asks the filter, finds the block by binary search in the index and reads that block only.

Entry: shared prefix length, rest length, value length (varints), rest of the key, value.  The first
entry of a block shares nothing.  Keys: a byte 0 for null, or 1 and the identifier as 8 big-endian
bytes with the sign bit turned, so byte order is the order of identifiers, null first.  Values: ids
as unsigned little-endian 16-bit numbers where all ids of a shard's tokenizer fit, else 32-bit.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

_MAGIC = b"WLSST1\n\0"
_FOOTER = struct.Struct("<QQQQQQBxxxI8s")  # index at, length; filter at, length; entries, ids; id width; crc of index; magic
_BLOCK = 64 << 10
_PROBES = 7
_FILTER_BITS = 10  # for each key


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def doc_id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(key)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(_PROBES)]


class SstWriter:
    """Appends entries in key order; ``close`` adds filter, index and footer and publishes the file."""

    def __init__(self, uri: str, width: int):
        self.out, self.width = C.ShardWriter(uri), width
        self.block, self.prior, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = self.entries = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.prior)) and key[shared] == self.prior[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.prior = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.ids += len(value) // self.width
        self.entries += 1
        if len(self.block) >= _BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.first, self.out.write(bytes(self.block)), len(self.block)))
            self.block = bytearray()

    def close(self) -> tuple[int, int]:
        self._end_block()
        bits = max(64, len(self.keys) * _FILTER_BITS)
        marks = np.zeros(bits, dtype=bool)
        for k in self.keys:
            marks[_probes(k, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(marks, bitorder="little").tobytes()
        filter_at = self.out.write(packed)
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        index_at = self.out.write(index)
        self.out.write(_FOOTER.pack(index_at, len(index), filter_at, len(packed), self.entries, self.ids, self.width, zlib.crc32(index), _MAGIC))
        self.out.close()
        return self.entries, self.ids


class SstReader:
    def __init__(self, uri: str):
        system, path = C.files_of(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, self.filter_at, self.filter_n, self.entries, self.ids, self.width, crc, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        index = self._at(at, n)
        if magic != _MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} is no whole shard")
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        i = 0
        while i < n:
            k = index[i]
            self.firsts.append(index[i + 1 : i + 1 + k])
            self.places.append(struct.unpack_from("<QQ", index, i + 1 + k))
            i += 17 + k

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self._at(*self.places[i]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def wide(self, value: bytes) -> bytes:
        """A value as little-endian unsigned 32-bit ids."""
        return value if self.width == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        if not hasattr(self, "marks"):
            data = self._at(self.filter_at, self.filter_n)
            self.bits, self.marks = struct.unpack_from("<Q", data)[0], data[8:]
        return all(self.marks[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of all entries of a document; none if it isn't there."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found, i = [], max(0, bisect_right(self.firsts, key) - 1)
        while i and self.firsts[i] == key:  # equal keys may begin in an earlier block
            i -= 1
        while i < len(self.places) and self.firsts[i] <= key:
            found += [self.wide(v) for k, v in self._block(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, where: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", shards: int | None = None) -> DataFrame:
    """Encodes and writes ``docs`` in key order; returns the manifest (shard, uri, first, last,
    n_docs, n_tokens), ``first`` and ``last`` being keys of the shard.

    The rows are dealt by ranges of the key.  A null or empty text is the end id alone; a null key
    comes first; rows that share a key lie in one shard, ordered by text.  A task publishes its shard
    by renaming it, under a name of its attempt, which is in the manifest's row; so the manifest and the shards
    are of the same attempts.  Keys are whole numbers (TypeError otherwise).  An empty input has no shards.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {dict(docs.dtypes)[key]}")
    end = end_id.to_bytes(4, "little")
    n = shards or C.parts_for(docs)
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, writer = encoder(tokenizer), TaskContext.get().partitionId(), None
        uri, first, last = f"{where}/shard-{task:08d}-{uuid.uuid4().hex[:12]}.sst", None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                    writer, first = SstWriter(uri, width), k
                value = ids + end
                writer.add(key_of(k), np.frombuffer(value, dtype="<u4").astype("<u2").tobytes() if width == 2 else value)
                last = k
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [task], "uri": [uri], "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return C.durable(dealt.mapInArrow(C.tidy(run), "shard long, uri string, first long, last long, n_docs long, n_tokens long"), "sst-manifest", f"{where}/manifest")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """All entries as (key, start, n_tokens, ids): ``start`` counts the ids of all entries before."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    work = manifest.select("shard", "uri", before.alias("base")).repartitionByRange(tasks, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reader, rows, size, at = SstReader(uri), [], 0, base
                for k, v in reader:
                    ids = reader.wide(v)
                    rows.append((doc_id_of(k), at, len(ids) // 4, ids))
                    at += len(ids) // 4
                    size += len(ids)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [key, "start", "n_tokens", "ids"])

    return work.mapInArrow(C.tidy(run), f"`{key}` long, start long, n_tokens long, ids binary")


def look_up(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids (key, ids) of the wanted keys by binary search; keys that aren't there have no row.

    The first keys of all shards, of which there are 200,000 at most, go to every task and say which
    shard may hold a key; each task opens a shard once for its keys.
    """
    shards = sorted((key_of(r.first), r.uri) for r in manifest.select("first", "uri").toLocalIterator())
    sent = manifest.sparkSession.sparkContext.broadcast(shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in sent.value]
        for batch in batches:
            keys = [k for k in batch.column(0).to_pylist() if firsts]
            at = [sent.value[max(0, bisect_right(firsts, key_of(k)) - 1)][1] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.string())], ["k", "uri"])

    pairs = wanted.select(F.col(key).cast("long").alias("k")).distinct().mapInArrow(C.tidy(route), "k long, uri string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for batch in batches:
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != uri:
                    uri, reader = at, SstReader(at)
                if found := reader.get(k):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.binary())], [key, "ids"])

    return pairs.repartition("uri").sortWithinPartitions("uri", "k").mapInArrow(C.tidy(run), f"`{key}` long, ids binary")


def op3_sst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = C.shared_dir(spark, "sst")
    manifest = write_shards(C.documents(spark, sf_dir), where, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
