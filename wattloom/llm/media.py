"""Media columns: content-addressed images in tar shards.

A text's UTF-8 bytes, padded to whole rows, are the samples of an 8-bit grey PNG, 576 wide.  Every
task appends the images it has not met to a tar shard of its own, each member named by the digest of
its payload.  Rows carry digest, shard, offset and length; copies in other tasks point to one place.
Metadata columns come from range reads of the image header alone.
"""

from __future__ import annotations

import secrets
import struct
import tarfile
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 576
_PAD = b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and header chunk
_ROLL = 512 << 20  # bytes after which a task begins another shard
_SHARD_BITS = 12  # of a shard's number in its task


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with 255 to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, _PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image of rows of 576 samples; no row filter, so the samples are the payload."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits, colour type from the first 33 bytes of an image."""
    if data[:8] != _PNG or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("no image header")
    return struct.unpack(">IIBB", data[16:26])


def decode_png(data: bytes) -> bytes:
    width, height, bits, colour = read_header(data)
    if (bits, colour) != (8, 0):
        raise ValueError("not an 8-bit grey image")
    at, packed = HEADER, []
    while data[at + 4 : at + 8] != b"IEND":
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, header: tuple[int, int, int, int]) -> str:
    """Shape from the header; mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = float((counts * values).sum()) / n
    deviation = (float((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"png {header[0]}x{header[1]} g{header[2]} mean={mean:.4f} sd={deviation:.4f} bits={float(-(p * np.log2(p)).sum()):.4f}"


class _TarShard:
    def __init__(self, uri: str):
        self.out = C.ShardWriter(uri)

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        at = self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        return at

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def shard_uri(where: str, shard: int) -> str:
    return f"{where}/media-{shard >> _SHARD_BITS:08d}-{shard & (1 << _SHARD_BITS) - 1:04d}.tar"


def store_media(docs: DataFrame, where: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes every payload of ``docs`` into tar shards of the folder ``where``; returns (key, n_bytes,
    digest, shard, offset, length): where the image of the row's text lies.

    A null or empty text is one row of padding.  Equal texts share one digest and one place: a task
    stores a payload once, and where several tasks stored it all rows point to the first shard's
    copy.  Rows that share a key, or whose key is null, keep rows of their own.  A shard appears under
    its name when it is whole; the name is of one attempt and in its rows, so rows never point into the shards of
    another attempt.  An empty input has
    no rows and no shards.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, shard, n_shards, seen = TaskContext.get().partitionId() << 20 | secrets.randbits(20), None, 0, {}
        for batch in batches:
            sizes, digests, places = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                t = t or b""
                payload = payload_of(t)
                digest = sha256(payload).digest()
                if digest not in seen:
                    if shard is None or shard.out.size > _ROLL:
                        if shard is not None:
                            shard.close()
                        number = (attempt << _SHARD_BITS) + n_shards
                        shard, n_shards = _TarShard(shard_uri(where, number)), n_shards + 1
                    image = encode_png(payload)
                    seen[digest] = (number, shard.add(f"{digest.hex()}.png", image), len(image))
                sizes.append(len(t))
                digests.append(digest)
                places.append(seen[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array([p[i] for p in places], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64())))],
                [key, "n_bytes", "digest", "shard", "offset", "length"],
            )
        if shard is not None:
            shard.close()

    stored = C.durable(docs.select(key, text).mapInArrow(C.tidy(run), f"`{key}` {kind}, n_bytes long, digest binary, shard long, offset long, length long"), "media-rows", f"{where}/rows")
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    objects = C.durable(first.select("digest", "place.*"), "media-objects", f"{where}/objects")
    return stored.select(key, "n_bytes", "digest").join(objects, "digest").select(key, "n_bytes", "digest", "shard", "offset", "length")


def _by_shard(objects: DataFrame) -> DataFrame:
    """Objects dealt in even runs of neighbours."""
    return objects.repartitionByRange(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "offset").sortWithinPartitions("shard", "offset")


class _Shards:
    """Range reads; one shard is open at a time."""

    def __init__(self, where: str):
        self.where, self.shard, self.file = where, None, None

    def read(self, shard: int, offset: int, n: int) -> bytes:
        if shard != self.shard:
            system, path = C.files_of(shard_uri(self.where, shard))
            self.shard, self.file = shard, system.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(n)


def read_metadata(objects: DataFrame, where: str) -> DataFrame:
    """(digest, width, height, bit_depth, color_type) of (digest, shard, offset, length), from the
    first 33 bytes of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(where)
        for batch in batches:
            heads = [read_header(shards.read(u, o, HEADER)) for u, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*heads, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in cols)], ["digest", "width", "height", "bit_depth", "color_type"])

    return _by_shard(objects.select("digest", "shard", "offset")).mapInArrow(C.tidy(run), "digest binary, width int, height int, bit_depth int, color_type int")


def read_payloads(objects: DataFrame, where: str) -> DataFrame:
    """(digest, payload, media): the payload decoded from the stored bytes, and those bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(where)
        for batch in batches:
            rows: list[tuple] = []
            for digest, *place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                media = shards.read(*place)
                rows.append((digest, decode_png(media), media))
                if len(rows) >= 500:
                    yield _out(rows)
                    rows = []
            if rows:
                yield _out(rows)

    def _out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "payload", "media"])

    return _by_shard(objects.select("digest", "shard", "offset", "length")).mapInArrow(C.tidy(run), "digest binary, payload binary, media binary")


def read_features(objects: DataFrame, where: str) -> DataFrame:
    """Digests of what is stored, by reading each object once: (digest, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature)."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(where)
        for batch in batches:
            rows = []
            for digest, *place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                media = shards.read(*place)
                payload = decode_png(media)
                rows.append((digest, len(payload), sha256(payload).digest(), zlib.crc32(payload[-32:]), len(media), sha256(media).digest(), feature_of(payload, read_header(media))))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return _by_shard(objects.select("digest", "shard", "offset", "length")).mapInArrow(C.tidy(run), "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def op10_tar_media(spark, sf_dir: str) -> DataFrame:
    where = C.shared_dir(spark, "media")
    rows = store_media(C.documents(spark, sf_dir), where)
    objects = spark.read.parquet(f"{where}/objects")
    known = C.durable(read_metadata(objects, where).join(read_features(objects, where), "digest"), "media-known", f"{where}/known")
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256"), "tail_crc32", "media_bytes", hexed("media_sha256"), "feature", "width", "height", "bit_depth", "shard", "offset"
    )
