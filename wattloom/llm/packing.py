"""Hierarchical packing into windows of several lengths.

Every task packs what it reads.  A document's full long windows stand alone; what remains is routed
to the tier of its length.  Tiers are packed from the longest window down: a window opens with a
remainder of its own tier, its gap takes the longest remainders of shorter tiers that fit, and when
none fits, a cut of one.  What a task has left at its end is cut at powers of two.  Windows of one
length are dealt into step groups of equal token counts and even attention cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

_SEQUENCE_BITS = 36  # of a sequence's number in its task
_ROWS = 4000
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"


@dataclass
class Piece:
    doc: int
    start: int
    length: int


@dataclass
class Pool:
    """Remainders by exact length; the bits of ``lengths`` tell which lengths are there."""

    by_length: dict[int, list[Piece]] = field(default_factory=dict)
    lengths: int = 0
    size: int = 0

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.lengths |= 1 << piece.length
        self.size += 1

    def longest(self, most: int) -> int:
        """The longest length there up to ``most``, or 0."""
        return max(0, (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def take(self, length: int) -> Piece:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            self.lengths &= ~(1 << length)
        self.size -= 1
        return piece


def pack_pool(pool: Pool, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[Piece]]]:
    """(window, pieces) of full windows; the rest stays in the pool, or with ``last`` is cut at powers of two."""
    for tier, window in enumerate(tiers):
        shorter = tiers[tier + 1] if tier + 1 < len(tiers) else 0
        while (first := pool.longest(window)) > shorter:
            pieces = [pool.take(first)]
            gap = window - first
            while gap and pool.lengths:
                if fits := pool.longest(gap):
                    pieces.append(pool.take(fits))
                    gap -= fits
                    continue
                cut = pool.take(pool.longest(window))
                pieces.append(Piece(cut.doc, cut.start, gap))
                pool.add(Piece(cut.doc, cut.start + gap, cut.length - gap))
                gap = 0
            if gap == 0:
                yield window, pieces
                continue
            if not last:  # too little for a window: it waits for more documents
                for p in pieces:
                    pool.add(p)
                return
            room = 0
            row: list[Piece] = []
            left = sum(p.length for p in pieces)
            for p in pieces:
                while p.length:
                    if not room:
                        room = full = 1 << (left.bit_length() - 1)
                        row = []
                    part = Piece(p.doc, p.start, min(room, p.length))
                    row.append(part)
                    p = Piece(p.doc, p.start + part.length, p.length - part.length)
                    room -= part.length
                    left -= part.length
                    if not room:
                        yield full, row


class TaskPacker:
    def __init__(self, tiers: tuple[int, ...], task: int, step_tokens: int, together: int):
        self.tiers, self.step_tokens, self.together = tiers, step_tokens, together
        self.next = task << _SEQUENCE_BITS
        self.steps = self.next
        self.pool = Pool()
        self.docs: dict[int, tuple] = {}  # number: (key, ids, tokens)
        self.open: dict[int, list] = {}  # window: full rows that wait for a step group
        self.count = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        n, top = len(ids) // 4, self.tiers[0]
        doc = self.count
        self.count += 1
        whole = n // top * top
        for start in range(0, whole, top):
            yield from self.row(top, [(key, start, top, n, ids[4 * start : 4 * (start + top)])], last=False)
        if n > whole:
            self.docs[doc] = (key, ids[4 * whole :], n, whole)
            self.pool.add(Piece(doc, whole, n - whole))
        if self.pool.size >= self.together:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        for window, pieces in pack_pool(self.pool, self.tiers, last):
            full = []
            for p in pieces:
                key, ids, n, base = self.docs[p.doc]
                full.append((key, p.start, p.length, n, ids[4 * (p.start - base) : 4 * (p.start - base + p.length)]))
            yield from self.row(window, full, last=False)
        held = {p.doc for ps in self.pool.by_length.values() for p in ps}
        self.docs = {k: v for k, v in self.docs.items() if k in held}
        if last:
            for window in sorted(self.open):
                yield from self.row(window, None, last=True)

    def row(self, window: int, pieces: list | None, last: bool) -> Iterator[tuple]:
        """Rows wait until two step groups of their window are full; those are dealt to even out cost."""
        held = self.open.setdefault(window, [])
        if pieces:
            held.append(pieces)
        each = max(1, self.step_tokens // window)
        if len(held) < 2 * each and not last:
            return
        held.sort(key=lambda row: -sum(p[2] * p[2] for p in row))
        groups = max(1, -(-len(held) // each))
        for i, row in enumerate(held):
            turn, at = divmod(i, groups)
            group = self.steps + (at if turn % 2 == 0 else groups - 1 - at)
            offset = 0
            for key, start, length, n, ids in row:
                yield key, start, length, n, self.next, offset, window, group, ids
                offset += length
            self.next += 1
        self.steps += groups
        self.open[window] = []


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, together: int = 4096
) -> DataFrame:
    """Pieces of documents in windows: key, start, length, doc_tokens, sequence_id, offset, window
    (the sequence's length), step_group and ids (little-endian unsigned 32-bit).

    A document is its text's ids and ``end_id``; a null or empty text is the end id alone.  Each id is
    in one piece.  ``tiers`` are powers of two, longest first.  A sequence fills its window exactly,
    so nothing is padded; windows below the shortest tier occur only at a task's end.  Rows that share
    a key are packed as documents of their own; a null key stays null.  No row is shuffled: a task
    holds ``together`` remainders, each shorter than the longest window, and two step groups.  The
    result repeats as long as the input is read in the same partitions.  An empty input has no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), TaskPacker(tiers, TaskContext.get().partitionId(), step_tokens, together)
        rows: list[tuple] = []
        types: list = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                rows.extend(packer.add(k, ids + end))
                if len(rows) >= _ROWS:
                    yield out()
        for row in packer.flush(True):
            rows.append(row)
            if len(rows) >= _ROWS:
                yield out()
        if rows:
            yield out()

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(C.tidy(run), f"`{key}` {kind}, {PIECE}")


def op7_tier_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")
