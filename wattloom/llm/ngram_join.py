"""Exact Jaccard self-join on word shingles by prefix filters under several global orders.

Texts become sets of 48-bit shingle hashes; equal sets are one node.  In a global order of all shingles,
two sets of similarity s share a shingle among the first n - ceil(s*n) + 1 of each.  Three orders are used:

- By hash.  Only the shingles that come first (a share of the hash range) are dealt to buckets, where
  those that no other set holds are found.  A set with more of them than a prefix can lack is done: all
  of a prefix of it is its own.  What remains are mostly near copies and sets made of shared passages.
- By the number of sets that hold a shingle, rare ones first, which the second deal counts, whole sets
  now, but only of those that remain.
- By the power of two of that number, then another hash; so shared shingles differ in their order too.

Under the last two, each posting (the sets with one shingle in their prefixes) gives its pairs, whatever
its size; the pairs of both orders are intersected before sets are compared.

Large groups of near copies would give links by the square.  So sets first meet a few leaders of the
groups that share a least hash, and postings then give only pairs of different components: no link
between components is missed, and few pairs are made.  Pairs of large postings, and all before sets are
fetched, pass a lossless test on signatures: parities of a set's shingles by hash, of which no more
differ than shingles do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_K = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse
_SALTS = tuple(map(np.uint64, (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)))
_BITS = 48  # of a shingle's hash
_FIRST = 3 << (_BITS - 3)  # the part of the hash range that the first deal sends: three eighths
_ENTRIES = 1 << 21  # of a chunk, which a task holds at once
_SLOTS = 60_000  # sets of a chunk; two bytes name one
_MANY = 0xFFFF  # in a set's place: several sets of the chunk
_SENT_IDS = 4 << 20  # keys that may be broadcast
_GROUP = 256  # sets of a group with one least hash that are compared until each has a leader
_BLOCK = 2048  # signatures of a posting that are compared at once
_SIGNED = 64  # a posting above so many sets carries signatures
_AGAIN = np.dtype([("token", "<u8"), ("count", "<u4")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sets of whole texts: sorted 64-bit hashes of runs of ``width`` words.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased.  A text with fewer words
    has its whole sequence as one shingle; one without words has none.  The words of many texts are
    hashed at once, as polynomials over their bytes from running sums, so no word becomes an object.
    """

    def __init__(self, width: int = 5, together: int = 1 << 20):
        import xxhash

        self.width, self.together, self.hash = width, together, xxhash.xxh3_64_intdigest
        self.up = self.down = np.zeros(0, dtype=np.uint64)
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.space = space
        self.low = np.arange(256, dtype=np.uint64)
        self.low[65:91] += np.uint64(32)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, _R, dtype=np.uint64), np.full(n, pow(int(_R), -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _some(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Sets of texts that lie end to end in ``data``; ``ends`` are their ends."""
        if not len(data):
            yield from (np.zeros(0, dtype=np.uint64) for _ in ends)
            return
        self._powers(len(data))
        word = ~self.space[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        inner = ends[(ends > 0) & (ends < len(data))]
        begins[inner] = word[inner]
        stops[inner - 1] = word[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(stops)
        total = np.cumsum((self.low[data] + np.uint64(1)) * self.up[: len(data)])
        h = total[last] - total[first] + (self.low[data[first]] + np.uint64(1)) * self.up[first]
        h = _mixed(h * self.down[first] + (last - first).astype(np.uint64) * _K)
        n = len(h) - self.width + 1
        if n > 0:
            x = h[:n].copy()
            for k in range(1, self.width):
                x *= _K
                x += h[k : n + k]
            x = _mixed(x)
        done = 0
        for stop in np.searchsorted(first, ends).tolist():
            count = stop - done
            if count >= self.width:
                s = x[done : stop - self.width + 1]
                s.sort()
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield np.array([self.hash(h[done:stop].tobytes(), seed=count)][: bool(count)], dtype=np.uint64)
            done = stop

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text of a string or binary column; a null is an empty text."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.together)) - 1)
            yield from self._some(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
            at = to

    def node(self, s: np.ndarray) -> int:
        """A signed 64-bit fingerprint of a set."""
        return int(np.uint64(self.hash(s.tobytes())).astype(np.int64))


# ---- deals: shingles meet in buckets, and what a set shares comes back to its chunk ----

_HEAD = "keys array<long>, slots array<int>, nodes array<long>, sizes array<long>, taken array<int>, held binary"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_HEAD_TYPES = {"keys": _LONGS, "slots": _INTS, "nodes": _LONGS, "sizes": _LONGS, "taken": _INTS, "held": pa.binary()}


class _Deal:
    """How one deal cuts the hashes below ``below`` into buckets and packs them."""

    def __init__(self, buckets: int, below: int):
        self.below, self.span = below, below // buckets + 1
        self.buckets = buckets
        self.pages = (self.span >> 32) + 1

    def pack(self, bucket: int, entries: np.ndarray) -> bytes:
        """Sorted entries (hash, 16 bits of slot) of a bucket: how many begin with each page, then the other six bytes."""
        if not len(entries):
            return b""
        rel = entries - (np.uint64(bucket * self.span) << np.uint64(16))
        counts = np.bincount((rel >> np.uint64(48)).astype(np.int64), minlength=self.pages).astype("<u4")
        return counts.tobytes() + rel.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    def unpack(self, bucket: int, data: bytes) -> np.ndarray:
        if not data:
            return np.zeros(0, dtype=np.uint64)
        counts = np.frombuffer(data, "<u4", self.pages)
        low = np.zeros((int(counts.sum()), 8), dtype=np.uint8)
        low[:, :6] = np.frombuffer(data, np.uint8, offset=4 * self.pages).reshape(-1, 6)
        rel = low.view("<u8").ravel() | np.repeat(np.arange(self.pages, dtype=np.uint64) << np.uint64(48), counts)
        return rel + (np.uint64(bucket * self.span) << np.uint64(16))


class _Chunk:
    """Distinct sets of a task; a document names its set's slot."""

    def __init__(self, name: int):
        self.name, self.keys, self.slots, self.nodes, self.sizes, self.parts, self.at, self.held = name, [], [], [], [], [], {}, 0

    def add(self, key: int | None, node: int, s: np.ndarray, below: int) -> None:
        self.keys.append(key)
        if not len(s):
            self.slots.append(-1)
            return
        if node not in self.at:
            self.at[node] = len(self.nodes)
            self.nodes.append(node)
            self.sizes.append(len(s))
            t = s >> np.uint64(64 - _BITS)
            self.parts.append(t[: np.searchsorted(t, np.uint64(below))])
            self.held += len(self.parts[-1])
        self.slots.append(self.at[node])

    def rows(self, deal: _Deal) -> pa.RecordBatch:
        """A row for each bucket, and one with all else, which passes by."""
        taken = np.array([len(p) for p in self.parts], dtype=np.int32)
        v = np.zeros(0, dtype=np.uint64)
        if self.parts:
            v = np.concatenate(self.parts) << np.uint64(16) | np.repeat(np.arange(len(taken), dtype=np.uint64), taken)
            v.sort()
        t = v >> np.uint64(16)
        many = np.zeros(len(v), dtype=bool)  # shingles that several sets of the chunk hold
        twice = np.flatnonzero(t[1:] == t[:-1])
        many[twice] = many[twice + 1] = True
        single, held = v[~many], v[many]
        token, count = np.unique(held >> np.uint64(16), return_counts=True)
        again = np.zeros(len(token), dtype=_AGAIN)
        again["token"], again["count"] = token, count
        edges = np.arange(deal.buckets + 1, dtype=np.uint64) * np.uint64(deal.span)
        one, two = np.searchsorted(single >> np.uint64(16), edges), np.searchsorted(token, edges)
        used = np.flatnonzero((np.diff(one) > 0) | (np.diff(two) > 0))
        k = len(used) + 1
        columns = {
            "bucket": pa.array([*used.tolist(), -1 - self.name % deal.buckets], pa.int32()),
            "chunk": pa.array([self.name] * k, pa.int64()),
            "one": pa.array([deal.pack(b, single[one[b] : one[b + 1]]) for b in used.tolist()] + [None], pa.binary()),
            "again": pa.array([again[two[b] : two[b + 1]].tobytes() for b in used.tolist()] + [None], pa.binary()),
        }
        head = {"keys": self.keys, "slots": self.slots, "nodes": self.nodes, "sizes": self.sizes, "taken": taken.tolist(), "held": held.tobytes()}
        return pa.RecordBatch.from_pydict(columns | {n: pa.array([None] * (k - 1) + [x], _HEAD_TYPES[n]) for n, x in head.items()})


def _dealt(docs: DataFrame, width: int, deal: _Deal) -> DataFrame:
    """Rows of all chunks of (key, text).  A chunk is named by its task's number, so a second attempt makes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, name = Shingles(width), TaskContext.get().partitionId() << 32
        chunk = _Chunk(name)
        for batch in batches:
            for key, s in zip(batch.column(0).to_pylist(), shingles.sets(batch.column(1)), strict=True):
                if chunk.held >= _ENTRIES or len(chunk.nodes) >= _SLOTS or len(chunk.keys) >= 4 * _SLOTS:
                    yield chunk.rows(deal)
                    name += 1
                    chunk = _Chunk(name)
                chunk.add(key, shingles.node(s) if len(s) else 0, s, deal.below)
        if chunk.keys:
            yield chunk.rows(deal)

    return docs.mapInArrow(C.tidy(run), f"bucket int, chunk long, one binary, again binary, {_HEAD}")


def _met(deal: _Deal, whole: bool):
    """Of a bucket: for each chunk the entries whose shingle another set holds too.  With ``whole`` as (hash, slot) and the
    number of sets, also for shingles that several sets of the chunk hold; else the slots alone."""

    def own(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            k = table.num_rows
            return table.select(["chunk", *_HEAD_TYPES]).append_column("answer", pa.nulls(k, pa.binary())).append_column("df", pa.nulls(k, pa.binary()))
        one = [deal.unpack(bucket, x) for x in table.column("one").to_pylist()]
        again = [np.frombuffer(x, _AGAIN) for x in table.column("again").to_pylist()]
        v, g = np.concatenate(one), np.concatenate(again)
        token = np.concatenate([v >> np.uint64(16), g["token"]])
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        times = np.add.reduceat(np.concatenate([np.ones(len(v), np.int64), g["count"].astype(np.int64)])[order], first)
        df = np.empty(len(token), dtype=np.int64)
        df[order] = np.repeat(times, np.diff(np.append(first, len(token))))
        at, to = np.cumsum([0, *map(len, one)]), len(v) + np.cumsum([0, *map(len, again)])
        chunks, answers, dfs = [], [], []
        for i, chunk in enumerate(table.column("chunk").to_pylist()):
            mine, d = one[i], df[at[i] : at[i + 1]]
            shared = d > 1
            mine, d = mine[shared], d[shared]
            if whole:
                answer = np.concatenate([mine, again[i]["token"] << np.uint64(16) | np.uint64(_MANY)]).astype("<u8")
                d = np.concatenate([d, df[to[i] : to[i + 1]]]).astype("<u4")
            else:
                answer, d = (mine & np.uint64(0xFFFF)).astype("<u2"), d[:0]
            if len(answer):
                chunks.append(chunk)
                answers.append(answer.tobytes())
                dfs.append(d.tobytes())
        k = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), **{n: pa.nulls(k, t) for n, t in _HEAD_TYPES.items()}, "answer": pa.array(answers, pa.binary()), "df": pa.array(dfs, pa.binary())})

    return own


def _returned(docs: DataFrame, width: int, deal: _Deal, whole: bool) -> DataFrame:
    met = _dealt(docs, width, deal).groupBy("bucket").applyInArrow(_met(deal, whole), f"chunk long, {_HEAD}, answer binary, df binary")
    return met.groupBy("chunk")


def _split(table: pa.Table) -> tuple[dict, list[bytes], list[bytes]]:
    """The head of a chunk, its answers and their counts."""
    mask = table.column("keys").is_valid()
    rest = table.filter(pa.compute.invert(mask))
    return table.filter(mask).to_pylist()[0], rest.column("answer").to_pylist(), rest.column("df").to_pylist()


def _still_open(percent: int):
    """(key, n, node, alive) of a chunk's documents: not alive where too many shingles are the set's own."""

    def own(table: pa.Table) -> pa.Table:
        head, answers, _ = _split(table)
        k = len(head["nodes"])
        slots = np.concatenate([(np.frombuffer(head["held"], "<u8") & np.uint64(0xFFFF)).astype(np.int64), *(np.frombuffer(a, "<u2").astype(np.int64) for a in answers)])
        n = np.array(head["sizes"], dtype=np.int64)
        alone = np.array(head["taken"], dtype=np.int64) - np.bincount(slots, minlength=k)[:k]
        alive = np.append(alone <= n + percent * n // -100, False)
        slot = np.array(head["slots"], dtype=np.int64)
        nodes = pa.array(np.append(np.array(head["nodes"], dtype=np.int64), 0)[slot], mask=slot < 0)
        return pa.table({"key": pa.array(head["keys"], pa.int64()), "n": np.append(n, 0)[slot], "node": nodes, "alive": alive[slot]})

    return own


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the hashes by their last bits: four or more for each."""
    bits = max(256, 1 << int(4 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Parities that differ; the longer signature is folded to the other's length."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    b = np.bitwise_xor.reduce(np.frombuffer(b, "<u8").reshape(-1, len(a) // 8), axis=0)
    return int(np.bitwise_count(np.frombuffer(a, "<u8") ^ b).sum())


def _sets_of(percent: int):
    """(node, n, tokens, p0, p1, sig, stars) of a chunk's sets that may still have a link: the shingles that
    other sets hold, the prefixes under two orders as far as shared, the signature, three least hashes."""

    def own(table: pa.Table) -> pa.Table:
        head, answers, dfs = _split(table)
        v = np.concatenate([np.frombuffer(a, "<u8") for a in answers] or [np.zeros(0, np.uint64)])
        df = np.concatenate([np.frombuffer(d, "<u4") for d in dfs] or [np.zeros(0, np.uint32)]).astype(np.int64)
        many = v & np.uint64(0xFFFF) == np.uint64(_MANY)
        order = np.argsort(v[many])
        known, times = v[many][order] >> np.uint64(16), df[many][order]
        held = np.frombuffer(head["held"], "<u8")
        v, df = np.concatenate([v[~many], held]), np.concatenate([df[~many], times[np.searchsorted(known, held >> np.uint64(16))] if len(held) else times[:0]])
        slot, token = (v & np.uint64(0xFFFF)).astype(np.int64), v >> np.uint64(16)
        order = np.lexsort((token, slot))
        slot, token, df = slot[order], token[order], df[order]
        cut = np.searchsorted(slot, np.arange(len(head["nodes"]) + 1))
        out: dict[str, list] = {k: [] for k in ("node", "n", "tokens", "p0", "p1", "sig", "stars")}
        for i, (node, n) in enumerate(zip(head["nodes"], head["sizes"], strict=True)):
            t, d = token[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
            length = len(t) + percent * n // -100 + 1
            if length <= 0 or not len(t):
                continue
            by_count, by_power = np.lexsort((_mixed(t), d)), np.lexsort((_mixed(t ^ _SALTS[1]), np.frexp(d.astype(float))[1]))
            for k, x in (("node", node), ("n", n), ("tokens", t.view(np.int64)), ("p0", t[by_count[:length]].view(np.int64)), ("p1", t[by_power[:length]].view(np.int64))):
                out[k].append(x)
            out["sig"].append(signature(t))
            out["stars"].append([int(_mixed(t ^ salt).min().astype(np.int64)) for salt in _SALTS[2:]])
        types = {"node": pa.int64(), "n": pa.int64(), "sig": pa.binary()}
        return pa.table({k: pa.array(x, types.get(k, _LONGS)) for k, x in out.items()})

    return own


_SETS = "node long, n long, tokens array<long>, p0 array<long>, p1 array<long>, sig binary, stars array<long>"


# ---- links ----


def _pack(parts: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def _similar(x: np.ndarray, n: int, y: np.ndarray, m: int, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (n + m - both)


def _led(percent: int):
    """Links of sets to the leaders that they are similar to, one of those already joined, in each group of a pack; a set
    without any leads."""

    def own(table: pa.Table) -> pa.Table:
        s, h, salt, node, n = (table.column(c).to_numpy() for c in ("s", "h", "salt", "node", "n"))
        tokens = table.column("tokens").combine_chunks()
        flat, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        order = np.lexsort((node, node != table.column("pivot").to_numpy(), salt, h, s))
        a, b, group, leaders, joined = [], [], None, [], {}
        for r in order.tolist():
            if (s[r], h[r], salt[r]) != group:
                group, leaders, joined = (s[r], h[r], salt[r]), [], {}
            mine, met = flat[ends[r] : ends[r + 1]], set()  # met: leaders, by the least that they are joined with
            for q, other in leaders:
                if joined[q] not in met and (node[q] == node[r] or _similar(mine, int(n[r]), other, int(n[q]), percent)):
                    met.add(joined[q])
                    a.append(node[q])
                    b.append(node[r])
            if not met:
                leaders.append((r, mine))
                joined[r] = r
            elif len(met) > 1:
                joined = {q: min(met) if k in met else k for q, k in joined.items()}
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return own


def _star_links(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links of sets with the same least hash to leaders; large groups are cut into blocks that share one leader."""
    keyed = sets.select("node", F.posexplode("stars").alias("s", "h"))
    groups = keyed.groupBy("s", "h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).filter("m > 1")
    blocks = F.ceil(F.col("m") / _GROUP).cast("int")
    salts = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    rows = keyed.join(groups, ["s", "h"]).select("s", "h", "pivot", "node", F.explode(salts).alias("salt"))
    full = rows.join(sets.select("node", "n", "tokens"), "node").withColumn("pack", _pack(parts, "s", "h", "salt"))
    return full.groupBy("pack").applyInArrow(_led(percent), "a long, b long").distinct()


def _small_pairs(percent: int):
    """Pairs of different components, similar in size, in the postings of a pack."""

    def own(table: pa.Table) -> pa.Table:
        o, token, node, n, comp = (table.column(c).to_numpy() for c in ("o", "token", "node", "n", "comp"))
        order = np.lexsort((token, o))
        o, token, node, n, comp = (x[order] for x in (o, token, node, n, comp))
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (o[1:] != o[:-1])]))
        size = np.diff(np.append(first, len(token)))
        found = [np.zeros((0, 3), dtype=np.int64)]
        for m in np.unique(size).tolist():  # all postings of one length together
            i, j = np.triu_indices(m, 1)
            at = first[size == m]
            for some in np.array_split(at, max(1, len(at) * len(i) >> 20)):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
                x, y = x[ok], y[ok]
                found.append(np.unique(np.stack([o[x], np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"o": pairs[:, 0], "a": pairs[:, 1], "b": pairs[:, 2]})

    return own


def _folded(sigs: list[bytes], words: int) -> np.ndarray:
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0) for x in sigs])


def _large_pairs(percent: int):
    """The same of two blocks of a large posting, or within one, if they pass the test on signatures too.

    A pair comes from the first of its shared prefix shingles: none ``ahead`` of this one in either prefix is shared.
    """

    def own(table: pa.Table) -> pa.Table:
        task, side, o, node, n, held, comp = (table.column(c).to_numpy() for c in ("task", "side", "o", "node", "n", "held", "comp"))
        sig, inside = table.column("sig").to_pylist(), table.column("inside").to_numpy(zero_copy_only=False)
        lists, ahead = table.column("ahead").combine_chunks(), {}

        def before(r: int) -> frozenset:
            if r not in ahead:
                ahead[r] = frozenset(lists[r].as_py())
            return ahead[r]

        order = np.lexsort((node, side, task))
        found = [np.zeros((0, 3), dtype=np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            within = bool(inside[at[0]])
            left = at if within else at[side[at] == 0]
            right = at if within else at[side[at] == 1]
            if not len(left) or not len(right):
                continue
            length = np.array([len(sig[r]) // 8 for r in right])
            held_bits: dict[tuple[int, int], np.ndarray] = {}  # by length and length after folding
            for p, x in enumerate(left.tolist()):
                own_words = len(sig[x]) // 8
                for words in np.unique(length).tolist():
                    at_y = np.flatnonzero(length == words)
                    y = right[at_y]
                    ok = (comp[y] != comp[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)
                    if within:
                        ok &= at_y > p
                    if not ok.any():
                        continue
                    to = min(words, own_words)
                    if (words, to) not in held_bits:
                        held_bits[words, to] = _folded([sig[r] for r in y], to)
                    y, b = y[ok], held_bits[words, to][ok]
                    differ = np.bitwise_count(b ^ _folded([sig[x]], to)).sum(axis=1, dtype=np.int64)
                    y = y[differ * (100 + percent) <= (held[x] + held[y]) * (100 + percent) - 2 * percent * (n[x] + n[y])]
                    y = np.array([r for r in y.tolist() if before(r).isdisjoint(before(x))], dtype=np.int64)
                    if len(y):
                        found.append(np.stack([np.full(len(y), o[x]), np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"o": pairs[:, 0].astype(np.int64), "a": pairs[:, 1], "b": pairs[:, 2]})

    return own


def _met_in_large(large: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (o, a, b) of large postings.  Sets of the posting's main component meet the blocks of the others only."""
    counts = large.groupBy("o", "token").agg(F.count_if(F.col("comp") != F.col("main")).alias("others"), F.first("m").alias("m"))
    size = lambda c: F.greatest(F.ceil(c / _BLOCK).cast("int"), F.lit(1))
    rows = large.drop("m").join(counts, ["o", "token"]).withColumns({"mains": size(F.col("m") - F.col("others")), "blocks": size(F.col("others"))})
    rows = rows.withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("blocks"))).cast("int")
    rows = rows.withColumn("own", own)
    place = lambda i, j, kind, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    all_blocks, all_mains = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    has_main = F.col("m") > F.col("others")
    with_main = F.transform(all_mains, lambda i: place(i, F.col("own"), 0, F.lit(1)))
    none = F.filter(with_main, lambda x: F.lit(False))
    with_others = F.transform(all_blocks, lambda j: place(F.least("own", j), F.greatest("own", j), 1, (F.col("own") > j).cast("int")))
    to = F.when(F.col("is_main"), F.transform(all_blocks, lambda j: place(F.col("own"), j, 0, F.lit(0)))).otherwise(F.concat(F.when(has_main, with_main).otherwise(none), with_others))
    dealt = rows.select("o", "token", "pos", "node", "comp", F.explode(to).alias("to")).select("o", "token", "pos", "node", "comp", "to.*")
    dealt = dealt.join(sets.select("node", "n", F.size("tokens").cast("long").alias("held"), "sig", "p0", "p1"), "node")
    dealt = dealt.withColumn("ahead", F.slice(F.when(F.col("o") == 0, F.col("p0")).otherwise(F.col("p1")), F.lit(1), F.col("pos")))
    dealt = dealt.withColumns({"task": F.xxhash64("o", "token", "kind", "i", "j"), "inside": (F.col("kind") == 1) & (F.col("i") == F.col("j")), "o": F.col("o").cast("long")})
    dealt = dealt.select(_pack(parts, "task").alias("pack"), "task", "side", "o", "node", "n", "held", "comp", "sig", "inside", "ahead")
    return dealt.groupBy("pack").applyInArrow(_large_pairs(percent), "o long, a long, b long")


def _candidates(sets: DataFrame, comps: DataFrame, percent: int, parts: int, where: str) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle under both orders and pass the tests."""
    sized = comps.join(comps.groupBy("component").agg(F.count(F.lit(1)).alias("of")), "component")
    marked = sets.select("node", "n", "p0", "p1").join(sized, "node", "left")
    marked = C.durable(marked.select("node", "n", "p0", "p1", F.coalesce("component", "node").alias("comp"), F.coalesce("of", F.lit(1)).alias("of")), "marked", f"{where}/marked")
    row = ("node", "n", "comp", "of")
    entries = marked.select(F.lit(0).alias("o"), F.posexplode("p0").alias("pos", "token"), *row).unionByName(marked.select(F.lit(1).alias("o"), F.posexplode("p1").alias("pos", "token"), *row))
    mixed = entries.groupBy("o", "token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("of", "comp")).alias("top"))
    mixed = mixed.filter("lo <> hi").select("o", "token", "m", F.col("top.comp").alias("main"))
    rows = C.durable(entries.join(mixed, ["o", "token"]).select("o", "token", "pos", "node", "n", "comp", "m", "main"), "entries", f"{where}/entries")
    small = rows.filter(F.col("m") <= _SIGNED).select(_pack(parts, "o", "token").alias("pack"), F.col("o").cast("long").alias("o"), "token", "node", "n", "comp")
    pairs = small.groupBy("pack").applyInArrow(_small_pairs(percent), "o long, a long, b long")
    pairs = pairs.unionByName(_met_in_large(rows.filter(F.col("m") > _SIGNED).select("o", "token", "pos", "node", "comp", "m", "main"), sets, percent, parts))
    both = pairs.groupBy("a", "b").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo <> hi").select("a", "b")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.size("tokens").cast("long").alias(f"h{k}"), F.col("sig").alias(f"s{k}"))
    full = both.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb", "sa", "sb")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb, ha, hb = (t.column(c).to_numpy() for c in ("na", "nb", "ha", "hb"))
            room = (ha + hb) * (100 + percent) - 2 * percent * (na + nb)
            differ = np.array([_differ(x, y) for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True)], dtype=np.int64)
            yield t.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= room))

    return full.mapInArrow(C.tidy(passing), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("k", F.size(F.array_intersect("ta", "tb")))
    return met.filter(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): components of texts with 100 * intersection >= percent * union.

    ``component_id`` is the smallest key reachable by links, the row's own included; links within a component
    are not enumerated.  Keys are whole numbers (TypeError otherwise).  Texts without words, null ones too, have
    no shingles and are alone.  Texts are taken whole, however long.  Equal sets are linked, so ties and copies are
    one class; rows that repeat a key are one document with several texts: each text's links count.  A row with a
    null key is counted but linked with nothing, and has a null component.  Hashes are of 64 bits for whole sets and
    of 48 for shingles, which only two compared sets need to tell apart; nothing else is approximate.  Other columns
    are not looked at, whatever their names.  An empty input has no rows.
    """
    spark: SparkSession = docs.sparkSession
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {dict(docs.dtypes)[key]}")
    where = C.shared_dir(spark, "ngram-join")
    docs = C.settled(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), f"{where}/docs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, C.bytes_of(docs) // (32 << 20)))
    first = _returned(docs, width, _Deal(parts, _FIRST), False).applyInArrow(_still_open(percent), "key long, n long, node long, alive boolean")
    found = C.durable(first, "profile", f"{where}/profile")
    rows = found.select("key", "n", F.when(F.col("key").isNotNull(), F.col("node")).alias("node"))
    known = found.filter("node is not null and key is not null")
    classes = C.durable(known.groupBy("node").agg(F.min("key").alias("least"), F.max("alive").alias("alive")), "classes", f"{where}/classes")

    chosen = classes.filter("alive").select(F.col("least").alias("key")).distinct()
    few = classes.filter("alive").count() <= _SENT_IDS
    texts = docs.filter("key is not null").join(F.broadcast(chosen) if few else chosen, "key", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["key", "h"])
    texts = C.durable(texts.select("key", "text"), "texts", f"{where}/texts")
    deal = _Deal(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4), 1 << _BITS)
    sets = C.durable(_returned(texts, width, deal, True).applyInArrow(_sets_of(percent), _SETS), "sets", f"{where}/sets")

    stars = C.durable(_star_links(sets, percent, parts), "stars", f"{where}/stars")
    comps = C.durable(C.components(stars), "comps", f"{where}/star-comps")
    links = _verified(_candidates(sets, comps, percent, parts, where), sets, percent)
    name = classes.select("node", F.col("least").alias("id"))
    joined = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    edges = joined.join(name.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a document with several texts joins their classes
    several = rows.filter("node is not null").groupBy(F.col("key").alias("a")).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("a")
    again = rows.filter("node is not null").join(several, F.col("key") == F.col("a"), "left_semi").join(name, "node").filter("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    ends = C.components(edges.unionByName(again))
    named = classes.join(ends.select(F.col("node").alias("least"), "component"), "least", "left").select("node", F.coalesce("component", "least").alias("component"))
    out = rows.join(C.durable(named, "named", f"{where}/named"), "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, and all with a null key."""
    own = C.unused(docs, "_kept_key")
    found = near_copies(docs, text, key, **how).filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(own)).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col(own)), "left_semi")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(C.documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
