"""Toxic spans by a linear-chain conditional random field.

Training, on a bounded sample of labelled rows, on the driver: words and word beginnings that stand
out in toxic documents label the tokens of those documents; a two-state chain (clean, toxic) over the
tokens of a line is fitted to these labels by gradient ascent with forward-backward marginals, over
parts of the sample in turn; a
logistic curve from a document's marginals to its label is fitted on rows that the chain has not
seen.  Scoring, everywhere: forward-backward over every line of every whole text.

With two states the chain needs ratios only: a = alpha(toxic)/alpha(clean) and b likewise for beta;
the marginal's odds are a*b.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_MARKS = b".,;:!?()[]{}\"'"
_TOP = 30.0  # bound of log odds
_KINDS = 5  # of features
_LEAST_WEIGHT = 0.2  # that a model keeps; its curve is fitted after
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> tuple[bytes, ...]:
    """Of a lower-cased token: the word without marks, and four beginnings."""
    w = word.strip(_MARKS)
    return (b"w" + w, b"4" + w[:4], b"5" + w[:5], b"6" + w[:6], b"8" + w[:8])


def marginals(u: np.ndarray, lengths: np.ndarray, log_step: np.ndarray, log_start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: each token's marginal of toxic, and the forward and backward ratios.

    u: log odds of each token's emission.  All sequences advance together, longest first, so the
    number of steps is the longest length.
    """
    if not len(u):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    (s00, s01), (s10, s11) = np.exp(log_step)
    e = np.exp(np.clip(u, -_TOP, _TOP))
    a, b = np.empty(len(u)), np.empty(len(u))
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # sequences longer than t
    at = starts[: active[0]]
    ratio = e[at] * np.exp(log_start)
    a[at] = ratio
    for t in range(1, sizes[0]):
        n = active[t]
        at = starts[:n] + t
        ratio = ratio[:n]
        ratio = np.minimum(np.maximum(e[at] * (s01 + ratio * s11) / (s00 + ratio * s10), 1e-13), 1e13)
        a[at] = ratio
    ratio = np.ones(0)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        grown = np.ones(n)  # sequences that end here
        m = len(ratio)
        if m:
            x = e[at[:m] + 1] * ratio
            grown[:m] = (s10 + s11 * x) / (s00 + s01 * x)
        b[at] = ratio = grown
    odds = a * b
    return odds / (1 + odds), a, b


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    log_step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    log_start: float = -6.0
    bias: float = 0.0
    curve: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def token_odds(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def measure(self, u: np.ndarray, lengths: np.ndarray, sizes: list[int]) -> Iterator[tuple[float, float, np.ndarray]]:
        """The same from the tokens' log odds, the lengths of lines and the tokens of each text."""
        p, _, _ = marginals(u, lengths, self.log_step, self.log_start)
        for end, n in zip(np.cumsum(sizes), sizes, strict=True):
            own = p[end - n : end]
            top = max(min(float(own.max()), 1 - 1e-9) if n else 0.0, 1e-9)
            yield float(np.log(top / (1 - top))), float(own.sum()), own


class _Odds(dict):
    """Word to log odds; forgets everything when full."""

    def __init__(self, model: Model, room: int = 150_000):
        super().__init__()
        self.model, self.room = model, room

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.room:
            self.clear()
        self[word] = x = self.model.token_odds(word)
        return x


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.odds = _Odds(model)

    def measure(self, texts: Iterable[bytes | None]) -> Iterator[tuple[float, float, np.ndarray]]:
        """(log odds of the greatest marginal, expected toxic tokens, marginals) of each text."""
        look = self.odds.__getitem__
        parts, lengths, sizes = [], [], []
        for t in texts:
            n = 0
            for line in (t or b"").lower().split(b"\n"):
                if words := line.split():
                    parts.append(np.fromiter(map(look, words), dtype=np.float64, count=len(words)))
                    lengths.append(len(words))
                    n += len(words)
            sizes.append(n)
        u = np.concatenate(parts) if parts else np.zeros(0)
        yield from self.model.measure(u, np.array(lengths, dtype=np.int64), sizes)

    def score(self, texts: Iterable[bytes | None]) -> Iterator[tuple[float, np.ndarray]]:
        w0, w1, w2, w3 = self.model.curve
        for top, expected, own in self.measure(texts):
            yield 1 / (1 + float(np.exp(-np.clip(w0 + w1 * top + w2 * np.log1p(expected) + w3 * np.log1p(len(own)), -_TOP, _TOP)))), own


class Sample:
    """Labelled texts as numbers: whole texts, of which only word numbers and lengths of lines are held.

    A text of which less than 70 % of the word triples is new, beside those before it, is left out: a group of
    copies counts once.
    """

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        self.labels: list[int] = []
        self._seen: set[int] = set()

    def add(self, text: bytes, label: int) -> None:
        low = text.lower()
        w = low.split()
        own = {h for h in (crc32(b" ".join(x)) for x in zip(w, w[1:], w[2:], strict=False)) if h % 8 == 0} or {crc32(text)}
        new = len(own & self._seen) * 10 < 3 * len(own)
        self._seen |= own
        if new:
            self.ids.append(np.fromiter((self.number.setdefault(x, len(self.number)) for x in w), dtype=np.int32, count=len(w)))
            lengths = np.fromiter((len(line.split()) for line in low.split(b"\n")), dtype=np.int64)
            self.lines.append(lengths[lengths > 0])
            self.labels.append(label)

    def table(self) -> np.ndarray:
        """Hashes of the features of each word, by its number."""
        import xxhash

        flat = array("Q", (xxhash.xxh3_64_intdigest(f) for w in self.number for f in features(w)))
        return np.frombuffer(flat, dtype=np.uint64).reshape(-1, _KINDS)


def telling_features(ids: list[np.ndarray], labels: list[int], number: np.ndarray, may: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` features (words, beginnings) tell toxic documents apart, by the likelihood ratio of
    document counts, beyond what the number of features tried makes likely by chance.  ``number``: the features
    of each word; ``may``: those that may tell."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    k1, k0 = np.zeros(size), np.zeros(size)
    if not n1 or not n0:
        return np.zeros(size, dtype=bool)
    for x, y in zip(ids, labels, strict=True):
        w = np.unique(x)
        (k1 if y else k0)[np.unique(number[w][may[w]])] += 1
    least = 2 + 2 * np.log(np.count_nonzero(k1) + 1)
    p1, p0, p = k1 / n1, k0 / n0, (k1 + k0) / (n1 + n0)
    log = lambda k, x: np.where(k > 0, k * np.log(np.maximum(x, 1e-300)), 0.0)
    likely = 2 * (log(k1, p1) - log(k1, p) + log(k0, p0) - log(k0, p) + log(n1 - k1, 1 - p1) - log(n1 - k1, 1 - p) + log(n0 - k0, 1 - p0) - log(n0 - k0, 1 - p))
    return (k1 >= 3) & (p1 > 4 * p0) & (likely >= least)


def fit_chain(sample: Sample, use: list[int], rounds: int = 80, epochs: int = 8, together: int = 200_000) -> Model:
    """Fits the chain to all lines that hold a token that tells, and to all lines of clean documents.

    Gradient ascent over parts of about ``together`` tokens in turn, ``rounds`` steps and ``epochs`` times
    over all parts at least, so memory does not grow with the sample.  Lines of over 1,000 tokens are several
    sequences; no token is left out.
    """
    model = Model()
    ids, lines, labels = ([x[i] for i in use] for x in (sample.ids, sample.lines, sample.labels))
    if not use:
        model.bias = -8.0
        return model
    names, number = np.unique(sample.table(), return_inverse=True)
    number = number.reshape(-1, _KINDS).astype(np.int32)
    # a whole word may tell at any length, a beginning from four bytes
    size = np.fromiter((len(w.strip(_MARKS)) for w in sample.number), dtype=np.int64, count=len(sample.number))
    may = np.stack([size >= 1] + [size >= 4] * (_KINDS - 1), axis=1)
    telling = telling_features(ids, labels, number, may, len(names))
    word_tells = (telling[number] & may).any(axis=1)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word numbers, marks, lengths
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = some = 0

    def close() -> None:
        nonlocal held, total
        if held:
            parts.append((np.concatenate([w for w, _ in held]), np.concatenate([m for _, m in held]), np.array([len(w) for w, _ in held], dtype=np.int64)))
        held, total = [], 0

    for x, cut, y in zip(ids, lines, labels, strict=True):
        marks = word_tells[x] & bool(y)
        for w, m in zip(np.split(x, np.cumsum(cut)[:-1]), np.split(marks, np.cumsum(cut)[:-1]), strict=True):
            if m.any() or (not y and len(w)):
                for at in range(0, len(w), 1000):
                    held.append((w[at : at + 1000], m[at : at + 1000]))
                total += len(w)
                some += int(m.sum())
                if total >= together:
                    close()
    close()
    if not some:
        model.bias = -8.0
        return model
    w = np.zeros(len(names) + 6)  # features, bias, start, four steps
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, max(rounds, epochs * len(parts)) + 1):
        words, marks, lengths = parts[(k - 1) % len(parts)]
        index, y = number[words], marks.astype(np.float64)
        last = np.cumsum(lengths) - 1
        follows = np.ones(len(y), dtype=bool)
        follows[last] = False
        now = np.flatnonzero(follows)  # tokens with a next one in their line
        first = np.concatenate([[0], last[:-1] + 1])
        seen_steps = np.array([np.sum((1 - y[now]) * (1 - y[now + 1])), np.sum((1 - y[now]) * y[now + 1]), np.sum(y[now] * (1 - y[now + 1])), np.sum(y[now] * y[now + 1])])
        u = w[index].sum(axis=1) + w[-6]
        p, a, b = marginals(u, lengths, w[-4:].reshape(2, 2), w[-5])
        x = np.exp(np.clip(u[now + 1], -_TOP, _TOP)) * b[now + 1]
        s = np.exp(w[-4:].reshape(2, 2))
        joint = np.stack([np.full(len(now), s[0, 0]), s[0, 1] * x, s[1, 0] * a[now], s[1, 1] * a[now] * x])
        joint /= joint.sum(axis=0)
        miss = y - p
        g = np.zeros_like(w)
        for kind in range(_KINDS):
            g[:-6] += np.bincount(index[:, kind], weights=miss, minlength=len(names))
        g[-6], g[-5], g[-4:] = miss.sum(), miss[first].sum(), seen_steps - joint.sum(axis=1)
        g -= 0.05 / len(parts) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    for word, own in zip(sample.number, number, strict=True):
        for f, i in zip(features(word), own.tolist(), strict=True):
            if abs(w[i]) > _LEAST_WEIGHT:
                model.weights[f] = float(w[i])
    model.bias, model.log_start, model.log_step = float(w[-6]), float(w[-5]), w[-4:].reshape(2, 2).copy()
    return model


def fit_curve(model: Model, sample: Sample, use: list[int]) -> tuple[float, float, float, float]:
    """Logistic curve over log odds of the greatest marginal, log of expected toxic tokens and log of
    tokens, by Newton steps."""
    y = np.array([sample.labels[i] for i in use], dtype=float)
    if not len(y) or y.min() == y.max():
        return (-2.0, 0.3, 0.5, 0.0)
    odds = np.fromiter(map(model.token_odds, sample.number), dtype=np.float64, count=len(sample.number))
    x = np.array([(1.0, top, np.log1p(n), np.log1p(len(own))) for i in use for top, n, own in model.measure(odds[sample.ids[i]], sample.lines[i], [len(sample.ids[i])])])
    w = np.array([0.0, 0.1, 0.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_TOP, _TOP)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * len(y) / 100 * np.eye(4)
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.01 * len(y) / 100 * w), -1, 1)
    return tuple(float(v) for v in w)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_label: int = 2000, seed: int = 5) -> Model:
    """Fits on at most ``per_label`` rows of either label, drawn by a seeded hash among labelled rows
    that are not held out; their whole texts, but for near copies of others in the sample (see ``Sample``).

    A key with several labels is toxic if one of them says so; of several texts of a key the least is taken.
    Rows of null key, label or text are not drawn.  Without rows of both labels the model scores every text low.
    The same tables and seed give the same model, whatever the type of keys and the order of rows.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    usable = usable.join(docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k")), "k", "left_semi")
    place = F.crc32(F.concat_ws(":", F.lit(seed), F.col("k").cast("string")).cast("binary"))
    draw = lambda y: usable.filter(F.col("y") == y).orderBy(place, "k").limit(per_label)
    drawn = {r.k: r.y for r in draw(1).unionByName(draw(0)).collect()}  # bounded by per_label
    if not drawn:
        return Model(bias=-8.0, curve=(-4.0, 0.1, 0.0, 0.0))
    chosen = docs.sparkSession.createDataFrame([(k,) for k in drawn], docs.select(F.col(key).alias("k")).schema)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(chosen), "k", "left_semi")
    sample = Sample()
    for r in rows.groupBy("k").agg(F.min("t").alias("t")).orderBy(place, "k").toLocalIterator():
        sample.add(r.t.encode(), drawn[r.k])
    sample._seen.clear()
    model = fit_chain(sample, [i for i in range(len(sample.ids)) if i % 4 != 3])
    model.curve = fit_curve(model, sample, [i for i in range(len(sample.ids)) if i % 4 == 3])
    del sample
    C.trim()
    return model


def spans_of(text: bytes, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens of one line with marginals of ``least`` or more: code points, end exclusive."""
    hit = np.flatnonzero(p >= least)
    if not len(hit):
        return []
    at = [m.span() for m in _TOKEN.finditer(text)]
    out: list[dict] = []
    prior = -2
    for i in hit:
        start, end = at[i]
        if i == prior + 1 and b"\n" not in text[at[prior][1] : start]:
            out[-1] |= {"e": end, "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"s": start, "e": end, "p": float(p[i])})
        prior = i
    place = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].decode()))
    return [{"start": place(x["s"]), "end": place(x["e"]), "probability": x["p"]} for x in out]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score, predicted and toxic_spans to all columns of ``docs`` (clashing ones give way).

    Null, empty and blank texts have no tokens and get the curve's lowest score.  Every line of a
    text is one sequence, however long.  Equal texts score alike.  An empty input has no rows.
    """
    C.small_batches(docs.sparkSession)
    kept = C.adding(docs, ["score", "predicted", "toxic_spans"])
    at = kept.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            scores, spans = [], []
            for i in range(0, len(texts), 500):
                some = texts[i : i + 500]
                for t, (s, own) in zip(some, scorer.score(some), strict=True):
                    scores.append(s)
                    spans.append(spans_of(t or b"", own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, _SPAN)], [*kept, "score", "predicted", "toxic_spans"]
            )

    extra = docs.sparkSession.createDataFrame([], "score double, predicted int, toxic_spans array<struct<start:long,end:long,probability:double>>").schema
    schema = docs.select(*kept).schema
    for f in extra:
        schema = schema.add(f)
    return docs.select(*kept).mapInArrow(C.tidy(run), schema)


def op2_toxic_spans(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.col("toxic_spans").cast("string").alias("toxic_spans"))
