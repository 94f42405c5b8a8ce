"""Near-duplicate vectors: spherical k-means cells, an exact bound on who can meet whom, blocked products.

Equal vectors are one node with a count.  Centres are fitted on a bounded sample; every node belongs
to the cell of its nearest centre.  A neighbour of u in another cell lies beyond the plane between the
two centres, so u is compared with a cell unless it is farther from that plane than a neighbour can
be; no link is lost.  Nodes lie in files of blocks in the order of cells.  A task holds one block,
reads the others that its nodes can reach, and only what it sums up leaves it: each node's number of
linked vectors and the links of a spanning forest.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_BLOCK, _MOST_BLOCK = 1024, 4096  # nodes
_ROWS_AT_ONCE = 4096


def fit_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres of spherical k-means over unit rows; an empty cell takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < 1e-12)
        if len(empty):
            far = np.argsort(near[np.arange(len(x)), own])[: len(empty)]
            sums[empty[: len(far)]] = x[far]
            norms = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
        new = sums / norms[:, None]
        if np.abs(new - centres).max() < 1e-6:
            break
        centres = new
    return centres


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n``, by links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(values: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision and which rows are usable: finite, not zero, of the right width."""
    out, ok = np.zeros((len(values), width)), np.zeros(len(values), dtype=bool)
    for r, v in enumerate(values):
        if v is not None and len(v) == width and not any(c is None for c in v):
            a = np.asarray(v, dtype=np.float64)
            top = np.abs(a).max() if width else 0.0
            if np.isfinite(a).all() and top > 0:
                a = a / top  # very large or small components neither overflow nor vanish
                out[r], ok[r] = a / np.linalg.norm(a), True
    return out, ok


def _sin(least: float) -> float:
    """Sine of the angle of cosine ``least``: how far beyond a plane a neighbour's vector can be; 1 excludes nothing."""
    return math.sqrt(max(0.0, 1 - least * least)) if least > 0 else 1.0


def reach(unit: np.ndarray, cell: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Which cells can hold a vector of cosine ``least`` or more, for each row of ``unit`` in its ``cell``.

    A vector v of cell b has v.(a - b) <= 0, a being the centre of u's cell; so the angle from u to v is
    at least that from u to the plane, whose sine is u.(a - b) / |a - b|.
    """
    near = unit @ centres.T
    own, at = np.unique(cell, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
    return near[np.arange(len(unit)), cell][:, None] - near <= _sin(least) * apart[at] + 1e-6


def _linked(unit: np.ndarray, single: np.ndarray, rows: np.ndarray, other: np.ndarray, other_single: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row) of all pairs of cosine ``least`` or more between ``rows`` of ``unit`` and ``other``.

    Products in single precision decide what is farther from ``least`` than their error; double
    precision decides the rest.
    """
    error = (unit.shape[1] + 8) * 2.0**-23
    near = single[rows] @ other_single.T
    i, j = np.nonzero(near >= least - error)
    good = near[i, j] >= least + error
    unsure = np.flatnonzero(~good)
    i = rows[i]
    for at in range(0, len(unsure), 65536):
        some = unsure[at : at + 65536]
        good[some] = (unit[i[some]] * other[j[some]]).sum(axis=1) >= least
    return i[good], j[good]


def _load(uris: list[str]) -> dict[str, np.ndarray]:
    """Nodes of block files, one after another; ``label`` counts from the first."""
    parts, n = [], 0
    for uri in uris:
        system, path = C.files_of(uri)
        with system.open_input_file(path) as f:
            t = pa.ipc.open_file(f).read_all().combine_chunks()
        unit = t.column("unit").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1)
        parts.append({"unit": unit, "label": t.column("label").to_numpy() + n} | {c: t.column(c).to_numpy() for c in ("name", "copies", "cell")})
        n += t.num_rows
    out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    return out | {"single": out["unit"].astype(np.float32)}


def near_vectors(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = 0.95, cells: int | None = None, probes: int = 4, sample: int = 20_000, seed: int = 11
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: how many other rows it is linked with, the
    smallest key reachable, and whether that is its own.

    Links are pairs of cosine ``least`` or more in double precision; none below is linked.  Vectors
    that are null, zero, of another length than most, or hold null or non-finite components have no
    links.  Equal vectors are linked with each other.  Centres are fitted on at most ``sample`` vectors drawn by
    a seeded hash; all vectors are indexed.  No link is lost: centres, ``cells`` and ``sample`` decide the
    work, not the result.  ``probes`` is of no effect any more.  Rows that share a key are vectors of
    their own under one name.  An empty input has no rows.
    """
    spark = vectors.sparkSession
    where = C.shared_dir(spark, "vectors")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    width = (rows.filter("v is not null").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first() or [0])[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS_AT_ONCE):
                part = b.slice(at, _ROWS_AT_ONCE)
                unit, ok = _unit(part.column(1).to_pylist(), width)
                blobs = [u.tobytes() if good else None for u, good in zip(unit, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["key", "unit"])

    marked = C.durable(rows.mapInArrow(C.tidy(mark), "key long, unit binary"), "vectors", f"{where}/units")
    usable = marked.filter("unit is not null and key is not null")
    nodes = usable.groupBy("unit").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    nodes = C.durable(nodes.select(F.col("node"), "copies", "unit"), "vectors", f"{where}/nodes")
    total = nodes.count()
    # two different vectors may share a key; a node is one row of this table, named by key and vector
    named = nodes.withColumn("name", F.xxhash64("node", "unit"))

    drawn = nodes.select("unit").orderBy(F.xxhash64(F.lit(seed), "unit"), "unit").limit(sample).toArrow().column(0).to_pylist()
    x = np.array([np.frombuffer(u, dtype=np.float64) for u in drawn]).reshape(len(drawn), width)
    k = cells or max(1, min(4096, len(x) // 8, total // 200))
    sent = spark.sparkContext.broadcast(fit_centres(x, k, seed=seed) if len(x) else np.zeros((1, max(width, 1))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for b in batches:
            for at in range(0, b.num_rows, _ROWS_AT_ONCE):
                part = b.slice(at, _ROWS_AT_ONCE)
                unit = np.array([np.frombuffer(u, dtype=np.float64) for u in part.column(2).to_pylist()])
                own = (unit @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own)], ["name", "copies", "unit", "cell"])

    placed = C.durable(named.select("name", "copies", "unit").mapInArrow(C.tidy(assign), "name long, copies long, unit binary, cell int"), "vectors", f"{where}/placed")
    block = min(_MOST_BLOCK, max(_BLOCK, total // 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                unit = np.array([np.frombuffer(u, dtype=np.float64) for u in part.column(2).to_pylist()])
                i, j = _linked(unit, single := unit.astype(np.float32), np.arange(len(unit)), unit, single, least)
                label = _forest(len(unit), i, j)
                units = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), width)
                table = pa.table({"name": part.column(0), "copies": part.column(1), "unit": units, "cell": part.column(3), "label": pa.array(label)})

                def write(out, table: pa.Table = table) -> None:
                    with pa.ipc.new_file(out, table.schema) as w:
                        w.write_table(table)

                uri = f"{where}/blocks/{uuid.uuid4().hex}.arrow"
                C.put_file(uri, write)
                held = part.column(3).unique().to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(unit)], pa.int64()), pa.array([held], pa.list_(pa.int32()))], ["uri", "n", "cells"])

    sorted_nodes = placed.repartitionByRange(max(1, -(-total // (4 * block))), "cell", "name").sortWithinPartitions("cell", "name")
    written = C.durable(sorted_nodes.mapInArrow(C.tidy(cut), "uri string, n long, cells array<int>"), "vectors", f"{where}/written")
    # one row for each block; small ones, neighbours in the order of cells, are compared together
    groups, size = [], block
    for r in sorted(written.collect(), key=lambda r: (r.cells[0], r.cells[-1], r.uri)):
        if size + r.n > block:
            groups.append(([], set()))
            size = 0
        groups[-1][0].append(r.uri)
        groups[-1][1].update(r.cells)
        size += r.n
    listed = spark.sparkContext.broadcast([(uris, np.array(sorted(held))) for uris, held in groups])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, blocks = sent.value, listed.value
        for mine in (g for b in batches for g in b.column(0).to_pylist()):
            x = _load(blocks[mine][0])
            reached = reach(x["unit"], x["cell"], centres, least)
            within, count = reached.any(axis=0), np.zeros(len(x["name"]))
            out = []
            for g, (uris, held) in enumerate(blocks):
                if not within[held].any():
                    continue
                y = x if g == mine else _load(uris)
                found_i, found_j = [], []
                for cell in held[within[held]]:
                    cols, rows = np.flatnonzero(y["cell"] == cell), np.flatnonzero(reached[:, cell])
                    for at in range(0, len(rows), 1024):
                        i, j = _linked(x["unit"], x["single"], rows[at : at + 1024], y["unit"][cols], y["single"][cols], least)
                        j = cols[j]
                        if g == mine:
                            i, j = i[i != j], j[i != j]
                        count += np.bincount(i, weights=y["copies"][j], minlength=len(count))
                        if g >= mine:  # the other block finds the same links
                            pairs = np.unique(x["label"][i] * len(y["name"]) + y["label"][j])
                            found_i.append(pairs // len(y["name"]))
                            found_j.append(pairs % len(y["name"]) + (0 if g == mine else len(count)))
                if sum(map(len, found_i)):
                    names = x["name"] if g == mine else np.concatenate([x["name"], y["name"]])
                    label = _forest(len(names), np.concatenate(found_i), np.concatenate(found_j))
                    far = np.flatnonzero(label != np.arange(len(names)))
                    out.append((names[far], np.zeros(len(far), np.int64), names[label[far]]))
            hit = np.flatnonzero(count)
            out.append((x["name"][hit], count[hit].astype(np.int64), x["name"][x["label"][hit]]))
            for columns in out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "links", "to"])

    each = spark.range(0, len(groups), 1, max(1, min(len(groups), 10_000)))
    done = C.durable(each.mapInArrow(C.tidy(products), "name long, links long, to long"), "vectors", f"{where}/links")
    counts = done.groupBy("name").agg(F.sum("links").alias("links"))
    names = named.select("name", "node")
    edges = done.filter("name <> to").select("name", "to").distinct().join(names.select("name", F.col("node").alias("a")), "name").join(names.select(F.col("name").alias("to"), F.col("node").alias("b")), "to").select("a", "b")
    same_key = usable.select("key", "unit").distinct().join(nodes.select("unit", "node"), "unit").filter("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    # a key other than its node's matters to components only where the key has several vectors
    doubled = usable.select("key", "unit").distinct().groupBy(F.col("key").alias("a")).count().filter("count > 1").select("a")
    comps = C.durable(C.components(edges.unionByName(same_key.join(doubled, "a", "left_semi").select("a", "b"))), "vectors", f"{where}/comps")
    per_node = named.join(counts, "name", "left").join(comps.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("unit", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "node").alias("component"))
    per_node = C.durable(per_node.select(F.sha2("unit", 256).alias("u"), "links", "copies", "component"), "vectors", f"{where}/per-node")
    out = marked.withColumn("u", F.when(F.col("key").isNotNull(), F.sha2("unit", 256))).select("key", "u").join(per_node, "u", "left")
    return out.select(
        F.col("key").alias(key), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component_id"), F.coalesce(F.col("key") == F.coalesce("component", "key"), F.lit(True)).alias("kept")
    )


def op9_vector_cells(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
