"""Exact Shapley contributions of boosted trees.

For one leaf, the tree's value under a set S of known features is the leaf's prediction times, for
each feature on its path, 1 or 0 (whether the row passes the path's splits on it) if the feature is in
S, else the share of training rows that pass.  That game is a product, so its Shapley values are sums
over the subsets of the path's few features, and contributions add up over leaves and trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import exprs as X


@dataclass(frozen=True)
class Leaf:
    """``splits``: feature, threshold, whether the path goes left (value <= threshold), share of rows that do as it does."""

    value: float
    splits: tuple[tuple[int, float, bool, float], ...]


def leaves_of(model) -> list[Leaf]:
    """All leaves of a fitted booster, values in log odds."""
    out: list[Leaf] = []

    def walk(node, splits: tuple, weight: float) -> None:
        if node.subtreeDepth() == 0:
            out.append(Leaf(2.0 * weight * node.prediction(), splits))
            return
        split, left, right = node.split(), node.leftChild(), node.rightChild()
        n = node.impurityStats().count()
        for child, goes_left in ((left, True), (right, False)):
            walk(child, (*splits, (split.featureIndex(), split.threshold(), goes_left, child.impurityStats().count() / n)), weight)

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._java_obj.rootNode(), (), weight)
    return out


def contributions(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (rows, features) and the expected value; together they give each row's log odds."""
    phi, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        passes: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for f, threshold, left, part in leaf.splits:
            ok = (x[:, f] <= threshold) == left
            passes[f] = passes[f] & ok if f in passes else ok
            share[f] = share.get(f, 1.0) * part
        names = list(share)
        k = len(names)
        base += leaf.value * float(np.prod([share[f] for f in names]))
        for i in names:
            rest = [f for f in names if f != i]
            total = np.zeros(len(x))
            for size in range(k):
                weight = factorial(size) * factorial(k - size - 1) / factorial(k)
                for known in combinations(rest, size):
                    part = np.full(len(x), weight * float(np.prod([share[f] for f in rest if f not in known])))
                    for f in known:
                        part = part * passes[f]
                    total += part
            phi[:, i] += leaf.value * (passes[i] - share[i]) * total
    return phi, base


def explain(df: DataFrame, model, features: list[str], key: str = "gp_nr", top: int = 6) -> DataFrame:
    """(key, contributions): the ``top`` features by magnitude as tanh(value / 2); nulls as in training."""
    leaves = leaves_of(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            phi, _ = contributions(leaves, f[features].to_numpy(dtype=float))
            yield pd.DataFrame({key: f[key], "raw": [[{"feature": n, "value": float(v)} for n, v in zip(features, row, strict=True)] for row in phi]})

    rows = df.select(key, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-999.0)).alias(c) for c in features])
    raw = rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, raw array<struct<feature:string,value:double>>")
    return raw.select(key, X.top_contributions("raw", top).alias("contributions"))
