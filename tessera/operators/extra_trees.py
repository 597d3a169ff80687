"""Extremely randomised trees (E9): every node cuts random features at random places.

All trees of a group grow together, a level in one job: for cuts drawn uniformly between the least
and greatest value of a feature in a node, the sums on the left side, and the extremes on both
sides, which are those of the nodes to come (with many features, in a second job). Tasks sum up their own rows by (tree, node, feature); Spark adds these cells. A node
draws ``max_features`` of the features that are not constant in it (all, for a number to
predict) and keeps the cut that lowers impurity most (Gini, or variance). Draws follow from
(seed, tree, node), so a model reproduces itself. Nodes end when they are pure, hold fewer than
``min_samples_split`` rows, or reach ``max_depth``; every row takes part in every tree.

The driver holds the trees. ``max_nodes`` bounds a tree's nodes and with it that memory: open
nodes beyond it stay leaves. A depth of None is ``DEEPEST``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .models import gathered

SEED = 42
DEEPEST = 64


class RandomTree:
    """Growing columns of nodes; feature -1 is a leaf. Values up to the threshold go left."""

    def __init__(self, total: np.ndarray):
        self.feature, self.threshold, self.left, self.total = [-1], [0.0], [0], [total]

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray) -> list[int]:
        at = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, at
        for total in (left, self.total[node] - left):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(0)
            self.total.append(total)
        return [at, at + 1]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left)


def node_of(arrays: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, left = arrays
    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[node]
        on = f >= 0
        if not on.any():
            return node
        node = np.where(on, left[node] + (x[row, np.maximum(f, 0)] > threshold[node]), node)


def sums_of(y: np.ndarray, n_classes: int) -> np.ndarray:
    """What a node adds up: rows by class, or (rows, y, y * y)."""
    return (y[:, None] == np.arange(n_classes)).astype(float) if n_classes else np.stack([np.ones(len(y)), y, y * y], 1)


def impurity(total: np.ndarray, n_classes: int) -> np.ndarray:
    """Gini impurity or variance times the number of rows, of totals in the last axis."""
    if n_classes:
        n = total.sum(-1)
        return n - (total ** 2).sum(-1) / np.maximum(n, 1)
    return np.maximum(total[..., 2] - total[..., 1] ** 2 / np.maximum(total[..., 0], 1), 0)


class ExtraTreesModel:
    def __init__(self, features: list[str], n_classes: int, trees: list[RandomTree]):
        self.features, self.n_classes = features, n_classes
        self.trees = [(t.arrays(), self._values(t)) for t in trees]

    def _values(self, tree: RandomTree) -> np.ndarray:
        total = np.array(tree.total)
        return total / np.maximum(total.sum(1, keepdims=True), 1) if self.n_classes else total[:, 1:2] / np.maximum(total[:, :1], 1)

    def mean(self, x: np.ndarray) -> np.ndarray:
        return sum(value[node_of(arrays, x)] for arrays, value in self.trees) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds raw (class probabilities, or the mean), prediction and, for two classes, probability_1."""
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.mean(np.stack(x.to_list()).astype(float)))) if len(x) else pd.Series([], dtype=object)

        out = df.withColumn("raw", F.pandas_udf(score, "array<double>")(F.array(*(F.col(c).cast("double") for c in self.features))))
        if not self.n_classes:
            return out.withColumn("prediction", F.col("raw")[0])
        out = out.withColumn("prediction", (F.array_position("raw", F.array_max("raw")) - 1).cast("double"))
        return out.withColumn("probability_1", F.col("raw")[1]) if self.n_classes == 2 else out

    def importance(self) -> np.ndarray:
        """Share of each feature in the cuts."""
        n = np.bincount(np.concatenate([a[0][a[0] >= 0] for a, _ in self.trees]), minlength=len(self.features))
        return n / max(1, n.sum())


def _rows(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([batch.column(j).to_numpy() for j in range(n_features)], 1), batch.column(n_features).to_numpy()


def _at(trees: list, places: list[np.ndarray], x: np.ndarray):
    """(rows, their place) of every tree that has rows of x in an open node, rows by place."""
    for arrays, place in zip(trees, places, strict=True):
        at = place[node_of(arrays, x)]
        row = np.flatnonzero(at >= 0)
        if len(row):
            row = row[np.argsort(at[row], kind="stable")]
            yield row, at[row]


def _ranges(rows: DataFrame, trees: list, places: list[np.ndarray], n_features: int) -> pd.DataFrame:
    """(place, f, lo, hi) of every feature in every open node."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = _rows(batch, n_features)
            for row, at in _at(trees, places, x):
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                lo, hi = (op.reduceat(x[row], begin, axis=0).ravel() for op in (np.minimum, np.maximum))
                cols = [np.repeat(at[begin], n_features), np.tile(np.arange(n_features), len(begin)), lo, hi]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["place", "f", "lo", "hi"])

    made = rows.mapInArrow(run, "place long, f long, lo double, hi double")
    return made.groupBy("place", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()


#: values that a task keeps a node for the extremes on both sides of its cuts; with more, they take a job of their own
EXTREMES = 64


def _left_sums(rows: DataFrame, trees: list, places: list[np.ndarray], cuts: tuple[np.ndarray, np.ndarray], n_features: int, n_classes: int,
               n_sums: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of the rows left of every cut, places x cuts x sums, and the extremes of every feature on both sides,
    places x cuts x (left, right) x (least, greatest) x features: the ranges of the nodes to come."""
    feature, threshold = cuts
    n_cuts = feature.shape[1]
    extremes = 4 * n_features * n_cuts <= EXTREMES
    names = [f"{side}{op}{j}" for side in "lr" for op in ("lo", "hi") for j in range(n_features)] if extremes else []

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _rows(batch, n_features)
            s = sums_of(y, n_classes)
            for row, at in _at(trees, places, x):
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                left = x[row[:, None], np.maximum(feature[at], 0)] <= threshold[at]  # rows x cuts
                total = np.add.reduceat(left[:, :, None] * s[row][:, None, :], begin, axis=0)
                cell = at[begin][:, None] * n_cuts + np.arange(n_cuts)
                cols = [cell.ravel(), *(total[:, :, i].ravel() for i in range(n_sums))]
                for side in (left, ~left) if extremes else ():
                    for op, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                        cols += [op.reduceat(np.where(side, x[row, j, None], none), begin, axis=0).ravel() for j in range(n_features)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", *(f"s{i}" for i in range(n_sums)), *names])

    made = rows.mapInArrow(run, "cell long" + "".join(f", {c} double" for c in [*(f"s{i}" for i in range(n_sums)), *names]))
    got = made.groupBy("cell").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n_sums)),
                                   *((F.min if c[1:3] == "lo" else F.max)(c).alias(c) for c in names)).toPandas()
    out = np.zeros((len(feature) * n_cuts, n_sums + len(names)))
    out[got["cell"].to_numpy()] = got.drop(columns="cell").to_numpy()
    out = out.reshape(len(feature), n_cuts, -1)
    return out[:, :, :n_sums], out[:, :, n_sums:].reshape(len(feature), n_cuts, 2, 2, n_features) if extremes else None


def draws(seed: int, tree: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """n numbers in [0, 1) for each node: hashes of (seed, tree, node, place)."""
    h = (np.asarray(tree, np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.asarray(node, np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
         + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(seed))
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2 ** 53


def chosen_cuts(draw: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, thresholds), nodes x n: those with the least draws among features that are not constant,
    cut uniformly between the extremes; -1 where there are fewer."""
    rank = np.where(hi > lo, draw[:, :lo.shape[1]], np.inf)
    f = np.argsort(rank, axis=1, kind="stable")[:, :n]
    at = np.arange(len(lo))[:, None]
    # a cut below the greatest value leaves a row on each side
    cut = np.minimum(lo[at, f] + draw[at, lo.shape[1] + f] * (hi[at, f] - lo[at, f]), np.nextafter(hi[at, f], -np.inf))
    some = np.isfinite(rank[at, f])
    return np.where(some, f, -1), np.where(some, cut, -np.inf)


def _grow(rows: DataFrame, numbers: range, total: np.ndarray, n_features: int, n_classes: int, p: dict) -> list[RandomTree]:
    trees = [RandomTree(total) for _ in numbers]

    def may_split(totals: np.ndarray, depth: np.ndarray) -> np.ndarray:
        n = totals.sum(1) if n_classes else totals[:, 0]
        return (depth < p["max_depth"]) & (impurity(totals, n_classes) > 1e-9) & (n >= p["min_samples_split"])

    k, node = np.arange(len(trees)), np.zeros(len(trees), np.int64)
    here, depth = np.tile(total, (len(trees), 1)), np.zeros(len(trees), np.int64)
    ranges = None  # nodes x (least, greatest) x features, where the job of the level above has told them
    while True:
        on = may_split(here, depth)
        k, node, here, depth = k[on], node[on], here[on], depth[on]
        if not len(k):
            return trees
        places = [np.full(len(t.feature), -1) for t in trees]
        for t in range(len(trees)):
            places[t][node[k == t]] = np.flatnonzero(k == t)
        arrays = [t.arrays() for t in trees]
        if ranges is None:
            r = _ranges(rows, arrays, places, n_features)
            lo, hi = np.zeros((2, len(k), n_features))
            for out, c in ((lo, "lo"), (hi, "hi")):
                out[r["place"], r["f"]] = r[c]
        else:
            lo, hi = ranges[on, 0], ranges[on, 1]
        draw = draws(p["seed"], np.array(numbers)[k], node, 2 * n_features)
        feature, threshold = chosen_cuts(draw, lo, hi, p["max_features"])
        left, sides = _left_sums(rows, arrays, places, (feature, threshold), n_features, n_classes, len(total))
        lower = impurity(left, n_classes) + impurity(here[:, None, :] - left, n_classes)
        best = np.where(feature >= 0, lower, np.inf).argmin(1)
        at = np.arange(len(k))
        f, cut, left = feature[at, best], threshold[at, best], left[at, best]
        after = []
        for i in np.flatnonzero(f >= 0).tolist():
            t = trees[k[i]]
            if len(t.feature) + 2 <= p["max_nodes"]:
                after.append((i, t.split(int(node[i]), int(f[i]), float(cut[i]), left[i])[0]))
        i, child = (np.array(x, np.int64) for x in (zip(*after) if after else ((), ())))
        k, depth = np.repeat(k[i], 2), np.repeat(depth[i] + 1, 2)
        node = (child[:, None] + np.arange(2)).ravel()
        here = np.stack([left[i], here[i] - left[i]], 1).reshape(-1, len(total))
        ranges = sides[i, best[i]].reshape(-1, 2, n_features) if sides is not None else None


def extra_trees(df: DataFrame, features: Sequence[str], label: str, task: str = "classification", n_estimators: int = 100,
                max_depth: int | None = None, min_samples_split: int = 2, max_features: int | None = None, max_nodes: int = 1 << 16,
                trees_at_once: int = 25, seed: int = SEED) -> ExtraTreesModel:
    """Fit on rows with numeric ``features`` and a label (0, 1, ... for classes); rows with a null are left out."""
    features = list(features)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)), F.col(label).cast("double").alias("y")).dropna().persist()
    kept, rows = rows, gathered(rows)
    if task == "classification":
        count = {int(r[0]): r[1] for r in rows.groupBy("y").count().collect()}  # one row a class
        n_classes = max([1, *count]) + 1
        total = np.array([float(count.get(k, 0)) for k in range(n_classes)])
    else:
        n_classes = 0
        total = np.array(rows.agg(F.count("y").cast("double"), F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(F.col("y") ** 2), F.lit(0.0))).first(), float)
    p = dict(max_depth=DEEPEST if max_depth is None else max_depth, min_samples_split=min_samples_split, max_nodes=max_nodes, seed=seed,
             max_features=max_features or (max(1, int(math.sqrt(len(features)))) if n_classes else len(features)))
    trees: list[RandomTree] = []
    for first in range(0, n_estimators, trees_at_once):
        trees += _grow(rows, range(first, min(n_estimators, first + trees_at_once)), total, len(features), n_classes, p)
    kept.unpersist()
    return ExtraTreesModel(features, n_classes, trees)
