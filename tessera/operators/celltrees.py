"""Decision trees and random forests for classes, grown as MLlib grows them, on counted cells.

MLlib cuts a column at no more than ``maxBins`` - 1 places, fixed before the first tree, and then reads all rows for
every level of every group of nodes. Rows with equal bins and class take the same way through any tree, so here they
are counted once (``cells``) and the levels read the counts. The rules are MLlib's: its choice of cuts, impurity and
gain in its order of arithmetic, the first of equal gains, least rows a child, leaves of one answer merged. A forest's
tree draws how often each cell is taken from a Poisson distribution with the cell's rows as mean - the sum of the
draws MLlib makes for each row - and its columns for every node; trees are grown side by side on the executors.

The result is MLlib's own model: nodes are written in its file format, and it is loaded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import cells

EPSILON = 2.0 ** -52
#: numbers of one table of sums
SUMS = 1 << 22


def impurity(stats: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(impurity, weight) of class weights in the last axis."""
    total = stats.sum(-1)
    out = np.full(total.shape, 1.0 if kind == "gini" else 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(stats.shape[-1]):
            f = stats[..., k] / total
            out = out - (f * f if kind == "gini" else np.where(stats[..., k] > 0, f * (np.log(f) / math.log(2)), 0.0))
    return np.where(total > 0, out, 0.0), total


class Grown:
    """Nodes as columns in order of levels; feature -1 is a leaf. A row goes left if its bin is at most ``cut``."""

    def __init__(self, root: np.ndarray, rows: float, kind: str):
        self.kind, self.stats, self.rows = kind, [root], [rows]
        self.feature, self.cut, self.gain, self.left = [-1], [0], [-1.0], [-1]

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, left_rows: float) -> int:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        self.stats += [left, self.stats[node] - left]
        self.rows += [left_rows, self.rows[node] - left_rows]
        for col, x in ((self.feature, -1), (self.cut, 0), (self.gain, -1.0), (self.left, -1)):
            col += [x, x]
        return self.left[node]

    def predictions(self) -> np.ndarray:
        return np.argmax(np.array(self.stats), 1)

    def pruned(self) -> None:
        """Two leaves of one answer become one."""
        answer = self.predictions()
        for i in reversed(range(len(self.feature))):
            at = self.left[i]
            if at >= 0 and self.left[at] < 0 and self.left[at + 1] < 0 and answer[at] == answer[at + 1]:
                self.feature[i], self.left[i], self.gain[i] = -1, -1, -1.0

    def nodes(self) -> Iterator[tuple]:
        """(id, prediction, impurity, class weights, rows, gain, left, right, feature, cut) of the nodes in use, parents first."""
        used = [0]
        for i in used:
            if self.left[i] >= 0:
                used += [self.left[i], self.left[i] + 1]
        used.sort()
        new, answer, stats = {old: i for i, old in enumerate(used)}, self.predictions(), np.array(self.stats, float)
        bad = impurity(stats, self.kind)[0]
        for i in used:
            inner = self.left[i] >= 0
            left, right = (new[self.left[i]], new[self.left[i] + 1]) if inner else (-1, -1)
            yield (new[i], float(answer[i]), float(bad[i]), stats[i].tolist(), int(self.rows[i]), float(self.gain[i]), left, right,
                   self.feature[i], self.cut[i])


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, sizes: Sequence[int], k: int, max_depth: int, min_rows: int = 1,
         kind: str = "gini", per_node: int | None = None, rng: np.random.Generator | None = None, way: list | None = None) -> Grown:
    """A tree from cells with class ``y``, weight ``w`` and number of rows. ``sizes``: bins of each column. ``way`` gets the
    node of every cell after each level, of cells without rows, too."""
    tree = Grown(np.bincount(y, w, k), rows.sum(), kind)
    at, active, level = np.zeros(len(y), np.int64), [0], 0
    counts = rows > 0
    weighted = w is not rows
    while active and level < max_depth:
        place = np.full(len(tree.feature), -1)
        place[active] = np.arange(len(active))
        slot, after = place[at], []
        some = max(1, SUMS // (max(sizes) * k))
        for low in range(0, len(active), some):
            part = active[low:low + some]
            on = np.flatnonzero(counts & (slot >= low) & (slot < low + len(part)))
            stats = np.array([tree.stats[i] for i in part])
            own = impurity(stats, kind)[0]
            best = np.full(len(part), -np.inf)
            found: list = [None] * len(part)
            allowed = None if per_node is None or per_node >= len(sizes) else np.argsort(np.argsort(rng.random((len(part), len(sizes))), 1), 1) < per_node
            for j, size in enumerate(sizes):
                if size < 2:
                    continue
                cell = ((slot[on] - low) * size + bins[on, j]) * k + y[on]
                left = np.bincount(cell, w[on], len(part) * size * k).reshape(len(part), size, k).cumsum(1)[:, :-1]
                left_rows = left.sum(2) if not weighted else np.bincount(cell // k, rows[on], len(part) * size).reshape(len(part), size).cumsum(1)[:, :-1]
                right = stats[:, None] - left
                all_rows = np.array([tree.rows[i] for i in part])
                (bad_l, n_l), (bad_r, n_r) = impurity(left, kind), impurity(right, kind)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = own[:, None] - n_l / (n_l + n_r) * bad_l - n_r / (n_l + n_r) * bad_r
                ok = (left_rows >= min_rows) & (all_rows[:, None] - left_rows >= min_rows)
                if allowed is not None:
                    ok &= allowed[:, j, None]
                gain = np.where(ok, gain, -np.inf)
                cut = gain.argmax(1)
                top = gain[np.arange(len(part)), cut]
                for i in np.flatnonzero(top > best):
                    best[i], found[i] = top[i], (j, int(cut[i]), left[i, cut[i]], left_rows[i, cut[i]])
            for i, node in enumerate(part):
                if best[i] > 0:
                    j, cut, left, n_left = found[i]
                    a = tree.split(node, j, cut, float(best[i]), left, n_left)
                    after += [a, a + 1]
        if after:
            feature, cut, first = (np.array(x) for x in (tree.feature, tree.cut, tree.left))
            inner = (first[at] >= 0) & (slot >= 0)
            here = at[inner]
            at = at.copy()
            at[inner] = first[here] + (bins[inner, feature[here]] > cut[here])
        level += 1
        if way is not None:
            way.append(at)
        if after:
            pure = impurity(np.array([tree.stats[i] for i in after]), kind)[0] < EPSILON
            after = [i for i, p in zip(after, pure, strict=True) if not p]
        active = after
    return tree


class Counted:
    """Cells of rows (label, features), with MLlib's cuts of each feature in the rows of ``train``; other rows are counted apart."""

    def __init__(self, est, rows: DataFrame, train: Column | None = None):
        kept = rows if train is None else rows.where(train)
        first = kept.select("features").first()
        self.found = None
        if first is None:
            return
        d = self.n_features = first[0].size
        cols = [f"x{j}" for j in range(d)]
        a = vector_to_array("features")
        wide = [*(a[j].alias(c) for j, c in enumerate(cols)), F.col("label").cast("double").alias("y")]
        numbers = kept.select(*wide)
        n, self.k, whole, binary = cells.look(numbers, cols, "y")
        if not whole or self.k < 2:
            return
        n_splits, share, self.edges = min(est.getMaxBins(), n) - 1, cells.fraction(n, est.getMaxBins()), []
        for x, two in zip(cells.sampled(numbers.select(*cols), share, est.getSeed()), binary, strict=True):
            v, c = np.unique(x, return_counts=True)
            self.edges.append(np.array([0.5]) if two else cells.cuts(v, c.astype(float), n_splits, share * n, len(x)))
        held = (F.lit(0) if train is None else (~train).cast("int")).alias("held")
        found = cells.counted(rows.select(*wide, held), cols, self.edges, [("y", self.k), ("held", 2)])
        if found is None:
            return
        self.bins, (self.y, held), self.rows, _ = found
        self.train = np.where(held == 0, self.rows, 0).astype(float)
        self.held = np.where(held == 1, self.rows, 0)
        self.sizes = [len(e) + 1 for e in self.edges]
        self.found = True


def known(est) -> bool:
    """Whether the rules here are all that the estimator asks for."""
    forest = type(est) is RandomForestClassifier
    if not forest and type(est) is not DecisionTreeClassifier:
        return False
    if forest and (est.getFeatureSubsetStrategy() != "auto" or est.getSubsamplingRate() != 1.0 or not est.getBootstrap()):
        return False
    return not est.isSet("weightCol") and est.getMinInfoGain() == 0 and est.getMinWeightFractionPerNode() == 0 and not est.getLeafCol()


NODES = "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, feature int, threshold double"


def fit(est, rows: DataFrame):
    """The model that ``est`` fits on rows with label and features, or None where it is to be fitted by MLlib: other
    parameters than those known here, missing numbers, or too many cells."""
    c = Counted(est, rows) if known(est) else None
    if c is None or c.found is None:
        return None
    spark = rows.sparkSession
    forest = isinstance(est, RandomForestClassifier)
    n_trees = est.getNumTrees() if forest else 1
    per_node = math.ceil(math.sqrt(c.n_features)) if n_trees > 1 else None
    depth, least, kind, seed = est.getMaxDepth(), est.getMinInstancesPerNode(), est.getImpurity(), est.getSeed() & (1 << 63) - 1
    shared = spark.sparkContext.broadcast((c.bins, c.y, c.train, c.sizes, c.k, c.edges))

    def run(batches):
        bins, y, n, sizes, k, edges = shared.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, t])
                w = rng.poisson(n).astype(float) if forest else n
                tree = grow(bins, y, w, w, sizes, k, depth, least, kind, per_node, rng)
                tree.pruned()
                of = [(t, *x[:-1], float(edges[x[-2]][x[-1]]) if x[-2] >= 0 else 0.0) for x in tree.nodes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, a) for x, a in zip(zip(*of, strict=True), _ARROW, strict=True)], names=_NAMES)

    made = spark.range(0, n_trees, 1, n_trees).mapInArrow(run, NODES)
    inner = F.col("feature") >= 0
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories")).alias("split")
    node = [*(F.col(x) for x in _NAMES[1:9]), split]
    # a model of two points gives the parameters and classes; its nodes are replaced
    zero = Vectors.dense([0.0] * c.n_features)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model = est.fit(spark.createDataFrame([(float(i), zero) for i in range(max(c.k, 2))], ["label", "features"]))
    model.write().save(path)
    (made.select("treeID", F.struct(*node).alias("nodeData")) if forest else made.select(*node).coalesce(1)).write.mode("overwrite").parquet(f"{path}/data")
    shared.unpersist()
    return type(model).load(path)


_NAMES = [x.split()[0] for x in NODES.split(", ")]
_ARROW = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[x.split()[1]] for x in NODES.split(", ")]


def fold_accuracy(est, maps: Sequence[dict], rows: DataFrame, train: Column) -> list[float] | None:
    """Accuracy on the other rows of the tree of each candidate, fitted on the rows of ``train``; None as with ``fit``.
    Trees that differ in depth alone are one tree, read at that depth."""
    if type(est) is not DecisionTreeClassifier or {p.name for m in maps for p in m} - {"maxDepth", "minInstancesPerNode", "impurity"} or not known(est):
        return None
    c = Counted(est, rows, train)
    if c.found is None:
        return None
    each = [est.copy(m) for m in maps]
    grown: dict = {}
    for e in each:
        key = (e.getMinInstancesPerNode(), e.getImpurity())
        grown[key] = max(grown.get(key, 0), e.getMaxDepth())
    right: dict = {}
    for (least, kind), depth in grown.items():
        way = [np.zeros(len(c.y), np.int64)]
        answer = grow(c.bins, c.y, c.train, c.train, c.sizes, c.k, depth, least, kind, way=way).predictions()
        right[least, kind] = [float(c.held[answer[at] == c.y].sum()) for at in way]
    total = c.held.sum()
    found = [(right[e.getMinInstancesPerNode(), e.getImpurity()], e.getMaxDepth()) for e in each]
    return [r[min(d, len(r) - 1)] / total if total else float("nan") for r, d in found]
