"""Gradient boosting on histograms (E11), for one number, two classes or many.

Every feature is cut into at most ``max_bins`` bins once. A tree is grown a level (or a set
of leaves) a job: each task sums gradients and curvatures of its rows by (class, node,
feature, bin), Spark adds the cells up, running sums over a feature's bins give the gain of
every cut, and the best cut of a node - a few numbers - comes to the driver. All classes'
trees of a round grow in the same jobs. Rows keep their raw scores, which a finished
tree updates in one pass; lineage is cut by a checkpoint every few rounds.

Three ways of growing, under the names their users know:

* ``xgboost`` (``growth="level"``): all nodes of a level, down to ``max_depth``.
* ``lightgbm`` (``growth="leaf"``): the leaf with the largest gain first, to ``num_leaves``
  leaves. A job evaluates the children that every open leaf would have, so the order is
  exact and takes about as many jobs as the tree has levels.
* ``catboost`` (``growth="symmetric"``): one cut for a whole level, the best in sum.

Defaults are those the three libraries document where they apply here; results follow the
same formulas but are not theirs bit by bit (cuts are quantiles, ties go to the first feature).
The driver holds the trees and one row a node; cells a task sums up densely are bounded by
``DENSE_CELLS``, beyond which it passes on sparse cells of each batch.

Rows that share all bins (and class) have one raw score in every round, so where such groups are few
(``cells.MOST``) they are counted in one pass and all rounds grow on the counts (``CellGrower``): the
same sums, no more jobs. With more of them, or with rows drawn for each round, every set of nodes is a job.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import cells

SEED = 42
DENSE_CELLS = 1 << 22

#: parameters by name: fixed values, the libraries' documented defaults
STYLES = {
    "xgboost": dict(growth="level", learning_rate=0.3, max_depth=6, l2=1.0, min_child_weight=1.0, min_rows=1, max_bins=256),
    "lightgbm": dict(growth="leaf", learning_rate=0.1, num_leaves=31, l2=0.0, min_child_weight=1e-3, min_rows=20, max_bins=255),
    "catboost": dict(growth="symmetric", learning_rate=0.1, max_depth=6, l2=3.0, min_child_weight=0.0, min_rows=1, max_bins=254),
}


@dataclass
class Tree:
    """Nodes as columns; feature -1 is a leaf. A row goes left if its bin is at most ``cut``."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        """Number of the left child; the right one follows."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for col, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            col += [x, x]
        return self.left[node]

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(x) for x in (self.feature, self.cut, self.left))
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[node]
            on = f >= 0
            if not on.any():
                return node
            node = np.where(on, left[node] + (bins[row, np.maximum(f, 0)] > cut[node]), node)


def derivatives(raw: np.ndarray, y: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss, rows x outputs."""
    if task == "regression":
        return raw - y[:, None], np.ones_like(raw)
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        return p - y[:, None], p * (1 - p)
    p = probabilities(raw)
    return p - (y[:, None] == np.arange(raw.shape[1])), 2 * p * (1 - p)


def probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw[:, 0]))
        return np.stack([1 - p, p], 1)
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: bin b holds edges[b - 1] < x <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8)


class BoostedModel:
    """Trees by round and output; ``transform`` adds raw, prediction and class probabilities."""

    def __init__(self, task: str, features: list[str], edges: list[np.ndarray], base: list[float]):
        self.task, self.features, self.edges, self.base = task, features, edges, base
        self.rounds: list[list[Tree]] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Rows that share all bins are scored once."""
        bins, to = binned(x, self.edges), slice(None)
        if 0 < bins.shape[1] <= 7:  # bins as one number
            _, first, to = np.unique(bins @ (1 << 8 * np.arange(bins.shape[1])), return_index=True, return_inverse=True)
            bins = bins[first]
        out = np.tile(np.array(self.base), (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.node_of(bins)]
        return out[to]

    def transform(self, df: DataFrame) -> DataFrame:
        def score(*x: pd.Series) -> pd.Series:
            return pd.Series(list(self.raw(np.stack([c.to_numpy(float) for c in x], 1)))) if len(x[0]) else pd.Series([], dtype=object)

        out = df.withColumn("raw", F.pandas_udf(score, "array<double>")(*(F.col(c).cast("double") for c in self.features)))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("raw")[0])
        if len(self.base) == 1:
            p = 1 / (1 + F.exp(-F.col("raw")[0]))
            return out.withColumn("probability_1", p).withColumn("prediction", (F.col("raw")[0] > 0).cast("double"))
        return out.withColumn("prediction", (F.array_position("raw", F.array_max("raw")) - 1).cast("double"))

    def importance(self) -> np.ndarray:
        """Share of each feature in the cuts."""
        n = np.bincount([f for trees in self.rounds for t in trees for f in t.feature if f >= 0], minlength=len(self.features))
        return n / max(1, n.sum())


def quantile_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: its distinct quantiles, one pass over all features."""
    qs = [float(i) / max_bins for i in range(1, max_bins)]
    r = df.agg(*(F.percentile_approx(F.col(c).cast("double"), qs, 20 * max_bins).alias(f"q{j}") for j, c in enumerate(features)),
               *(F.max(F.col(c).cast("double")).alias(f"m{j}") for j, c in enumerate(features))).first()
    return [np.array(sorted({v for v in r[f"q{j}"] or [] if v < r[f"m{j}"]})) for j in range(len(features))]


class Grower:
    """Finds the best cuts of nodes of the growing trees, a job for each set of nodes."""

    def __init__(self, rows: DataFrame, n_features: int, task: str, p: dict):
        self.rows, self.n_features, self.task, self.p = rows, n_features, task, p

    def cells(self, trees: list[Tree], nodes: list[tuple[int, int]], columns: np.ndarray, keep) -> DataFrame:
        """Sums (k, node, f, b, g, h, n) of the rows in ``nodes`` = [(output, node)]."""
        n_f, n_b, task = self.n_features, self.p["max_bins"], self.task
        place = [np.full(len(t.feature), -1) for t in trees]
        for i, (k, node) in enumerate(nodes):
            place[k][node] = i
        n_cells = len(nodes) * len(columns) * n_b
        names = ["k", "node", "f", "b", "g", "h", "n"]

        def emit(cell: np.ndarray, g, h, n) -> pa.RecordBatch:
            node, rest = np.divmod(cell, len(columns) * n_b)
            of = np.array(nodes).reshape(-1, 2)[node]
            cols = [of[:, 0], of[:, 1], columns[rest // n_b], rest % n_b, g, h, n]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64 if i in (4, 5) else np.int64)) for i, c in enumerate(cols)], names=names)

        def run(batches):
            dense = n_cells <= DENSE_CELLS
            total = np.zeros((3, n_cells)) if dense else None
            for batch in batches:
                bins, raw, y, draw = unpacked(batch, n_f)
                g, h = derivatives(raw, y, task)
                used = keep(draw)
                for k, tree in enumerate(trees):
                    at = place[k][tree.node_of(bins)]
                    on = (at >= 0) & used
                    if not on.any():
                        continue
                    cell = ((at[on, None] * len(columns) + np.arange(len(columns))) * n_b + bins[on][:, columns]).ravel()
                    gs, hs = (np.repeat(v[on, k], len(columns)) for v in (g, h))
                    if dense:
                        total[0] += np.bincount(cell, gs, n_cells)
                        total[1] += np.bincount(cell, hs, n_cells)
                        total[2] += np.bincount(cell, minlength=n_cells)
                    else:
                        some, to = np.unique(cell, return_inverse=True)
                        yield emit(some, np.bincount(to, gs), np.bincount(to, hs), np.bincount(to))
            if dense:
                some = np.flatnonzero(total[2])
                if len(some):
                    yield emit(some, *total[:, some])

        made = self.rows.mapInArrow(run, "k long, node long, f long, b long, g double, h double, n long")
        if self.p["growth"] != "symmetric":
            made = made.repartition("k", "node")  # the one shuffle: tasks send a row a cell, and all that follows is by node
        return made.groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))

    def best(self, trees, nodes, columns, keep) -> dict:
        """By (output, node): gain (None without a cut), f, b and the sums left and in all. With symmetric growth
        all nodes of an output get the cut that is best in sum."""
        of = Window.partitionBy("k", "node", "f")
        upto = of.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        c = self.cells(trees, nodes, columns, keep).select(
            "k", "node", "f", "b", *(F.sum(x).over(upto).alias(f"l{x}") for x in "ghn"), *(F.sum(x).over(of).alias(f"t{x}") for x in "ghn"))
        rg, rh, rn = (F.col(f"t{x}") - F.col(f"l{x}") for x in "ghn")
        l2, mcw, rows = (F.lit(self.p[k]) for k in ("l2", "min_child_weight", "min_rows"))
        score = lambda g, h: g * g / (h + l2)
        ok = (F.col("lh") >= mcw) & (rh >= mcw) & (F.col("ln") >= rows) & (rn >= rows) & (rn > 0) & (F.col("lh") + l2 > 0) & (rh + l2 > 0)
        c = c.withColumn("gain", F.when(ok, score(F.col("lg"), F.col("lh")) + score(rg, rh) - score(F.col("tg"), F.col("th"))))
        if self.p["growth"] == "symmetric":
            return self._symmetric(c, nodes)
        first = F.struct("gain", -F.col("f"), -F.col("b"))
        found = c.groupBy("k", "node").agg(
            F.max_by(F.struct("gain", "f", "b", "lg", "lh", "ln"), F.when(F.col("gain").isNotNull(), first)).alias("s"),
            *(F.first(f"t{x}").alias(f"t{x}") for x in "ghn")).collect()
        return {(r["k"], r["node"]): {**(r["s"].asDict() if r["s"] else {"gain": None}), "tg": r["tg"], "th": r["th"], "tn": r["tn"]} for r in found}

    def _symmetric(self, c: DataFrame, nodes) -> dict:
        """A bin without rows of a node has no cell of it: the sums left of a cut are those of the last cell before."""
        c = c.persist()  # read by both collects, several times
        cuts = c.select("k", "f", "b").distinct()
        of_node = c.select("k", "node", *(f"t{x}" for x in "ghn")).distinct()
        totals = {(r["k"], r["node"]): r for r in of_node.groupBy("k", "node").agg(*(F.max(f"t{x}").alias(f"t{x}") for x in "ghn")).collect()}
        grid = cuts.join(c.select("k", "node").distinct(), "k")
        last = Window.partitionBy("k", "node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        full = grid.join(c, ["k", "node", "f", "b"], "left").select(
            "k", "node", "f", "b", *(F.coalesce(F.last(f"l{x}", True).over(last), F.lit(0)).alias(f"l{x}") for x in "ghn"),
            *(F.max(f"t{x}").over(Window.partitionBy("k", "node")).alias(f"t{x}") for x in "ghn"))
        rg, rh = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")
        l2 = F.lit(self.p["l2"])
        score = lambda g, h: F.when(h + l2 > 0, g * g / (h + l2)).otherwise(0.0)
        full = full.withColumn("gain", score(F.col("lg"), F.col("lh")) + score(rg, rh) - score(F.col("tg"), F.col("th")))
        by_cut = full.groupBy("k", "f", "b").agg(F.sum("gain").alias("sum"), F.sum("ln").alias("ln"), F.sum("tn").alias("tn"))
        by_cut = by_cut.where((F.col("ln") > 0) & (F.col("ln") < F.col("tn")))
        cut = by_cut.groupBy("k").agg(F.max_by(F.struct("f", "b"), F.struct("sum", -F.col("f"), -F.col("b"))).alias("s"), F.max("sum").alias("sum"))
        chosen = full.join(cut, "k").where((F.col("f") == F.col("s.f")) & (F.col("b") == F.col("s.b")))
        out = {(r["k"], r["node"]): {**{x: r[x] for x in ("f", "b", "lg", "lh", "ln", "tg", "th", "tn")}, "gain": r["sum"]} for r in chosen.collect()}
        c.unpersist()
        for key, r in totals.items():
            out.setdefault(key, {"gain": None, "tg": r["tg"], "th": r["th"], "tn": r["tn"]})
        return out

    def grow(self, n_outputs: int, columns: np.ndarray, keep) -> list[Tree]:
        """One tree an output, with leaf values times the learning rate."""
        trees, sums = [Tree() for _ in range(n_outputs)], {}
        pending = [(k, 0) for k in range(n_outputs)]
        by_leaf = self.p["growth"] == "leaf"
        known: dict = {}
        depth = 0
        while pending and (by_leaf or depth < self.p["max_depth"]):
            known |= self.best(trees, pending, columns, keep)
            after = []
            for k, node in pending:
                s = known.get((k, node), {"gain": None, "tg": 0.0, "th": 0.0, "tn": 0})
                known[k, node] = s
                sums.setdefault((k, node), (s["tg"], s["th"]))
                if s["gain"] is not None and s["gain"] > 1e-12:
                    left = trees[k].split(node, s["f"], s["b"])
                    sums[k, left], sums[k, left + 1] = (s["lg"], s["lh"]), (s["tg"] - s["lg"], s["th"] - s["lh"])
                    after += [(k, left), (k, left + 1)]
            depth += 1
            pending = after
            if by_leaf:
                wanted = [self._first(trees[k], known, k) for k in range(n_outputs)]
                pending = [(k, c) for k, (_, missing) in enumerate(wanted) for c in missing]
        for k, tree in enumerate(trees):
            if by_leaf:
                tree.feature = [f if i in self._first(tree, known, k)[0] else -1 for i, f in enumerate(tree.feature)]
            for node, f in enumerate(tree.feature):
                g, h = sums.get((k, node), (0.0, 0.0))
                tree.value[node] = -self.p["learning_rate"] * g / (h + self.p["l2"]) if f < 0 and h + self.p["l2"] > 0 else 0.0
        return trees

    def _first(self, tree: Tree, known: dict, k: int) -> tuple[set, list]:
        """(nodes cut so far, the largest gain first; children to evaluate before the next can be chosen)."""
        gain = lambda node: known.get((k, node), {"gain": None})["gain"]
        chosen, heap = set(), [(-(gain(0) or 0), 0)]
        while heap and len(chosen) < self.p["num_leaves"] - 1:
            g, node = heapq.heappop(heap)
            if tree.feature[node] < 0 or -g <= 1e-12:
                continue
            children = (tree.left[node], tree.left[node] + 1)
            chosen.add(node)
            if len(chosen) == self.p["num_leaves"] - 1:
                break
            if any((k, c) not in known for c in children):
                open_leaves = [node, *(n for _, n in heap if tree.feature[n] >= 0)]
                return chosen, [c for n in open_leaves for c in (tree.left[n], tree.left[n] + 1) if (k, c) not in known]
            for c in children:
                heapq.heappush(heap, (-(gain(c) or 0), c))
        return chosen, []


class CellGrower(Grower):
    """Finds the same cuts from counted cells: bins, rows and, for classes, y of each, or the sum of y."""

    def __init__(self, found, task: str, p: dict, base: list[float]):
        bins, groups, n, s = found
        super().__init__(None, bins.shape[1], task, p)
        self.bins, self.n, self.sum = bins, n.astype(float), s
        self.y = groups[0].astype(float) if groups else None
        self.raw = np.tile(np.array(base), (len(bins), 1))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures of all rows of a cell, cells x outputs."""
        if self.y is None:
            return self.n[:, None] * self.raw - self.sum[:, None], np.tile(self.n[:, None], (1, self.raw.shape[1]))
        g, h = derivatives(self.raw, self.y, self.task)
        return g * self.n[:, None], h * self.n[:, None]

    def best(self, trees, nodes, columns, keep) -> dict:
        g, h = self.sums()
        out, n_b, n_c = {}, self.p["max_bins"], len(columns)
        for k, tree in enumerate(trees):
            mine = [node for o, node in nodes if o == k]
            if not mine:
                continue
            place = np.full(len(tree.feature), -1)
            place[mine] = np.arange(len(mine))
            at = place[tree.node_of(self.bins)]
            on = at >= 0
            cell = ((at[on, None] * n_c + np.arange(n_c)) * n_b + self.bins[on][:, columns]).ravel()
            left = [np.bincount(cell, np.repeat(v[on], n_c), len(mine) * n_c * n_b).reshape(-1, n_c, n_b).cumsum(2) for v in (g[:, k], h[:, k], self.n)]
            total = [x[:, :, -1:] for x in left]
            cut = self._sum_cut(left, total) if self.p["growth"] == "symmetric" else None
            for i, node in enumerate(mine):
                tg, th, tn = (float(x[i, 0, 0]) for x in total)
                if not tn:
                    continue
                gain, f, b = cut or self._cut([x[i] for x in left], [x[i] for x in total])
                got = {"gain": None} if gain is None else {"gain": gain, "f": int(columns[f]), "b": b, **{f"l{x}": float(v[i, f, b]) for x, v in zip("ghn", left, strict=True)}}
                out[k, node] = {**got, "tg": tg, "th": th, "tn": tn}
        return out

    def _cut(self, left, total) -> tuple:
        """(gain, place of the column, bin) of the best cut of a node; equal gains go to the first."""
        (lg, lh, ln), (tg, th, tn), l2 = left, total, self.p["l2"]
        rg, rh, rn = tg - lg, th - lh, tn - ln
        ok = ((lh >= self.p["min_child_weight"]) & (rh >= self.p["min_child_weight"]) & (ln >= max(self.p["min_rows"], 1))
              & (rn >= self.p["min_rows"]) & (rn > 0) & (lh + l2 > 0) & (rh + l2 > 0))
        if not ok.any():
            return None, 0, 0
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, lg * lg / (lh + l2) + rg * rg / (rh + l2) - tg * tg / (th + l2), -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[f, b]), int(f), int(b)

    def _sum_cut(self, left, total) -> tuple:
        """The cut that is best in sum over the nodes."""
        l2 = self.p["l2"]
        score = lambda g, h: np.divide(g * g, h + l2, out=np.zeros_like(g), where=h + l2 > 0)
        (lg, lh, ln), (tg, th, tn) = left, total
        gain = (score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)).sum(0)
        rows = ln.sum(0)
        ok = (rows > 0) & (rows < tn.sum(0))
        if not ok.any():
            return None, 0, 0
        f, b = np.unravel_index(np.argmax(np.where(ok, gain, -np.inf)), gain.shape)
        return float(gain[f, b]), int(f), int(b)

    def step(self, trees: list[Tree]) -> None:
        self.raw = self.raw + np.stack([np.array(t.value)[t.node_of(self.bins)] for t in trees], 1)


ROWS = "bins binary, raw binary, y double, draw long"


def unpacked(batch: pa.RecordBatch, n_features: int):
    """(bins, raw scores, y, draws) of packed rows."""
    join = lambda col, kind: np.frombuffer(b"".join(col.to_pylist()), kind).reshape(batch.num_rows, -1)
    if not batch.num_rows:
        return np.zeros((0, n_features), np.uint8), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64)
    return join(batch.column(0), np.uint8), join(batch.column(1), np.float64), batch.column(2).to_numpy(), batch.column(3).to_numpy()


def packed(bins: np.ndarray, raw: np.ndarray, y, draw) -> pa.RecordBatch:
    cells = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
    return pa.RecordBatch.from_arrays([cells(bins), cells(raw), pa.array(y, pa.float64()), pa.array(draw, pa.int64())], names=["bins", "raw", "y", "draw"])


def boost(df: DataFrame, features: Sequence[str], label: str, task: str = "classification", style: str = "xgboost",
          n_estimators: int = 100, subsample: float = 1.0, colsample_bytree: float = 1.0, seed: int = SEED,
          checkpoint_every: int = 10, **params) -> BoostedModel:
    """Fit on rows with numeric ``features`` and a label (0, 1, ... for classes); rows with a null are
    left out. ``params`` override those of the style."""
    features, p = list(features), {**STYLES[style], **params}
    if p["max_bins"] > 256:
        raise ValueError("max_bins is 256 at most")
    ensure_checkpoint_dir(df.sparkSession)
    d = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)), F.col(label).cast("double").alias("y")).dropna()
    names = [f"x{j}" for j in range(len(features))]
    edges = quantile_edges(d, names, p["max_bins"])
    if task == "regression":
        base = [d.agg(F.avg("y")).first()[0] or 0.0]
    else:
        count = {int(r[0]): r[1] for r in d.groupBy("y").count().collect()}  # one row a class
        n = sum(count.values())
        share = [max(count.get(k, 0), 0.5) / max(n, 1) for k in range(max([1, *count]) + 1)]
        base = [math.log(share[1] / share[0])] if len(share) == 2 else [math.log(s) for s in share]
    model = BoostedModel(task, features, edges, base)
    rng, before = np.random.default_rng(seed), None

    def drawn_columns() -> np.ndarray:
        return np.sort(rng.permutation(len(features))[:max(1, round(colsample_bytree * len(features)))])

    if subsample >= 1:
        groups = [] if task == "regression" else [("y", len(share))]
        found = cells.counted(d, names, edges, groups, "y")
        if found is not None:
            grower = CellGrower(found, task, p, base)
            for _ in range(n_estimators):
                model.rounds.append(grower.grow(len(base), drawn_columns(), None))
                grower.step(model.rounds[-1])
            return model

    def start(batches):
        for batch in batches:
            x = np.stack([batch.column(j).to_numpy() for j in range(len(edges))], 1)
            yield packed(binned(x, edges), np.tile(np.array(base), (len(x), 1)), batch.column(len(edges)), batch.column(len(edges) + 1))

    # the checkpoint fixes each row's draw, whatever is computed again later
    rows = d.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).mapInArrow(start, ROWS).checkpoint()
    for m in range(n_estimators):
        columns = drawn_columns()

        def keep(draw, m=m):
            if subsample >= 1:
                return np.ones(len(draw), bool)
            mixed = (draw.astype(np.uint64) ^ np.uint64(m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            return (mixed >> np.uint64(11)).astype(np.float64) / 2 ** 53 < subsample

        trees = Grower(rows, len(features), task, p).grow(len(base), columns, keep)
        model.rounds.append(trees)

        def step(batches, trees=trees):
            for batch in batches:
                bins, raw, y, draw = unpacked(batch, len(features))
                raw = raw + np.stack([np.array(t.value)[t.node_of(bins)] for t in trees], 1) if len(bins) else raw
                yield packed(bins, raw, y, draw)

        now = rows.mapInArrow(step, ROWS)
        now = now.checkpoint() if (m + 1) % checkpoint_every == 0 else now.persist()
        if before is not None:
            before.unpersist()
        rows, before = now, rows if m else None
    rows.unpersist()
    return model
