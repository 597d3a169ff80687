"""AdaBoost.R2 for numbers (E8) and class probabilities of an SVM of many classes.

* ``adaboost_r2``: each round draws a bootstrap sample by the rows' weights (a Poisson count of
  mean n * w, drawn from a hash of the row's fixed number and the round, in place of n draws
  with replacement), fits a tree of three levels to it (MLlib, the counts as weights) and
  lowers the weights of rows with a small loss. The prediction is the weighted median of
  the trees'. Weights are kept beside the rows; a checkpoint every few rounds cuts lineage.
* ``svm_probabilities``: a linear SVM on random Fourier features (or on the features) for each
  pair of classes, a sigmoid for each fitted to margins of rows the SVM was not fitted to
  (five folds), with Platt's smoothed targets, and for each row the class probabilities that
  agree best with all pairs' (the second method of Wu, Lin and Weng, 2004).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SEED = 42


def tree_arrays(model) -> tuple[np.ndarray, ...]:
    """(feature or -1, threshold, left child, value) of an MLlib regression tree; the right child follows the left."""
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, model._java_obj.rootNode())]
    while todo:
        at, node = todo.pop()
        value[at] = float(node.prediction())
        if node.getClass().getSimpleName().startswith("InternalNode"):
            feature[at], threshold[at], left[at] = int(node.split().featureIndex()), float(node.split().threshold()), len(feature)
            for child in (node.leftChild(), node.rightChild()):
                todo.append((len(feature), child))
                for col, x in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                    col.append(x)
    return np.array(feature), np.array(threshold), np.array(left), np.array(value)


def tree_values(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    from .extra_trees import node_of
    return tree[3][node_of(tree[:3], x)]


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row the smallest value at which half of the weight is reached."""
    order = np.argsort(values, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1)
    at = (reached >= 0.5 * reached[:, -1:]).argmax(1)
    return np.take_along_axis(values, order, 1)[np.arange(len(values)), at]


class AdaBoostR2Model:
    def __init__(self, features: list[str], trees: list, weights: list[float]):
        self.features, self.trees, self.weights = features, trees, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return weighted_median(np.stack([tree_values(t, x) for t in self.trees], 1), np.array(self.weights))

    def transform(self, df: DataFrame) -> DataFrame:
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.stack(x.to_list()).astype(float))) if len(x) else pd.Series([], dtype=float)

        return df.withColumn("prediction", F.pandas_udf(score, "double")(F.array(*(F.col(c).cast("double") for c in self.features))))


#: loss of an error as a share of the largest, by name
LOSSES = {"linear": lambda e: e, "square": lambda e: e ** 2, "exponential": lambda e: 1 - np.exp(-e)}


def poisson_counts(draw: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Counts of the given means at uniform draws, by the inverse distribution."""
    count, p = np.zeros(len(mean)), np.exp(-np.minimum(mean, 700))
    reached = p.copy()
    while True:
        on = (draw > reached) & (p > 1e-300)
        if not on.any():
            return np.where(mean > 700, np.round(mean), count)
        count = count + on
        p = np.where(on, p * mean / np.maximum(count, 1), p)
        reached = np.where(on, reached + p, reached)


def adaboost_r2(df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100, learning_rate: float = 1.0,
                loss: str = "linear", max_depth: int = 3, checkpoint_every: int = 10, seed: int = SEED) -> AdaBoostR2Model:
    """Fit on rows with numeric features and label; rows with a null are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    features = list(features)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)), F.col(label).cast("double").alias("y")).dropna()
    rows = rows.withColumn("number", F.monotonically_increasing_id()).withColumn("w", F.lit(1.0)).checkpoint()
    names, n, before = [f"x{j}" for j in range(len(features))], rows.count(), None
    if not n:
        raise ValueError("no complete row to fit")
    total, trees, weights = float(n), [], []
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    for m in range(n_estimators):
        def drawn(number: pd.Series, mean: pd.Series) -> pd.Series:
            h = (number.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + m) & (2 ** 64 - 1))
            for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
            return pd.Series(poisson_counts(((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2 ** 53, mean.to_numpy()))

        sample = rows.withColumn("count", F.pandas_udf(drawn, "double")("number", F.col("w") * F.lit(n / total))).where("count > 0")
        tree = tree_arrays(DecisionTreeRegressor(maxDepth=max_depth, weightCol="count", labelCol="y", seed=seed).fit(assemble.transform(sample)))

        def value(x: pd.Series) -> pd.Series:
            return pd.Series(tree_values(tree, np.stack(x.to_list()).astype(float))) if len(x) else pd.Series([], dtype=float)  # noqa: B023

        off = rows.withColumn("off", F.abs(F.col("y") - F.pandas_udf(value, "double")(F.array(*names)))).persist()
        worst = off.agg(F.max("off")).first()[0]
        if not worst:  # nothing left to learn
            trees.append(tree)
            weights.append(1.0)
            break
        share = F.col("off") / F.lit(worst)
        share = {"linear": share, "square": share * share, "exponential": 1 - F.exp(-share)}[loss]
        mean = off.agg(F.sum(F.col("w") * share) / F.sum("w")).first()[0]
        if mean >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = mean / (1 - mean)
        trees.append(tree)
        weights.append(learning_rate * math.log(1 / beta))
        now = off.withColumn("w", F.col("w") * F.pow(F.lit(beta), (1 - share) * F.lit(learning_rate))).drop("off")
        now = now.checkpoint() if (m + 1) % checkpoint_every == 0 else now.persist()
        total = now.agg(F.sum("w")).first()[0]
        off.unpersist()
        if before is not None:
            before.unpersist()
        rows, before = now, now
    return AdaBoostR2Model(features, trees, weights)


def coupled(r: np.ndarray) -> np.ndarray:
    """Class probabilities, rows x classes, from pairwise ones r[:, i, j] = P(i | i or j): the minimum of
    the sum of (r_ji p_i - r_ij p_j) ** 2 over distributions p."""
    k = r.shape[1]
    q = -np.transpose(r, (0, 2, 1)) * r
    for i in range(k):
        q[:, i, i] = (r[:, :, i] ** 2).sum(1) - r[:, i, i] ** 2
    p = np.full(r.shape[:2], 1 / k)
    for _ in range(max(100, k)):
        for t in range(k):
            qp = (q @ p[:, :, None])[:, :, 0]
            pqp = (p * qp).sum(1)
            step = (pqp - qp[:, t]) / np.maximum(q[:, t, t], 1e-300)
            p[:, t] += step
            p /= 1 + step[:, None]
        qp = (q @ p[:, :, None])[:, :, 0]
        if np.abs(qp - (p * qp).sum(1)[:, None]).max() < 0.005 / k:
            break
    return p


class PairwiseSVMModel:
    """``transform`` adds probabilities (one a class), prediction (most pairs won, then the first) and, for two
    classes, probability_1."""

    def __init__(self, mapped, models: dict, sigmoids: dict, n_classes: int):
        self.mapped, self.models, self.sigmoids, self.n_classes = mapped, models, sigmoids, n_classes

    def transform(self, df: DataFrame) -> DataFrame:
        k, pairs = self.n_classes, list(self.models)
        out = self.mapped(df)
        for i, j in pairs:
            out = margins(self.models[i, j], out, f"_m{i}_{j}")
        a, b = (np.array([self.sigmoids[p][x] for p in pairs]) for x in (0, 1))

        def couple(m: pd.Series) -> pd.Series:
            if not len(m):
                return pd.Series([], dtype=object)
            p = np.clip(1 / (1 + np.exp(-(np.stack(m.to_list()) * a + b))), 1e-7, 1 - 1e-7)
            r = np.zeros((len(m), k, k))
            for at, (i, j) in enumerate(pairs):
                r[:, i, j], r[:, j, i] = p[:, at], 1 - p[:, at]
            return pd.Series(list(coupled(r)))

        out = out.withColumn("probabilities", F.pandas_udf(couple, "array<double>")(F.array(*(f"_m{i}_{j}" for i, j in pairs))))
        won = [sum(((F.col(f"_m{i}_{j}") > 0) == (c == i)).cast("int") for i, j in pairs if c in (i, j)) for c in range(k)]
        out = out.withColumn("_won", F.array(*won)).withColumn("prediction", (F.array_position("_won", F.array_max("_won")) - 1).cast("double"))
        out = out.withColumn("probability_1", F.col("probabilities")[1]) if k == 2 else out
        return out.drop("features", "_won", *(f"_m{i}_{j}" for i, j in pairs))


def margins(svc, df: DataFrame, name: str) -> DataFrame:
    """The SVM's margin, positive for the pair's first class."""
    from pyspark.ml.functions import vector_to_array
    keep = svc.copy().setRawPredictionCol("_raw").setPredictionCol("_p")
    return keep.transform(df).withColumn(name, vector_to_array("_raw")[1]).drop("_raw", "_p")


def svm_probabilities(df: DataFrame, features: Sequence[str], label: str, kernel: str = "rbf", C: float = 1.0, gamma: str | float = "scale",
                      n_components: int = 200, folds: int = 5, max_iter: int = 100, seed: int = SEED) -> PairwiseSVMModel:
    """Fit on rows with numeric features and classes 0, 1, ...; rows with a null are left out."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from .models_extra import RBFSVMModel
    features = list(features)
    df = df.dropna(subset=[*features, label])
    st = df.agg(*(F.avg(c).alias(f"m{j}") for j, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{j}") for j, c in enumerate(features)),
                F.max(label).alias("top")).first()
    mean, std = [st[f"m{j}"] for j in range(len(features))], [st[f"s{j}"] or 1.0 for j in range(len(features))]
    if kernel == "linear":
        def mapped(d):
            z = d.select("*", *(((F.col(c) - F.lit(mean[j])) / F.lit(std[j])).alias(f"_z{j}") for j, c in enumerate(features)))
            return VectorAssembler(inputCols=[f"_z{j}" for j in range(len(features))], outputCol="features").transform(z).drop(
                *(f"_z{j}" for j in range(len(features))))
    else:
        # on standardised features "scale" and "auto" are both 1 / their number
        g = 1 / len(features) if isinstance(gamma, str) else gamma
        rng = np.random.default_rng(seed)
        fourier = RBFSVMModel(features, mean, std, rng.normal(0, math.sqrt(2 * g), (n_components, len(features))),
                              rng.uniform(0, 2 * math.pi, n_components), None, None)
        mapped = fourier._rff
    ensure_checkpoint_dir(df.sparkSession)
    # the checkpoint fixes the rows' folds, whatever is computed again later
    rows = mapped(df).select(F.col(label).cast("int").alias("c"), "features", F.monotonically_increasing_id().alias("number"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(folds))).checkpoint()
    n_classes, models, sigmoids = max(1, int(st["top"])) + 1, {}, {}
    for i, j in combinations(range(n_classes), 2):
        pair = rows.where(F.col("c").isin(i, j)).withColumn("label", (F.col("c") == i).cast("double")).persist()
        count = {r[0]: r[1] for r in pair.groupBy("label").count().collect()}
        n = sum(count.values())
        if len(count) < 2:
            raise ValueError(f"classes {i} and {j} are not both there")
        fit = lambda d: LinearSVC(regParam=1 / (C * n), maxIter=max_iter).fit(d)  # noqa: B023, E731
        models[i, j] = fit(pair)
        held = None
        for f in range(folds):
            if not pair.where(F.col("fold") == f).isEmpty() and pair.where(F.col("fold") != f).select("label").distinct().count() == 2:
                part = margins(fit(pair.where(F.col("fold") != f)), pair.where(F.col("fold") == f), "m").select("label", "m")
                held = part if held is None else held.union(part)
        held = margins(models[i, j], pair, "m").select("label", "m") if held is None else held
        # Platt's targets, as two weighted rows each
        goal = F.when(F.col("label") == 1, (count[1.0] + 1) / (count[1.0] + 2)).otherwise(1 / (count[0.0] + 2))
        both = held.select("m", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), goal.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - goal).alias("w")))).alias("t"))
        both = VectorAssembler(inputCols=["m"], outputCol="features").transform(both.select("m", "t.label", "t.w"))
        s = LogisticRegression(weightCol="w", maxIter=100).fit(both)
        sigmoids[i, j] = (float(s.coefficients[0]), float(s.intercept))
        pair.unpersist()
    return PairwiseSVMModel(mapped, models, sigmoids, n_classes)
