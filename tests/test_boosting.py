"""Histogram boosting against a small booster written out over the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting


def plain_tree(bins, g, h, p, depth=0):
    """(feature, cut, left, right) or a leaf value, level by level, on arrays."""
    score = lambda a, b: a * a / (b + p["l2"]) if b + p["l2"] > 0 else -np.inf
    best = (1e-12, None)
    if depth < p["max_depth"]:
        for f in range(bins.shape[1]):
            for b in np.unique(bins[:, f])[:-1]:
                on = bins[:, f] <= b
                if min(h[on].sum(), h[~on].sum()) < p["min_child_weight"] or min(on.sum(), (~on).sum()) < p["min_rows"]:
                    continue
                gain = score(g[on].sum(), h[on].sum()) + score(g[~on].sum(), h[~on].sum()) - score(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b, on))
    if best[1] is None:
        return -p["learning_rate"] * g.sum() / (h.sum() + p["l2"])
    f, b, on = best[1]
    return f, b, plain_tree(bins[on], g[on], h[on], p, depth + 1), plain_tree(bins[~on], g[~on], h[~on], p, depth + 1)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 3)), 2)
    x[:, 2] = rng.integers(0, 3, 400)
    t = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] == 1) + rng.normal(0, 0.1, 400)
    k = np.digitize(t, [-0.6, 0.6])
    rows = [(*map(float, a), float(b), int(c)) for a, b, c in zip(x, t, k, strict=True)]
    return x, t, k, spark.createDataFrame(rows, "a double, b double, c double, t double, k int").repartition(4)


@pytest.mark.parametrize("task", ["regression", "binary", "many"])
def test_level_growth_equals_a_plain_booster(data, task):
    x, t, k, df = data
    y = {"regression": t, "binary": (k == 2) * 1.0, "many": k * 1.0}[task]
    df = df.withColumn("y", {"regression": F.col("t"), "binary": (F.col("k") == 2).cast("double"), "many": F.col("k")}[task])
    kind = "regression" if task == "regression" else "classification"
    model = boosting.boost(df, ["a", "b", "c"], "y", kind, "xgboost", n_estimators=3, max_depth=3, max_bins=16, checkpoint_every=2)
    p = {**boosting.STYLES["xgboost"], "max_depth": 3}
    bins = boosting.binned(x, model.edges)
    raw = np.tile(np.array(model.base), (len(x), 1))
    for _ in range(3):
        g, h = boosting.derivatives(raw, y, kind)
        for j in range(raw.shape[1]):
            tree = plain_tree(bins, g[:, j], h[:, j], p)
            raw[:, j] = raw[:, j] + [plain_value(tree, r) for r in bins]
    assert np.allclose(model.raw(x), raw)
    got = {(r["a"], r["b"], r["c"]): r["raw"] for r in model.transform(df).collect()}
    assert np.allclose([got[tuple(r)] for r in x], raw)


def test_leaf_growth_cuts_the_largest_gain_first(data):
    x, t, _, df = data
    model = boosting.boost(df, ["a", "b", "c"], "t", "regression", "lightgbm", n_estimators=1, num_leaves=7, max_bins=16)
    tree, p = model.rounds[0][0], {**boosting.STYLES["lightgbm"]}
    bins, g = boosting.binned(x, model.edges), np.mean(t) - t

    def best(on):
        top = (1e-12, None)
        for f in range(3):
            for b in np.unique(bins[on, f])[:-1]:
                left, right = on & (bins[:, f] <= b), on & (bins[:, f] > b)
                if min(left.sum(), right.sum()) >= p["min_rows"]:
                    gain = sum(g[s].sum() ** 2 / s.sum() for s in (left, right)) - g[on].sum() ** 2 / on.sum()
                    if gain > top[0] + 1e-9:
                        top = (gain, (left, right))
        return top

    leaves = [np.ones(400, bool)]
    while len(leaves) < 7:
        i = max(range(len(leaves)), key=lambda j: best(leaves[j])[0])
        leaves[i:i + 1] = best(leaves[i])[1]
    want = np.empty(400)
    for s in leaves:
        want[s] = -p["learning_rate"] * g[s].mean()
    assert np.allclose(np.array(tree.value)[tree.node_of(bins)], want)
    assert sum(f >= 0 for f in tree.feature) == 6


def test_symmetric_growth_uses_one_cut_a_level(data):
    x, t, _, df = data
    model = boosting.boost(df, ["a", "b", "c"], "t", "regression", "catboost", n_estimators=1, max_depth=3, max_bins=8)
    tree, bins, g = model.rounds[0][0], boosting.binned(x, model.edges), np.mean(t) - t
    leaf = np.zeros(400, int)
    for _ in range(3):
        score = lambda of: sum(g[of == v].sum() ** 2 / ((of == v).sum() + 3.0) for v in np.unique(of))
        cuts = [(f, b) for f in range(3) for b in np.unique(bins[:, f])[:-1]]
        f, b = max(cuts, key=lambda c: score(2 * leaf + (bins[:, c[0]] > c[1])))
        leaf = 2 * leaf + (bins[:, f] > b)
    want = np.array([-0.1 * g[leaf == v].sum() / ((leaf == v).sum() + 3.0) for v in leaf])
    assert np.allclose(np.array(tree.value)[tree.node_of(bins)], want)


@pytest.mark.parametrize("style", list(boosting.STYLES))
def test_many_classes_and_samples_of_rows_and_columns(data, style):
    x, _, k, df = data
    model = boosting.boost(df, ["a", "b", "c"], "k", style=style, n_estimators=8, learning_rate=0.3, subsample=0.7, colsample_bytree=0.7)
    right = model.transform(df).agg(F.avg((F.col("prediction") == F.col("k")).cast("double"))).first()[0]
    assert right > 0.8 and abs(model.importance().sum() - 1) < 1e-9


def test_odd_tables(spark):
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 9.0)], "x double, y double")
    model = boosting.boost(one, ["x"], "y", "regression", n_estimators=2)
    assert [r["prediction"] for r in model.transform(one.dropna()).collect()] == [3.0, 3.0]


def test_sparse_cells_give_the_same_trees(data, monkeypatch):
    x, _, _, df = data
    fit = lambda: boosting.boost(df, ["a", "b", "c"], "t", "regression", n_estimators=1, max_depth=2).raw(x)
    want = fit()
    monkeypatch.setattr(boosting, "DENSE_CELLS", 0)
    assert np.allclose(fit(), want)


def test_cuts_of_nodes_are_found_with_one_shuffle(spark):
    from pyspark.sql import Window
    rows = spark.createDataFrame([], boosting.ROWS)
    cells = boosting.Grower(rows, 1, "regression", boosting.STYLES["xgboost"]).cells([boosting.Tree()], [(0, 0)], np.array([0]), lambda d: d >= 0)
    sums = cells.select("k", "node", F.sum("g").over(Window.partitionBy("k", "node", "f").orderBy("b")).alias("g"))
    plan = sums.groupBy("k", "node").agg(F.max("g"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
