"""Extremely randomised trees: where cuts fall, which is kept, and when nodes end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extra_trees as E


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (300, 2))
    rows = [(float(a), float(b), 5.0, int(a + b > 1), float(3 * a - b)) for a, b in x]
    return x, rows, spark.createDataFrame(rows, "a double, b double, same double, k int, t double").repartition(3).cache()


def test_first_cuts_are_uniform_between_the_extremes(line):
    x, _, df = line
    model = E.extra_trees(df, ["a"], "k", n_estimators=200, max_depth=1, trees_at_once=200)
    cuts = np.sort([(a[1][0] - x[:, 0].min()) / np.ptp(x[:, 0]) for a, _ in model.trees])
    # Kolmogorov's distance from the uniform law: 0.12 is passed with a chance below 0.01
    assert len(set(cuts)) == 200 and np.abs(cuts - (np.arange(200) + 0.5) / 200).max() < 0.12


def test_features_are_drawn_evenly_and_constant_ones_never(line):
    _, _, df = line
    model = E.extra_trees(df, ["a", "b", "same"], "t", "regression", n_estimators=200, max_depth=1, max_features=1, trees_at_once=200)
    first = np.bincount([a[0][0] for a, _ in model.trees], minlength=3)
    assert first[2] == 0 and 70 <= first[0] <= 130


def test_every_node_keeps_the_better_of_its_cuts(line):
    """Regrow a tree on arrays from the same draws."""
    x, rows, df = line
    y = np.array([r[3] for r in rows], float)
    model = E.extra_trees(df, ["a", "b", "same"], "k", n_estimators=3, max_features=2, seed=7)
    full = np.column_stack([x, np.full(300, 5.0)])
    for number, ((feature, threshold, left), value) in enumerate(model.trees):
        todo = [(0, np.ones(300, bool))]
        while todo:
            node, on = todo.pop()
            p = np.bincount(y[on].astype(int), minlength=2) / on.sum()
            assert np.allclose(value[node], p)
            if p.max() == 1:
                assert feature[node] < 0
                continue
            draw = E.draws(7, np.array([number]), np.array([node]), 6)[0]
            lo, hi = full[on].min(0), full[on].max(0)
            f = sorted(np.flatnonzero(hi > lo), key=lambda j: draw[j])[:2]
            cuts = np.array([lo[j] + draw[3 + j] * (hi[j] - lo[j]) for j in f])
            gini = lambda s: s.sum() * (1 - sum((y[s] == k).mean() ** 2 for k in (0, 1)))
            scores = [gini(on & (full[:, j] <= c)) + gini(on & (full[:, j] > c)) for j, c in zip(f, cuts, strict=True)]
            best = int(np.argmin(scores))
            assert (feature[node], threshold[node]) == (f[best], cuts[best])
            side = full[:, f[best]] <= cuts[best]
            todo += [(left[node], on & side), (left[node] + 1, on & ~side)]


def test_predictions(line):
    x, rows, df = line
    model = E.extra_trees(df, ["a", "b"], "k", n_estimators=40)
    out = model.transform(df).agg(F.avg((F.col("prediction") == F.col("k")).cast("double")), F.min("probability_1"), F.max("probability_1")).first()
    assert out[0] == 1.0 and 0 <= out[1] <= out[2] <= 1  # grown until pure on all rows
    model = E.extra_trees(df, ["a", "b"], "t", "regression", n_estimators=20, min_samples_split=5)
    t = np.array([r[4] for r in rows])
    assert 1 - ((model.mean(x)[:, 0] - t) ** 2).mean() / t.var() > 0.98 and abs(model.importance().sum() - 1) < 1e-9


def test_bounds(spark, line):
    _, _, df = line
    model = E.extra_trees(df, ["a", "b"], "k", n_estimators=2, max_nodes=9)
    assert all(len(a[0]) <= 9 for a, _ in model.trees)
    one = spark.createDataFrame([(1.0, 0, 2.0), (1.0, 1, 4.0), (None, 1, 9.0)], "x double, k int, t double")
    assert E.extra_trees(one, ["x"], "t", "regression", n_estimators=2).transform(one.dropna()).first()["prediction"] == 3.0
    assert E.extra_trees(one, ["x"], "k", n_estimators=2).transform(one.dropna()).first()["raw"] == [0.5, 0.5]
