"""AdaBoost.R2 and pairwise-coupled SVM probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensembles_extra as E


def test_weighted_median():
    v, w = np.array([[5.0, 1.0, 3.0], [2.0, 2.0, 9.0], [4.0, 8.0, 6.0]]), np.array([1.0, 1.0, 3.0])
    assert E.weighted_median(v, w).tolist() == [3.0, 9.0, 6.0]
    assert E.weighted_median(v[:1], np.array([4.0, 1.0, 1.0])).tolist() == [5.0]


def test_poisson_counts_follow_their_law():
    u = (np.arange(20_000) + 0.5) / 20_000
    for mean in (0.1, 1.0, 7.5):
        c = E.poisson_counts(u, np.full(len(u), mean))
        assert abs(c.mean() - mean) < 0.01 * max(1, mean) and abs(c.var() - mean) < 0.02 * max(1, mean)


@pytest.mark.parametrize("loss", list(E.LOSSES))
def test_adaboost_r2_beats_one_tree(spark, loss):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 6, (300, 1))
    y = np.sin(x[:, 0]) + np.sin(6 * x[:, 0]) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y, strict=True)], "x double, y double").repartition(3)
    r2 = lambda m: 1 - ((m.predict(x) - y) ** 2).mean() / y.var()
    one, many = (E.adaboost_r2(df, ["x"], "y", n, loss=loss, checkpoint_every=3) for n in (1, 7))
    assert r2(many) > r2(one) + 0.05 and len(many.trees) == 7
    got = many.transform(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert 1 - got / y.var() == pytest.approx(r2(many))
    # the weights after the first round, by hand
    first = np.abs(E.tree_values(many.trees[0], x) - y)
    share = E.LOSSES[loss](first / first.max())
    assert many.weights[0] == pytest.approx(np.log((1 - share.mean()) / share.mean()))


def test_adaboost_r2_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 7.0)], "x double, y double")
    assert [r["prediction"] for r in E.adaboost_r2(df, ["x"], "y").transform(df.dropna()).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError, match="no complete row"):
        E.adaboost_r2(df.where("x > 5"), ["x"], "y")


def test_coupling_gives_back_consistent_probabilities():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(4), 50)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(E.coupled(r), p, atol=0.02)
    r[:, 0, 1] += 0.0  # and a least-squares answer where pairs disagree
    r = np.clip(r + rng.normal(0, 0.03, r.shape), 0.01, 0.99)
    r = np.where(np.triu(np.ones((4, 4)), 1) > 0, r, 1 - np.transpose(r, (0, 2, 1)))
    got = E.coupled(r)
    off = lambda q: sum(((r[:, j, i] * q[:, i] - r[:, i, j] * q[:, j]) ** 2).sum() for i in range(4) for j in range(4) if i != j)
    assert np.allclose(got.sum(1), 1) and off(got) <= off(p) + 1e-6


def test_svm_probabilities_of_three_classes(spark):
    rng = np.random.default_rng(6)
    centre = np.array([[0, 0], [2.5, 0], [0, 2.5]])
    k = np.arange(240) % 3
    x = centre[k] + rng.normal(0, 0.8, (240, 2))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, k, strict=True)], "a double, b double, k int").coalesce(1)
    for kernel in ("linear", "rbf"):
        out = E.svm_probabilities(df, ["a", "b"], "k", kernel=kernel, folds=2, n_components=60, max_iter=12).transform(df).collect()
        p = np.array([r["probabilities"] for r in out])
        y = np.array([r["k"] for r in out])
        assert np.allclose(p.sum(1), 1) and (p >= 0).all()
        assert np.mean([r["prediction"] == r["k"] for r in out]) > 0.85
        own = p[np.arange(240), y]
        # calibrated: the mean probability of the most likely class is near the share that is right
        assert abs(p.max(1).mean() - (p.argmax(1) == y).mean()) < 0.08 and -np.log(own).mean() < 0.5
