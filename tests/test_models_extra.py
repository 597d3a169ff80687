import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import models_extra
from tessera.operators.dbscan import dbscan


def _blobs(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal([0, 0], 0.4, size=(n, 2))
    b = rng.normal([3, 3], 0.4, size=(n, 2))
    rows = [(i, float(x), float(y), "a" if i < n else "b") for i, (x, y) in enumerate(np.vstack([a, b]))]
    return spark.createDataFrame(rows, "id long, x double, y double, label string")


def test_lda_separates_and_matches_formula(spark):
    df = _blobs(spark)
    m = models_extra.lda_fit(df, ["x", "y"], "label")
    acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.97
    pdf = df.toPandas()
    X, y = pdf[["x", "y"]].to_numpy(), pdf["label"].to_numpy()
    mus = [X[y == c].mean(axis=0) for c in ("a", "b")]
    S = sum(((X[y == c] - mu).T @ (X[y == c] - mu)) for c, mu in zip(("a", "b"), mus)) / (len(X) - 2)
    w = np.linalg.solve(S, mus[0])
    assert np.allclose(m.coef[0], w, atol=1e-9)


def test_adaboost_learns(spark):
    df = _blobs(spark, seed=3)
    m = models_extra.adaboost_fit(df, ["x", "y"], "label", n_estimators=10)
    acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.95 and len(m.stumps) >= 1


def test_rbf_svm_nonlinear(spark):
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.uniform(0, 1, 150), rng.uniform(2, 3, 150)])
    t = rng.uniform(0, 2 * np.pi, 300)
    rows = [(float(ri * np.cos(ti)), float(ri * np.sin(ti)), 0 if i < 150 else 1) for i, (ri, ti) in enumerate(zip(r, t))]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    m = models_extra.rbf_svm_fit(df, ["x", "y"], "label", n_components=200)
    out = m.transform(df)
    acc = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.95
    assert out.agg(F.min("probability_1"), F.max("probability_1")).first()[0] >= 0


def _ref_dbscan(X, eps, min_samples):
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = [np.flatnonzero(d[i] <= eps) for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in nb[j]:
                if labels[k] == -1:
                    labels[k] = c
                    stack.append(k)
        c += 1
    return labels


def test_dbscan_matches_reference_on_cores_and_noise(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal([0, 0], 0.2, (40, 2)), rng.normal([3, 0], 0.2, (40, 2)), rng.uniform(-2, 5, (15, 2)),
                   np.repeat([[10.0, 10.0]], 6, axis=0)])  # a duplicate-only cluster
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(X)), "x": X[:, 0], "y": X[:, 1]}))
    got = dbscan(df, "id", ["x", "y"], eps=0.5, min_samples=5).toPandas().sort_values("id")["cluster"].to_numpy()
    want = _ref_dbscan(X, 0.5, 5)
    assert (got == want).all()


def test_shap_additivity(spark):
    import __spark_entry__ as entry
    from conftest import SF001
    out = entry.queries()["m12_shap"](spark, SF001).toPandas()
    assert out["o_orderkey"].nunique() == 100 and set(out["feature"]) == {"o_totalprice", "o_custkey"}


def test_mlp_regressor_fits_nonlinear(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(800, 2))
    y = np.abs(x[:, 0]) * 3 + x[:, 1] + rng.normal(0, 0.05, 800)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    m = models_extra.mlp_regressor_fit(df, ["a", "b"], "y", hidden=32, max_iter=300, lr=0.01)
    pred = m.transform(df).toPandas()
    r2 = 1 - ((pred.y - pred.prediction) ** 2).sum() / ((pred.y - pred.y.mean()) ** 2).sum()
    assert r2 > 0.9 and m.losses[-1] < m.losses[0]


def test_trees_grow_until_pure(spark):
    from tessera.operators import models

    # x = 13 has half of the rows, x = 12 half of the rest, ...: each level of a tree parts one value off
    df = spark.range(2 ** 14 - 1).select("id", F.floor(F.log2(F.col("id") + 1)).cast("double").alias("x"))
    df = df.withColumn("label_", (F.col("x") % 2).cast("string")).withColumn("y", F.col("x") % 2)
    for task, label in (("classification", "label_"), ("regression", "y")):
        model, pred = models.train_and_score("decision_tree", task, df, df, ["x"], [], label)
        assert model.stages[-1].depth > 10
        assert pred.where(F.col("prediction") != F.col("label")).count() == 0
    for reg in (models._classifiers(1, 2, 1), models._regressors(1)):
        for name in ("decision_tree", "random_forest"):
            est = reg[name]()
            assert (est.getMaxDepth(), est.getMinInstancesPerNode()) == (30, 1)
    # extra trees are no MLlib forests any more: they grow to the same end themselves
    for task, label in (("classification", "label_"), ("regression", "y")):
        _, pred = models.train_and_score("extra_trees", task, df, df, ["x"], [], label, params={"n_estimators": 2})
        assert pred.where(F.col("prediction") != F.col("label")).count() == 0


def test_dbscan_leaves_incomplete_rows_out(spark):
    rows = [(i, 0.1 * i, 1.0) for i in range(8)] + [(20, None, 1.0), (21, 0.2, None), (22, float("nan"), 1.0), (23, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", ["x", "y"], eps=0.3, min_samples=3).collect()}
    assert got == {**{i: 0 for i in range(8)}, 23: -1}


def test_dbscan_of_a_dense_region_by_cells(spark):
    """5,000 points all within eps of each other, two strings of points that meet at one pair, and strays."""
    rng = np.random.default_rng(9)
    X = np.vstack([rng.uniform(0, 0.3, (5000, 2)), np.stack([np.arange(5, 9, 0.1), np.full(40, 3.0)], 1),
                   np.stack([np.arange(8.9 + 0.4999, 12, 0.1), np.full(27, 3.0)], 1), rng.uniform(20, 30, (12, 2)), [[0.3, 0.75]]])
    ids = rng.permutation(len(X))
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "x": X[:, 0], "y": X[:, 1]})).persist()
    got = dbscan(df, "id", ["x", "y"], eps=0.5, min_samples=5).toPandas().sort_values("id")["cluster"].to_numpy()
    small = np.vstack([X[:60], X[5000:]])  # 60 of the region stand for it
    order = np.argsort(np.concatenate([ids[:60], ids[5000:]]))
    want = _ref_dbscan(small[order], 0.5, 5)
    pos = np.concatenate([ids[:60], ids[5000:]])[order]
    for c in set(want):
        assert len(set(got[pos[want == c]])) == 1
    assert len(set(got[pos])) == len(set(want)) and (got[ids[:5000]] == got[ids[0]]).all()
