"""Fits on counted cells against the same fits on rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import boosting, cells, celltrees, models, models_extra


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 2)), 1)
    t = np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 600)
    k = np.digitize(t, [-0.8, 0.9])
    rows = [(i, float(a), float(b), float(c), int(d), "uvw"[i * i % 3]) for i, ((a, b), c, d) in enumerate(zip(x, t, k, strict=True))]
    return x, spark.createDataFrame(rows, "id long, a double, b double, t double, k int, g string").repartition(5).cache()


@pytest.mark.parametrize(("style", "task"), [("xgboost", "classification"), ("lightgbm", "regression"), ("catboost", "classification")])
def test_boosting_of_cells_equals_boosting_of_rows(data, monkeypatch, style, task):
    x, df = data
    fit = lambda: boosting.boost(df, ["a", "b"], "t" if task == "regression" else "k", task, style, n_estimators=1, max_bins=16).raw(x)
    got = fit()
    monkeypatch.setattr(cells, "MOST", 0)
    assert np.allclose(got, fit())


def test_rounds_of_boosting_add_no_jobs(spark, data):
    """Cells are counted once, whatever the number of rounds."""
    _, df = data
    sc = spark.sparkContext

    def jobs(n: int) -> int:
        sc.setJobGroup(f"rounds-{n}", "")
        model = boosting.boost(df, ["a", "b"], "t", "regression", "lightgbm", n_estimators=n)
        sc.setJobGroup("other", "")
        assert len(model.rounds) == n
        return len(sc.statusTracker().getJobIdsForGroup(f"rounds-{n}"))

    assert jobs(2) == jobs(30)


def test_boosting_regression_query_runs_all_rounds(spark, monkeypatch, tmp_path):
    from tessera.plans import q_more_models
    rows = [(i, i * 37 % 50, "FOP"[i % 3], float(i * 91 % 1000), "uv"[i % 2]) for i in range(1, 300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    made, plain = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    out = q_more_models.q_e11_boosting_regression(spark, str(tmp_path))
    assert out.groupBy("model").count().collect() and [len(m.rounds) for m in made] == [100, 100, 100]


def test_cells_hold_every_row(spark, data):
    x, df = data
    edges = [np.array([-0.5, 0.4]), np.array([0.0])]
    bins, groups, n, s = cells.counted(df, ["a", "b"], edges, [("k", 3)], "t")
    assert n.sum() == 600 and s.sum() == pytest.approx(df.agg(F.sum("t")).first()[0])
    want = {}
    for r in df.collect():
        at = (int(np.searchsorted(edges[0], r["a"])), int(np.searchsorted(edges[1], r["b"])), r["k"])
        want[at] = want.get(at, 0) + 1
    assert {(int(a), int(b), int(k)): int(c) for (a, b), k, c in zip(bins, groups[0], n, strict=True)} == want
    assert cells.counted(df, ["a", "b"], edges, [("k", 3)], most=2) is None


@pytest.fixture(scope="module")
def ready(data):
    """Rows with label and features: two numbers and a one-hot category."""
    from pyspark.ml import Pipeline
    df = data[1]
    return Pipeline(stages=models.feature_stages(["a", "b"], ["g"])).fit(df).transform(df.withColumn("label", F.col("k").cast("double"))).select("id", "label", "features").cache()


@pytest.mark.parametrize("params", [dict(maxDepth=30), dict(maxDepth=4, minInstancesPerNode=9), dict(maxDepth=6, impurity="entropy", maxBins=9), dict(maxDepth=0)])
def test_tree_of_cells_equals_mllibs(ready, params):
    est = DecisionTreeClassifier(seed=42, **params)
    got, want = celltrees.fit(est, ready), est.fit(ready)
    assert got.depth == want.depth and got.numNodes == want.numNodes and got.numClasses == 3
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    both = want.transform(ready).select("id", F.col("probability").alias("p")).join(got.transform(ready), "id").collect()
    assert len(both) == 600 and all(np.allclose(r["p"].toArray(), r["probability"].toArray()) for r in both)


def test_forest_of_cells_is_like_mllibs(ready):
    est = RandomForestClassifier(numTrees=40, seed=42, maxDepth=30)
    got, want = celltrees.fit(est, ready), est.fit(ready)
    assert got.getNumTrees == 40 and len({t.toDebugString.split("\n", 1)[1] for t in got.trees}) == 40
    assert abs(np.mean([t.numNodes for t in got.trees]) / np.mean([t.numNodes for t in want.trees]) - 1) < 0.1
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.05)
    right = [m.transform(ready).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] for m in (got, want)]
    assert abs(right[0] - right[1]) < 0.02 and celltrees.fit(est, ready).toDebugString.split("\n", 1)[1] == got.toDebugString.split("\n", 1)[1]


def test_random_search_of_trees_adds_no_jobs_a_trial(spark, data, monkeypatch):
    _, df = data
    space = {"maxDepth": ("int", 1, 9), "minInstancesPerNode": ("int", 1, 30)}
    search = lambda n: models.random_search(df, ["a", "b"], ["g"], "k", "id", "decision_tree", space, n_trials=n, k=2)
    fits, plain = [], DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, *a: fits.append(1) or plain(self, *a))
    got = [r["value"] for r in search(12).orderBy("trial").collect()]
    assert not fits
    monkeypatch.setattr(cells, "MOST", 0)
    want = [r["value"] for r in search(12).orderBy("trial").collect()]
    assert len(fits) == 24 and got == pytest.approx(want)


def test_known_estimators(ready):
    assert not celltrees.known(DecisionTreeClassifier(minInfoGain=0.1)) and not celltrees.known(DecisionTreeClassifier(weightCol="w"))
    assert not celltrees.known(RandomForestClassifier(featureSubsetStrategy="all"))
    assert celltrees.fit(DecisionTreeClassifier(), ready.where("label = 0")) is None


def test_adaboost_of_cells_equals_adaboost_of_rows(data, monkeypatch):
    _, df = data
    fits, plain = [], DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, *a: fits.append(1) or plain(self, *a))
    got = models_extra.adaboost_fit(df, ["a", "b"], "k", n_estimators=6)
    assert not fits and len(got.stumps) == 6
    monkeypatch.setattr(cells, "MOST", 0)
    want = models_extra.adaboost_fit(df, ["a", "b"], "k", n_estimators=6)
    assert len(fits) == 6 and np.allclose(got.alphas, want.alphas) and np.allclose(np.array(got.stumps, float), np.array(want.stumps, float), equal_nan=True)


def test_adaboost_of_a_large_table_uses_fine_bins(spark, monkeypatch):
    monkeypatch.setattr(cells, "MOST", 1 << 14)
    df = spark.range(30_000).select(F.rand(3).alias("x"), F.rand(4).alias("y")).withColumn("c", (F.col("x") + F.col("y") > 1).cast("string"))
    model = models_extra.adaboost_fit(df, ["x", "y"], "c", n_estimators=30)
    right = model.transform(df).agg(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0]
    assert right > 0.95 and len({s[1] for s in model.stumps}) > 10


@pytest.fixture
def fitted_rows(monkeypatch):
    """Rows that MLlib's own fits of trees get."""
    seen = []
    for est in (DecisionTreeClassifier, RandomForestClassifier):
        monkeypatch.setattr(est, "fit", lambda self, rows, *a, plain=est.fit: seen.append(rows.count()) or plain(self, rows, *a))
    return seen


def test_importances_of_a_forest_read_no_rows_a_level(data, fitted_rows):
    _, df = data
    model, pred = models.train_and_score("random_forest", "classification", df, df, ["a", "b"], [], "k")
    assert fitted_rows == [3]  # the classes, for the model's parameters
    shares = model.stages[-1].featureImportances.toArray()
    assert model.stages[-1].getNumTrees == 100 and shares.sum() == pytest.approx(1) and (shares > 0.2).all() and pred.count() == 600


def test_compared_trees_read_no_rows_a_level(data, fitted_rows):
    _, df = data
    out = {r["model"]: r for r in models.compare_models("classification", df.where("id % 4 > 0"), df.where("id % 4 = 0"), ["a", "b"], ["g"], "k",
                                                        ["logistic_regression", "decision_tree", "naive_bayes", "random_forest"]).collect()}
    assert fitted_rows == [3, 3] and all(r["error"] is None for r in out.values())
    assert out["random_forest"]["accuracy"] > 0.7 and out["decision_tree"]["accuracy"] > 0.65


@pytest.fixture(scope="module")
def many(spark):
    """More rows than MLlib chooses cuts from."""
    df = spark.range(0, 13_000, 1, 5).select("id", (F.rand(3) - 0.4).alias("x"), F.rand(4).alias("y"), F.rand(5).alias("z"))
    return df.select("id", "x", "y", F.when(F.col("x") + F.col("y") + F.col("z") > 1.1, 1).otherwise(F.col("id") % 3).cast("int").alias("k")).cache()


def test_cuts_of_more_rows_are_mllibs(many):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(many.withColumn("label", F.col("k").cast("double")))
    est = DecisionTreeClassifier(seed=42, maxDepth=8, minInstancesPerNode=3)
    assert celltrees.fit(est, df).toDebugString.split("\n", 1)[1] == est.fit(df).toDebugString.split("\n", 1)[1]


def test_adaboost_of_more_rows_equals_that_of_rows(many, monkeypatch):
    got = models_extra.adaboost_fit(many, ["x", "y"], "k", n_estimators=5)
    monkeypatch.setattr(cells, "MOST", 0)
    want = models_extra.adaboost_fit(many, ["x", "y"], "k", n_estimators=5)
    assert np.allclose(got.alphas, want.alphas) and np.allclose(np.array(got.stumps, float), np.array(want.stumps, float), equal_nan=True)
