"""What iterative fits read and how often: partitions, preprocessing, equal candidates, jobs a level."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import extra_trees, models, models_extra, tuning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(i, float(x), float(y), "uvw"[i % 3], "yes" if x + 0.6 * z > 0 else "no") for i, (x, y, z) in enumerate(rng.normal(0, 1, (240, 3)))]
    return spark.createDataFrame(out, "k long, x double, y double, g string, cls string").cache()


def test_rows_of_a_fit_lie_in_few_partitions(spark, rows):
    many = rows.repartition(90)
    few = models.gathered(many)
    assert few.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(few.collect()) == sorted(rows.collect())
    assert models.gathered(rows.coalesce(1)).rdd.getNumPartitions() == 1


def test_equal_candidates_are_fitted_once_and_score_as_before(rows, monkeypatch):
    fitted, plain = [], models.PreparedFold.predictions

    def counted(self, params, all_rows=False):
        fitted.append(params)
        return plain(self, params, all_rows)

    monkeypatch.setattr(models.PreparedFold, "predictions", counted)
    grid = {"C": [0.02, 2.0], "solver": ["lbfgs", "liblinear"]}
    found = tuning.grid_search(rows, ["x", "y"], ["g"], "cls", "k", "logistic_regression", grid=grid, k=2, test=rows)
    assert len(fitted) == 2 * 2
    got = {r["params"]: r for r in found.trials.collect()}
    folded = models.fold_column(rows, "cls", "k", 2, col="_fold")
    for c in grid["C"]:
        scores = []
        for f in range(2):
            part, held = folded.where(F.col("_fold") != f), folded.where(F.col("_fold") == f)
            pred = models.train_and_score("logistic_regression", "classification", part, held, ["x", "y"], ["g"], "cls", params={"C": c})[1]
            scores.append(tuning.score_of(pred, "classification"))
        for solver in grid["solver"]:
            r = got[tuning.shown({"C": c, "solver": solver})]
            assert r["mean_test_score"] == pytest.approx(np.mean(scores)) and r["std_test_score"] == pytest.approx(np.std(scores))


def test_random_search_prepares_a_fold_once(rows, monkeypatch):
    fits, plain = [], models.Pipeline.fit

    def counted(self, *args):
        fits.append(len(self.getStages()))
        return plain(self, *args)

    monkeypatch.setattr(models.Pipeline, "fit", counted)
    space = {"maxDepth": ("int", 1, 4), "minInstancesPerNode": ("int", 1, 9)}
    found = models.random_search(rows, ["x", "y"], ["g"], "cls", "k", "decision_tree", space, n_trials=4, k=2)
    assert found.count() == 4 and len(fits) == 2
    monkeypatch.undo()
    params = dict(x.split("=") for x in found.orderBy("trial").first()["params"].split(", "))
    folded, scores = models.fold_column(rows, "cls", "k", 2, col="_fold"), []
    for f in range(2):
        pipe = models.build_pipeline("decision_tree", "classification", ["x", "y"], ["g"], "cls", folded)
        pipe.getStages()[-1].setMaxDepth(int(params["maxDepth"])).setMinInstancesPerNode(int(params["minInstancesPerNode"]))
        scores.append(tuning.score_of(pipe.fit(folded.where(F.col("_fold") != f)).transform(folded.where(F.col("_fold") == f)), "classification"))
    assert found.orderBy("trial").first()["value"] == pytest.approx(np.mean(scores))


def test_a_level_of_random_trees_is_one_job(rows, monkeypatch):
    df = rows.withColumn("label", (F.col("cls") == "yes").cast("int"))
    calls, plain = [], extra_trees._ranges

    def counted(*args):
        calls.append(1)
        return plain(*args)

    monkeypatch.setattr(extra_trees, "_ranges", counted)
    for task, label in (("classification", "label"), ("regression", "k")):
        found = []
        for extremes, most in ((extra_trees.EXTREMES, 1), (0, 99)):
            monkeypatch.setattr(extra_trees, "EXTREMES", extremes)
            calls.clear()
            model = extra_trees.extra_trees(df, ["x", "y"], label, task, n_estimators=3, max_depth=5)
            assert 1 <= len(calls) <= most
            found.append(model.trees)
            monkeypatch.undo()
            monkeypatch.setattr(extra_trees, "_ranges", counted)
        for (a, u), (b, v) in zip(*found, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)) and np.allclose(u, v)


def test_error_of_a_stump_comes_from_its_leaves(rows):
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        rows.withColumn("label", (F.col("cls") == "yes").cast("double")).withColumn("w", F.lit(0.25) + F.col("k") / 100))
    tree = DecisionTreeClassifier(maxDepth=1, weightCol="w").fit(df)
    tot, bad = models_extra._leaf_weights(tree)
    want = tree.transform(df).agg(F.sum("w"), F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w")))).first()
    assert tot == pytest.approx(want[0]) and bad == pytest.approx(want[1])
    pure = DecisionTreeClassifier(maxDepth=1, weightCol="w").fit(df.where("label = 1"))
    assert models_extra._leaf_weights(pure)[1] == 0


def test_random_features_in_a_short_plan(rows):
    rng = np.random.default_rng(1)
    W, b = rng.normal(size=(200, 2)), rng.uniform(size=200)
    model = models_extra.RBFSVMModel(["x", "y"], [0.1, -0.2], [0.9, 1.1], W, b, None, None)
    out = model._rff(rows)
    got = np.array([r["features"].toArray() for r in out.orderBy("k").collect()])
    z = (np.array([(r["x"], r["y"]) for r in rows.orderBy("k").collect()]) - [0.1, -0.2]) / [0.9, 1.1]
    assert np.allclose(got, np.sqrt(2 / 200) * np.cos(z @ W.T + b))
    assert out._jdf.queryExecution().analyzed().toString().upper().count("COS(") == 1
