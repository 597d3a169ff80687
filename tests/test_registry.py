"""Every registered model trains; incomplete rows are left out; class weights change a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        c = i % 2
        x, y = rng.normal(3.0 * c, 0.7, 2)
        rows.append((i, float(x), None if i % 40 == 3 else float(y), "pq"[(i // 2) % 2], "no yes".split()[c], float(2 * x - y)))
    df = spark.createDataFrame(rows, "k long, x double, y double, g string, cls string, t double")
    return models.prepare_data(df, ["x", "y"], ["g"], "cls", "k").join(df.select("k", "t"), "k").cache()


def halves(df):
    return df.where("split = 'train'"), df.where("split = 'test'")


@pytest.mark.parametrize("name", ["svm", "knn", "lda"])
def test_classifiers_separate_blobs(blobs, name):
    assert {"adaboost", "linear_svm", "naive_bayes", name} <= set(models.model_names("classification"))
    r = models.compare_models("classification", *halves(blobs), ["x", "y"], ["g"], "cls", [name]).first()
    assert r["error"] is None and r["accuracy"] >= 0.95


@pytest.mark.parametrize("name", ["knn", "linear_regression"])
def test_regressors_follow_a_line(blobs, name):
    assert {"mlp", name} <= set(models.model_names("regression"))
    r = models.compare_models("regression", *halves(blobs), ["x", "y"], ["g"], "t", [name]).first()
    assert r["error"] is None and r["r2"] >= 0.8


def test_prepare_data_leaves_out_incomplete_rows(spark, blobs):
    assert blobs.count() == 234 and blobs.where("y IS NULL").isEmpty()
    counts = {(r["cls"], r["split"]): r["count"] for r in blobs.groupBy("cls", "split").count().collect()}
    assert counts == {("no", "test"): 24, ("no", "train"): 96, ("yes", "test"): 23, ("yes", "train"): 91}
    few = spark.createDataFrame([(i, float(i), "a") for i in range(9)], "k long, x double, c string")
    with pytest.raises(ValueError, match="at least 10"):
        models.prepare_data(few, ["x"], [], "c", "k")


def test_class_weights_change_a_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal(1.2 if i % 20 == 0 else 0.0, 1.0)), "rare" if i % 20 == 0 else "usual") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    found = []
    for balanced in (False, True):
        _, pred = models.train_and_score("logistic_regression", "classification", df, df, ["x"], [], "c", balanced=balanced)
        found.append(pred.where((F.col("c") == "rare") & (F.col("label") == F.col("prediction"))).count())
    assert found[1] > found[0] + 10
