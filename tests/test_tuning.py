"""Sequential search, grid search and balancing inside training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, tuning

SPACE = {"x": ("float", -5.0, 5.0), "r": ("log_float", 1e-4, 10.0), "n": ("int", 1, 40), "c": ("categorical", ["a", "b", "c", "d"])}


def bowl(p):
    return -((p["x"] - 1.3) ** 2) / 4 - (math.log10(p["r"]) + 1.5) ** 2 - ((p["n"] - 29) / 12) ** 2 - (p["c"] != "c")


def test_proposals_beat_random_draws():
    found, drawn = [], []
    for seed in range(12):
        found.append(max(v for _, v in tuning.search_trials(bowl, SPACE, 60, seed)))
        sampler = tuning.ParzenSampler(SPACE, seed, n_startup=60)
        drawn.append(max(bowl(sampler.propose([({}, 0.0)] * i)) for i in range(60)))
    assert np.mean(found) > np.mean(drawn) + 0.1 and np.sum(np.array(found) > drawn) >= 9


def test_proposals_stay_in_the_space_and_repeat():
    trials = tuning.search_trials(lambda p: None if p["n"] % 5 == 0 else bowl(p), SPACE, 40, 3)
    for p, v in trials:
        assert -5 <= p["x"] <= 5 and 1e-4 <= p["r"] <= 10 and 1 <= p["n"] <= 40 and isinstance(p["n"], int) and p["c"] in "abcd"
        assert (v is None) == (p["n"] % 5 == 0)
    assert trials == tuning.search_trials(lambda p: None if p["n"] % 5 == 0 else bowl(p), SPACE, 40, 3)
    with pytest.raises(ValueError, match="unknown kind"):
        tuning.ParzenSampler({"x": ("wide", 0, 1)})


def test_densities_are_densities():
    d = tuning._Numbers([0.2, 0.9, 0.9], 0.0, 1.0, False)
    x = np.linspace(0, 1, 20_001)
    assert np.trapezoid(np.exp(d.log(x)), x) == pytest.approx(1, abs=1e-3)
    d = tuning._Numbers([2, 7, 7], 1, 9, True)
    assert np.exp(d.log(np.arange(1, 10))).sum() == pytest.approx(1)
    draws = d.draw(np.random.default_rng(0), 4000)
    assert draws.min() >= 1 and draws.max() <= 9 and abs((draws == 7).mean() - np.exp(d.log(np.array([7.0])))[0]) < 0.03


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(160):
        rare = i % 8 == 0
        x, y = rng.normal(1.6 if rare else 0.0, 0.8, 2)
        out.append((i, float(x), float(y), "pqr"[i % 3], "rare" if rare else "usual", float(2 * x - y + (i % 3))))
    return spark.createDataFrame(out, "k long, x double, y double, g string, cls string, t double").cache()


def test_sequential_search_of_a_model(rows):
    s = tuning.sequential_search(rows, ["x", "y"], ["g"], "cls", "k", "decision_tree", n_trials=4, k=2, test=rows)
    log = s.trials.orderBy("trial").collect()
    assert [r["trial"] for r in log] == [0, 1, 2, 3] and s.best_score == max(r["value"] for r in log)
    assert tuning.shown(s.best_params) in [r["params"] for r in log] and s.test_score >= 0.85
    assert s.model.stages[-1].getOrDefault("impurity") == s.best_params["criterion"]


def test_sequential_search_for_numbers(rows):
    s = tuning.sequential_search(rows, ["x", "y"], ["g"], "t", "k", "elastic_net", "regression", n_trials=4, k=2,
                                 space={"alpha": ("log_float", 1e-3, 1.0), "l1_ratio": ("float", 0.0, 1.0)}, test=rows)
    assert s.trials.count() == 4 and s.test_score > 0.5
    with pytest.raises(ValueError, match="no search space"):
        tuning.sequential_search(rows, ["x"], [], "cls", "k", "naive_bayes")


def test_grid_search_refits_the_best(rows):
    s = tuning.grid_search(rows, ["x", "y"], [], "cls", "k", "logistic_regression", grid={"C": [1e-4, 1.0]}, k=2, test=rows)
    got = s.trials.orderBy("rank_test_score").collect()
    assert [r["rank_test_score"] for r in got][0] == 1 and s.best_params == {"C": 1.0} and s.best_score == got[0]["mean_test_score"]
    assert s.test_score > 0.85 and all(0 <= r["mean_train_score"] <= 1 for r in got)


def test_grids_and_spaces_name_trainable_models():
    known = set(models.model_names("classification")) | set(models.model_names("regression"))
    assert set(tuning.GRIDS) <= known and set(tuning.SPACES) <= known


@pytest.mark.parametrize("strategy", ["none", "class_weight", "undersample", "smote", "adasyn", "smote_tomek"])
def test_folds_with_every_balancing_and_a_category(rows, strategy):
    cv = models.kfold_cv("classification", rows, ["x", "y"], ["g"], "cls", "k", "logistic_regression", 2, strategy).first()
    assert len(cv["scores"]) == 2 and 0.6 < cv["mean"] <= 1


def test_smote_finds_more_of_the_small_class(rows):
    found = {}
    for strategy in (None, "smote"):
        _, pred = models.train_and_score("logistic_regression", "classification", rows, rows, ["x", "y"], ["g"], "cls", balance_strategy=strategy)
        found[strategy] = pred.where((F.col("cls") == "rare") & (F.col("label") == F.col("prediction"))).count()
    assert found["smote"] > found[None]


def test_unknown_parameters_are_refused(rows):
    with pytest.raises(ValueError, match="no parameter 'depth'"):
        models.train_and_score("decision_tree", "classification", rows, rows, ["x"], [], "cls", params={"depth": 3})


@pytest.mark.parametrize("name, params", [("xgboost", {"n_estimators": 2, "max_depth": 2}), ("lightgbm", {"n_estimators": 2, "num_leaves": 4}),
                                          ("catboost", {"iterations": 2, "depth": 2}), ("extra_trees", {"n_estimators": 3, "max_depth": 3}),
                                          ("knn", {"n_neighbors": 3, "weights": "distance"})])
def test_own_models_take_parameters(rows, name, params):
    for task, label in (("classification", "cls"), ("regression", "t")):
        model, pred = models.train_and_score(name, task, rows, rows, ["x", "y"], ["g"], label, params=params)
        assert pred.where("prediction IS NULL").isEmpty() and pred.count() == 160
        if name != "knn":
            assert abs(model.importance().sum() - 1) < 1e-9
