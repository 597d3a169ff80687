"""Hyper-parameter search (M9, M10): the grid, a sequential search, and the best model refitted.

A candidate's value is its mean score over stratified folds (accuracy, or R2), with preprocessing
fitted in each fold. ``sequential_search`` proposes each trial from the earlier ones by Parzen
densities (Bergstra et al., 2011): after some random trials, the best tenth and the rest each give
a density for every parameter - a Gaussian at each value seen, cut off at the ends of the
space, plus a wide one - and of some draws from the first that one is tried whose ratio of
densities is largest. Integers and choices have probabilities instead. The sampler sees only
(parameters, value) pairs, one a trial, so nothing of it grows with the data; folds of a trial
are fitted side by side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, models

SEED = 42

# The candidates of the grid search, by model.
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "solver": ["lbfgs", "liblinear"]},
    "decision_tree": {"max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10], "criterion": ["gini", "entropy"]},
    "adaboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]},
    "extra_trees": {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10], "min_samples_split": [2, 5]},
    "mlp": {"hidden_layer_sizes": [(50,), (100,), (50, 50)]},
    "elastic_net": {"alpha": [0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10], "min_samples_split": [2, 5]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "xgboost": {"n_estimators": [50, 100], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.3]},
    "lightgbm": {"n_estimators": [50, 100], "num_leaves": [31, 50], "learning_rate": [0.01, 0.1]},
    "catboost": {"iterations": [50, 100, 200], "depth": [4, 6, 8], "learning_rate": [0.01, 0.1, 0.3]},
}

# The spaces of the sequential search, by model.
SPACES: dict[str, dict[str, tuple]] = {
    "logistic_regression": {"C": ("log_float", 0.001, 100.0), "solver": ("categorical", ["lbfgs", "liblinear"])},
    "decision_tree": {"max_depth": ("int", 2, 30), "min_samples_split": ("int", 2, 20), "criterion": ("categorical", ["gini", "entropy"])},
    "random_forest": {"n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 20), "min_samples_split": ("int", 2, 10)},
    "svm": {"C": ("log_float", 0.01, 100.0), "kernel": ("categorical", ["rbf", "linear"]), "gamma": ("categorical", ["scale", "auto"])},
    "knn": {"n_neighbors": ("int", 1, 21), "weights": ("categorical", ["uniform", "distance"])},
    "xgboost": {"n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 10), "learning_rate": ("log_float", 0.005, 0.5),
                "subsample": ("float", 0.6, 1.0), "colsample_bytree": ("float", 0.6, 1.0)},
    "lightgbm": {"n_estimators": ("int", 50, 300), "num_leaves": ("int", 20, 80), "learning_rate": ("log_float", 0.005, 0.5),
                 "subsample": ("float", 0.6, 1.0)},
    "catboost": {"iterations": ("int", 50, 300), "depth": ("int", 3, 10), "learning_rate": ("log_float", 0.005, 0.5)},
    "lda": {"solver": ("categorical", ["svd", "lsqr", "eigen"])},
}


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x, float) / math.sqrt(2)))


class _Numbers:
    """Density of one number: Gaussians at the values seen and a wide one, cut off at the ends."""

    def __init__(self, values: list[float], low: float, high: float, whole: bool):
        self.low, self.high, self.whole = (low - 0.5, high + 0.5, True) if whole else (low, high, False)
        self.at = np.append(np.asarray(values, float), 0.5 * (self.low + self.high))
        order = np.argsort(self.at, kind="stable")
        ends = np.concatenate([[self.low], self.at[order], [self.high]])
        width = np.empty(len(self.at))
        width[order] = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        span = self.high - self.low
        self.width = np.clip(width, span / min(100.0, 1 + len(self.at)), span)
        self.width[-1] = span

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = []
        while len(out) < n:
            i = rng.integers(len(self.at))
            x = rng.normal(self.at[i], self.width[i])
            if self.low <= x <= self.high:
                out.append(min(max(round(x), math.ceil(self.low)), math.floor(self.high)) if self.whole else x)
        return np.array(out)

    def log(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)[:, None]
        mass = _phi((self.high - self.at) / self.width) - _phi((self.low - self.at) / self.width)
        if self.whole:
            p = _phi((x + 0.5 - self.at) / self.width) - _phi((x - 0.5 - self.at) / self.width)
        else:
            p = np.exp(-0.5 * ((x - self.at) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi))
        return np.log((p / mass).mean(1) + 1e-300)


class _Choices:
    def __init__(self, values: list[int], n: int):
        p = np.bincount(np.asarray(values, int), minlength=n) + 1.0
        self.p = p / p.sum()

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.choice(len(self.p), n, p=self.p)

    def log(self, x: np.ndarray) -> np.ndarray:
        return np.log(self.p[np.asarray(x, int)])


class ParzenSampler:
    """Proposes parameters from the trials so far, [(parameters, value to maximise)]. Same seed and trials, same proposal."""

    def __init__(self, space: dict[str, tuple], seed: int = SEED, n_startup: int = 10, n_candidates: int = 24):
        self.space, self.seed, self.n_startup, self.n_candidates = space, seed, n_startup, n_candidates
        for name, spec in space.items():
            if spec[0] not in ("int", "float", "log_float", "categorical"):
                raise ValueError(f"parameter '{name}': unknown kind '{spec[0]}'")

    def _inside(self, spec: tuple, value: Any):
        return spec[1].index(value) if spec[0] == "categorical" else math.log(value) if spec[0] == "log_float" else value

    def _outside(self, spec: tuple, x: float):
        kind = spec[0]
        if kind == "categorical":
            return spec[1][int(x)]
        if kind == "int":
            return int(x)
        return float(min(max(math.exp(x) if kind == "log_float" else x, spec[1]), spec[2]))

    def _density(self, spec: tuple, values: list):
        seen = [self._inside(spec, v) for v in values]
        if spec[0] == "categorical":
            return _Choices(seen, len(spec[1]))
        low, high = (self._inside(spec, v) for v in spec[1:3])
        return _Numbers(seen, low, high, spec[0] == "int")

    def propose(self, trials: Sequence[tuple[dict, float]]) -> dict:
        rng = np.random.default_rng([self.seed, len(trials)])
        known = [t for t in trials if t[1] is not None and math.isfinite(t[1])]
        if len(trials) < self.n_startup or not known:
            return {k: self._random(spec, rng) for k, spec in self.space.items()}
        order = sorted(range(len(known)), key=lambda i: (-known[i][1], i))
        n_good = min(math.ceil(0.1 * len(known)), 25)
        out = {}
        for name, spec in self.space.items():
            good, rest = (self._density(spec, [known[i][0][name] for i in part]) for part in (order[:n_good], order[n_good:]))
            x = good.draw(rng, self.n_candidates)
            out[name] = self._outside(spec, x[int(np.argmax(good.log(x) - rest.log(x)))])
        return out

    def _random(self, spec: tuple, rng: np.random.Generator):
        if spec[0] == "categorical":
            return spec[1][int(rng.integers(len(spec[1])))]
        if spec[0] == "int":
            return int(rng.integers(spec[1], spec[2] + 1))
        return self._outside(spec, rng.uniform(self._inside(spec, spec[1]), self._inside(spec, spec[2])))


@dataclass
class Search:
    """trials: one row a candidate, in order; model: refitted on all rows with best_params; test_score of it, or None."""
    model_name: str
    best_params: dict
    best_score: float
    trials: DataFrame
    model: Any
    test_score: float | None


def shown(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=list)


def score_of(pred: DataFrame, task: str) -> float | None:
    if task == "classification":
        value = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    else:
        value = evaluate.regression_metrics(pred, "label", "prediction").first()["r2"]
    return None if value is None else float(value)


class _Folds:
    def __init__(self, df: DataFrame, numeric, categorical, label: str, key: str, model_name: str, task: str, k: int, at_once: int):
        self.args = (numeric, categorical, label)
        self.model_name, self.task, self.k, self.at_once = model_name, task, k, at_once
        used = list(dict.fromkeys([*numeric, *categorical, label]))
        self.kept = models.fold_column(df.dropna(subset=used), label if task == "classification" else None, key, k, col="_fold").select(*used, "_fold").persist()
        self.rows = models.gathered(self.kept)
        self.prepared: list[models.PreparedFold] | None = None
        self.known: dict[str, tuple[list, list]] = {}

    def _fold(self, f: int) -> models.PreparedFold:
        return models.PreparedFold(self.model_name, self.task, self.rows, F.col("_fold") != f, F.col("_fold") == f, ["_fold"], *self.args)

    def all_scores(self, candidates: Sequence[dict], with_train: bool = False) -> list[tuple[list, list]]:
        """(test scores, train scores) by fold, of every candidate. Candidates that set their estimator alike have one
        model; it is fitted once."""
        with ThreadPoolExecutor(self.at_once) as pool:
            if self.prepared is None:
                self.prepared = list(pool.map(self._fold, range(self.k)))

            def one(at: tuple[dict, int]) -> tuple:
                params, f = at
                fold = self.prepared[f]
                pred = fold.predictions(params, with_train)
                if not with_train:
                    return score_of(pred, self.task), None
                if self.task == "classification":  # both in one job
                    right = (F.col("label") == F.col("prediction")).cast("double")
                    return tuple(pred.agg(F.avg(F.when(fold.held, right)), F.avg(F.when(fold.train, right))).first())
                return score_of(pred.where(fold.held), self.task), score_of(pred.where(fold.train), self.task)

            alike = [shown(models.effective(self.model_name, c)) for c in candidates]
            new = {a: c for a, c in zip(alike, candidates, strict=True) if a not in self.known}
            both = list(pool.map(one, [(c, f) for c in new.values() for f in range(self.k)]))
        for i, a in enumerate(new):
            part = both[i * self.k:(i + 1) * self.k]
            self.known[a] = ([x for x, _ in part], [y for _, y in part])
        return [self.known[a] for a in alike]

    def close(self) -> None:
        for rows in (self.kept, *(p.rows for p in self.prepared or ())):
            rows.unpersist()


def _refit(df, test, numeric, categorical, label, model_name, task, params) -> tuple[Any, float | None]:
    model, pred = models.train_and_score(model_name, task, df, test if test is not None else df, numeric, categorical, label, params=params)
    return model, score_of(pred, task) if test is not None else None


def search_trials(value_of: Callable[[dict], float | None], space: dict[str, tuple], n_trials: int, seed: int = SEED) -> list[tuple[dict, float | None]]:
    """Trials in order; a candidate that cannot be evaluated has no value."""
    sampler, trials = ParzenSampler(space, seed), []
    for _ in range(n_trials):
        params = sampler.propose(trials)
        try:
            value = value_of(params)
        except Exception:  # noqa: BLE001 - the trial failed, the search goes on
            value = None
        trials.append((params, value))
    return trials


def sequential_search(df: DataFrame, numeric, categorical, label: str, key: str, model_name: str, task: str = "classification",
                      space: dict[str, tuple] | None = None, n_trials: int = 50, k: int = 3, seed: int = SEED,
                      test: DataFrame | None = None, at_once: int = 3) -> Search:
    """Maximise the mean fold score; ``trials`` has trial, params (JSON) and value."""
    space = space or SPACES.get(model_name)
    if space is None:
        raise ValueError(f"model '{model_name}' has no search space; choose from {sorted(SPACES)}")
    folds = _Folds(df, numeric, categorical, label, key, model_name, task, k, at_once)

    def value_of(params: dict) -> float | None:
        scores = folds.all_scores([params])[0][0]
        return None if None in scores else sum(scores) / k

    trials = search_trials(value_of, space, n_trials, seed)
    folds.close()
    known = [(v, -i) for i, (_, v) in enumerate(trials) if v is not None]
    if not known:
        raise ValueError(f"no trial of '{model_name}' could be evaluated")
    best, at = max(known)
    params = trials[-at][0]
    model, test_score = _refit(df, test, numeric, categorical, label, model_name, task, params)
    log = df.sparkSession.createDataFrame([(i, shown(p), v) for i, (p, v) in enumerate(trials)], "trial int, params string, value double")
    return Search(model_name, params, best, log, model, test_score)


def grid_search(df: DataFrame, numeric, categorical, label: str, key: str, model_name: str, task: str = "classification",
                grid: dict[str, list] | None = None, k: int = 3, test: DataFrame | None = None, at_once: int = 8) -> Search:
    """M9: every candidate; ``trials`` has params, mean and standard deviation of the test scores, the mean train
    score and the rank. Equal means rank equally; the first of them is refitted."""
    grid = grid or GRIDS.get(model_name)
    if grid is None:
        raise ValueError(f"model '{model_name}' has no grid; choose from {sorted(GRIDS)}")
    folds = _Folds(df, numeric, categorical, label, key, model_name, task, k, at_once)
    candidates = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    rows = [(params, float(np.mean(on_test)), float(np.std(on_test)), float(np.mean(on_train)))
            for params, (on_test, on_train) in zip(candidates, folds.all_scores(candidates, with_train=True), strict=True)]
    folds.close()
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    model, test_score = _refit(df, test, numeric, categorical, label, model_name, task, rows[best][0])
    table = df.sparkSession.createDataFrame([(shown(p), *r) for p, *r in rows],
                                            "params string, mean_test_score double, std_test_score double, mean_train_score double")
    return Search(model_name, rows[best][0], rows[best][1], evaluate.cv_rank(table, "mean_test_score"), model, test_score)
