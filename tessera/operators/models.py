"""Model registry, training, comparison, cross-validation and tuning (E1-E16, M7-M10) on
Spark MLlib. Preprocessing is part of the Pipeline, so it is fitted on training rows
only - also inside every fold.

Scaling note: MLlib's StandardScaler divides by the sample standard deviation; the
standalone ``prep.standardize`` uses the population one. Inside pipelines the factor
sqrt((n-1)/n) is immaterial to the fitted models (it rescales coefficients only).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import celltrees, evaluate

SEED = 42

#: rows a partition of an iterative fit holds before more partitions than two a core are kept
FIT_ROWS = 50_000


def gathered(df: DataFrame) -> DataFrame:
    """Persisted rows in as many partitions as iterative passes need: each pass is a job, and a job over
    hundreds of all but empty partitions takes its time for scheduling. Never more partitions than before."""
    kept = df if df.is_cached else df.persist()
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(kept.count() / FIT_ROWS))
    return kept.coalesce(n)

#: trees grow until their leaves are pure, as the reference's; 30 levels are MLlib's limit
GROWN = {"maxDepth": 30, "minInstancesPerNode": 1}


def _classifiers(n: int, n_classes: int, n_features: int) -> dict[str, Callable]:
    multi = n_classes > 2

    def ovr(est):
        return C.OneVsRest(classifier=est) if multi else est

    return {
        # sklearn C=1 L2 logistic regression: lambda = 1 / (C * n) on the mean loss
        "logistic_regression": lambda: C.LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                                             standardization=False, maxIter=200),
        "decision_tree": lambda: C.DecisionTreeClassifier(seed=SEED, **GROWN),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=100, seed=SEED, cacheNodeIds=True, **GROWN),
        "linear_svm": lambda: ovr(C.LinearSVC(regParam=1.0 / max(n, 1), maxIter=100)),
        "naive_bayes": lambda: _GaussianNB(),
        "gradient_boosting": lambda: ovr(C.GBTClassifier(maxIter=100, seed=SEED)),
        "mlp": lambda: C.MultilayerPerceptronClassifier(layers=[n_features, 100, max(n_classes, 2)], seed=SEED,
                                                        maxIter=200),
    }


_TREE = {
    "max_depth": lambda e, v, n: e.setMaxDepth(30 if v is None else min(v, 30)),
    # a node of v rows or more may be cut: so may one whose halves hold v / 2
    "min_samples_split": lambda e, v, n: e.setMinInstancesPerNode(max(1, v // 2)),
    "criterion": lambda e, v, n: e.setImpurity(v),
}
_FOREST = {"n_estimators": lambda e, v, n: e.setNumTrees(v), **_TREE}
_INVERSE = {"C": lambda e, v, n: e.setRegParam(1.0 / (v * max(n, 1))), "solver": lambda e, v, n: e}  # one optimum, whatever the solver
_ALPHA = {"alpha": lambda e, v, n: e.setRegParam(v), "l1_ratio": lambda e, v, n: e.setElasticNetParam(v)}

#: how parameters, by the names users know, are set on an MLlib estimator for n rows
_SETTERS: dict[str, dict[str, Callable]] = {
    "logistic_regression": _INVERSE, "linear_svm": _INVERSE, "decision_tree": _TREE, "random_forest": _FOREST,
    "ridge": {"alpha": lambda e, v, n: e.setRegParam(v / max(n, 1))}, "lasso": _ALPHA, "elastic_net": _ALPHA,
    "gradient_boosting": {"n_estimators": lambda e, v, n: e.setMaxIter(v), "learning_rate": lambda e, v, n: e.setStepSize(v),
                          "max_depth": lambda e, v, n: e.setMaxDepth(v)},
    "mlp": {"hidden_layer_sizes": lambda e, v, n: e.setLayers([e.getLayers()[0], *v, e.getLayers()[-1]])},
}


#: parameters that change how a model is found, not the model
_SAME_MODEL = {"logistic_regression": ("solver",), "linear_svm": ("solver",), "lda": ("solver",)}


def effective(model_name: str, params: dict) -> dict:
    """The parameters that tell one fitted model from another."""
    return {k: v for k, v in params.items() if k not in _SAME_MODEL.get(model_name, ())}


def _with_params(est, model_name: str, params: dict | None, n: int):
    for k, v in (params or {}).items():
        if k not in _SETTERS.get(model_name, {}):
            raise ValueError(f"model '{model_name}' has no parameter '{k}'")
        est = _SETTERS[model_name][k](est, v, n)
    return est


def _GaussianNB():
    return C.NaiveBayes(modelType="gaussian")


def _regressors(n: int) -> dict[str, Callable]:
    return {
        "linear_regression": lambda: R.LinearRegression(regParam=0.0, solver="normal"),
        # sklearn ridge alpha=1 on the summed loss -> alpha / n on Spark's mean loss
        "ridge": lambda: R.LinearRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False),
        "lasso": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False),
        "elastic_net": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=0.5, standardization=False),
        "decision_tree": lambda: R.DecisionTreeRegressor(seed=SEED, **GROWN),
        "random_forest": lambda: R.RandomForestRegressor(numTrees=100, seed=SEED, cacheNodeIds=True, **GROWN),
        "gradient_boosting": lambda: R.GBTRegressor(maxIter=100, seed=SEED),
    }


def model_names(task: str) -> list[str]:
    """Registry keys per task."""
    if task == "classification":
        return [*_classifiers(1, 2, 1), *_OWN_CLASSIFIERS]
    if task == "regression":
        return [*_regressors(1), *_OWN_REGRESSORS]
    return ["kmeans", "dbscan"]


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], scale: bool = True):
    stages, cols = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True))
            cols.append("_num_s")
        else:
            cols.append("_num")
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i"], outputCols=[f"{c}__v"], dropLast=True))
        cols.append(f"{c}__v")
    stages.append(VectorAssembler(inputCols=cols, outputCol="features"))
    return stages


def _n_features(numeric, categorical, df):
    n = len(numeric)
    for c in categorical:
        n += df.select(c).distinct().count()
    return n


def build_pipeline(model_name: str, task: str, numeric, categorical, label: str, train: DataFrame,
                   weight_col: str | None = None, params: dict | None = None, counts: tuple[int, int, int] | None = None):
    """``counts``: rows, classes and features of ``train``, where they are known."""
    n = counts[0] if counts else train.count()
    stages = feature_stages(numeric, categorical, scale=True)
    if task == "classification":
        classes = counts[1] if counts else train.select(label).distinct().count()
        reg = _classifiers(n, classes, counts[2] if counts else _n_features(numeric, categorical, train))
        stages.insert(0, StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"))
    else:
        reg = _regressors(n)
        stages.insert(0, _Identity(label))
    if model_name not in reg:
        raise KeyError(f"unknown model '{model_name}'; choose from {sorted(reg)}")
    est = _with_params(reg[model_name](), model_name, params, n)
    if weight_col and est.hasParam("weightCol"):
        est = est.setWeightCol(weight_col)
    return Pipeline(stages=stages + [est])


def fitted_pipeline(pipe: Pipeline, train: DataFrame) -> PipelineModel:
    """``pipe`` fitted on ``train``; trees of classes are grown on counted cells where those are few."""
    *prep, est = pipe.getStages()
    if not celltrees.known(est):
        return pipe.fit(train)
    first = Pipeline(stages=prep).fit(train)
    rows = first.transform(train)
    return PipelineModel(stages=[*first.stages, celltrees.fit(est, rows) or est.fit(rows)])


def _Identity(label: str):
    from pyspark.ml.feature import SQLTransformer
    return SQLTransformer(statement=f"SELECT *, CAST(`{label}` AS DOUBLE) AS label FROM __THIS__")


def prepare_data(df: DataFrame, numeric, categorical, label: str, key: str, task: str = "classification",
                 test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Rows complete in features and label (at least 10, else an error) with a column
    ``split`` of 'train' / 'test', stratified by label for classification. A row without a key
    stays. Preprocessing is fitted later, on training rows only."""
    from .clean import dropna_guard
    from .prep import stratified_split
    used = [*numeric, *categorical, label]
    numbers = set(numeric) if task == "classification" else {*numeric, label}
    rows = df.select(*dict.fromkeys([key, *used]))
    for c in numbers & {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")}:
        rows = rows.withColumn(c, F.nanvl(F.col(c), F.lit(None)))  # NaN is missing too
    dropna_guard(rows, used)
    return stratified_split(rows.dropna(subset=used), label if task == "classification" else None, key, test_size, seed)


def _wide(fitted, df: DataFrame, n: int | None = None):
    """Preprocessed rows with one double column per feature: (rows, feature names)."""
    from pyspark.ml.functions import vector_to_array
    out = fitted.transform(df).withColumn("_a", vector_to_array("features"))
    if n is None:
        first = out.select(F.size("_a")).first()
        n = first[0] if first else 0
    names = [f"_f{i}" for i in range(n)]
    return out.select("*", *[F.col("_a")[i].alias(c) for i, c in enumerate(names)]).drop("features"), names


def _knn_predictions(train: DataFrame, test: DataFrame, k: int, classify: bool, weights: str = "uniform") -> DataFrame:
    """Vote or mean of the k nearest training rows; row numbers are fixed by a checkpoint."""
    from ..session import ensure_checkpoint_dir
    from .neighbors import knn_classify, knn_join
    ensure_checkpoint_dir(train.sparkSession)
    numbered = [d.withColumn("_rid", F.monotonically_increasing_id()).checkpoint() for d in (train, test)]
    tr, te = (d.select(F.col("_rid").alias("id"), F.col("_a").alias("v"), "label") for d in numbered)
    if classify:
        pred = knn_classify(tr, te, k, weights=weights)
    else:
        near = knn_join(te.select(F.col("id").alias("qid"), "v"), tr.select(F.col("id").alias("pid"), "v"), k)
        near = near.join(tr.select(F.col("id").alias("pid"), "label"), "pid")
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))  # k rows a query
        w = F.lit(1.0) if weights == "uniform" else F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        pred = near.withColumn("w", w).groupBy(F.col("qid").alias("id")).agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
    return numbered[1].join(pred.withColumnRenamed("id", "_rid"), "_rid").drop("_rid")


def _own_model(name: str, task: str, train: DataFrame, test: DataFrame, names: list[str], params: dict | None = None):
    """(model or None, predictions) of the models that MLlib lacks, over prepared columns."""
    from . import boosting, ensembles_extra, extra_trees
    from . import models_extra as X
    p, classify = dict(params or {}), task == "classification"
    if name == "knn":
        return None, _knn_predictions(train, test, p.pop("n_neighbors", 5), classify, **p)
    if name == "mlp":
        hidden = p.pop("hidden_layer_sizes", (100,))
        if len(hidden) != 1:
            raise ValueError("the MLP regressor has one hidden layer")
        model = X.mlp_regressor_fit(train, names, "label", hidden=hidden[0], **p)
    elif name == "svm":
        if p.get("kernel", "rbf") == "rbf" and set(p) <= {"C", "kernel", "gamma"} and train.select("label").distinct().count() == 2:
            model = X.rbf_svm_fit(train, names, C=p.get("C", 1.0))  # "scale" and "auto" agree on standardised features
        else:
            model = ensembles_extra.svm_probabilities(train, names, "label", **p)
    elif name == "lda":
        p.pop("solver", None)  # one answer, whatever the solver
        model = X.lda_fit(train, names, "label", **p)
    elif name == "adaboost":
        model = (X.adaboost_fit if classify else ensembles_extra.adaboost_r2)(train, names, "label", **p)
    elif name == "extra_trees":
        model = extra_trees.extra_trees(train, names, "label", task, **p)
    else:
        renamed = {"iterations": "n_estimators", "depth": "max_depth"}
        model = boosting.boost(train, names, "label", task, name, **{renamed.get(k, k): v for k, v in p.items()})
    pred = model.transform(test)
    return model, pred.withColumn("prediction", F.col("prediction").cast("double"))


#: models beyond MLlib's, by registry name
_OWN_CLASSIFIERS = ("svm", "knn", "lda", "adaboost", "extra_trees", "xgboost", "lightgbm", "catboost")
_OWN_REGRESSORS = ("mlp", "knn", "adaboost", "extra_trees", "xgboost", "lightgbm", "catboost")
#: strategies that make rows up, from prepared features
_SYNTHETIC = ("smote", "adasyn", "smote_tomek")


def train_and_score(model_name: str, task: str, train: DataFrame, test: DataFrame, numeric, categorical, label: str,
                    weight_col: str | None = None, balanced: bool = False, params: dict | None = None,
                    balance_strategy: str | None = None):
    """Fit on ``train``, predict ``test``; returns (fitted model, predictions). Rows without
    a feature or label are left out of both. ``balanced`` weights training rows by their
    class (models without row weights ignore it). ``params`` are the model's, by the names of
    ``tuning.GRIDS``. ``balance_strategy`` makes up training rows of small classes, from the
    prepared (scaled and one-hot) features, as the reference's pipelines do."""
    used = [*numeric, *categorical, label]
    train, test = train.dropna(subset=used), test.dropna(subset=used)
    if balanced and task == "classification":
        from .prep import with_class_weight
        weight_col = "_class_weight"
        train = with_class_weight(train, label, weight_col)
    own = model_name in (_OWN_CLASSIFIERS if task == "classification" else _OWN_REGRESSORS)
    synthetic = task == "classification" and balance_strategy in _SYNTHETIC
    if not own and not synthetic:
        pipe = build_pipeline(model_name, task, numeric, categorical, label, train, weight_col, params)
        model = fitted_pipeline(pipe, train)
        return model, model.transform(test)
    first = (StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")
             if task == "classification" else _Identity(label))
    fitted = Pipeline(stages=[first, *feature_stages(numeric, categorical)]).fit(train)
    rows, names = _wide(fitted, train)
    scored = _wide(fitted, test, len(names))[0]
    if synthetic:
        rows = _balanced_rows(rows, names, balance_strategy)
    if own:
        return _own_model(model_name, task, rows, scored, names, params)
    n, classes = rows.count(), rows.select("label").distinct().count()
    reg = _classifiers(n, classes, len(names))
    if model_name not in reg:
        raise KeyError(f"unknown model '{model_name}'; choose from {sorted(model_names(task))}")
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = _with_params(reg[model_name](), model_name, params, n).fit(assemble.transform(rows))
    return model, model.transform(assemble.transform(scored))


def _balanced_rows(rows: DataFrame, names: list[str], strategy: str) -> DataFrame:
    """Prepared rows and made-up ones (label, features). Row numbers are fixed by a checkpoint; one of the result
    spares every pass of a fit the neighbour joins."""
    from pyspark.sql.functions import array

    from ..session import ensure_checkpoint_dir
    from .prep import balance
    ensure_checkpoint_dir(rows.sparkSession)
    numbered = rows.select("label", *names).withColumn("_rid", F.monotonically_increasing_id()).checkpoint()
    more = balance(numbered, "label", "_rid", strategy, names)
    return more.select(F.col("label").cast("double").alias("label"), *names).withColumn("_a", array(*names)).checkpoint()


def classification_scores(pred: DataFrame) -> DataFrame:
    m = evaluate.classification_metrics(pred, "label", "prediction")
    auc = None
    if "probability" in pred.columns and pred.select("label").distinct().count() == 2:
        from pyspark.ml.functions import vector_to_array
        auc = evaluate.roc_auc(pred.withColumn("_p1", vector_to_array("probability")[1]), "label", "_p1")
    elif "probability_1" in pred.columns:
        auc = evaluate.roc_auc(pred, "label", "probability_1")
    return m.withColumn("roc_auc", F.lit(auc).cast("double"))


class PreparedFold:
    """One fold of a search: preprocessing is fitted on its training rows once, and every candidate is fitted
    on the preprocessed rows. ``train`` and ``held`` are conditions on columns that ``keep`` names."""

    def __init__(self, model_name: str, task: str, rows: DataFrame, train: Column, held: Column, keep: Sequence[str], numeric, categorical, label: str):
        self.name, self.task, self.train, self.held = model_name, task, train, held
        own = _OWN_CLASSIFIERS if task == "classification" else _OWN_REGRESSORS
        part = rows.where(train)
        if model_name in own:
            first = (StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")
                     if task == "classification" else _Identity(label))
            fitted = Pipeline(stages=[first, *feature_stages(numeric, categorical)]).fit(part)
            wide, self.names = _wide(fitted, rows)
            self.make, self.rows = None, wide.select("label", "_a", *self.names, *keep).persist()
            return
        self.n = part.count()
        classes = part.select(label).distinct().count() if task == "classification" else 0
        n_features = _n_features(numeric, categorical, part)
        *prep, _ = build_pipeline(model_name, task, numeric, categorical, label, part, counts=(self.n, classes, n_features)).getStages()
        self.make = (lambda: _classifiers(self.n, classes, n_features)[model_name]()) if classes else (lambda: _regressors(self.n)[model_name]())
        self.rows = Pipeline(stages=prep).fit(part).transform(rows).select("label", "features", *keep).persist()

    def predictions(self, params: dict | None, all_rows: bool = False) -> DataFrame:
        """Of the held-out rows, or of all, by the model with ``params`` fitted on the training rows."""
        part, scored = self.rows.where(self.train), self.rows if all_rows else self.rows.where(self.held)
        if self.make is None:
            return _own_model(self.name, self.task, part, scored, self.names, params)[1]
        return _with_params(self.make(), self.name, params, self.n).fit(part).transform(scored)


def cross_validated(folded: DataFrame, pipe: Pipeline, maps: Sequence[dict], k: int, parallelism: int) -> list[list[float]]:
    """Accuracy of every candidate (rows) in every fold of the column ``_fold``. Preprocessing is fitted once a
    fold; the fits of all folds and candidates run side by side. Trees are grown on a fold's counted cells."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    metric = MulticlassClassificationEvaluator(metricName="accuracy")
    *prep, est = pipe.getStages()

    def prepared(f: int) -> DataFrame:
        fitted = Pipeline(stages=prep).fit(folded.where(F.col("_fold") != f))
        return fitted.transform(folded).select("label", "features", "_fold")

    def score(at: tuple[int, int]) -> float:
        i, f = at
        model = est.fit(rows[f].where(F.col("_fold") != f), maps[i])
        return metric.evaluate(model.transform(rows[f].where(F.col("_fold") == f)))

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(prepared, range(k)))
        known = list(pool.map(lambda f: celltrees.fold_accuracy(est, maps, rows[f], F.col("_fold") != f), range(k)))
        for f in range(k):
            if known[f] is None:  # every candidate reads the rows
                rows[f].persist()
        left = [(i, f) for i in range(len(maps)) for f in range(k) if known[f] is None]
        fitted = dict(zip(left, pool.map(score, left), strict=True))
    flat = [fitted[i, f] if known[f] is None else known[f][i] for i in range(len(maps)) for f in range(k)]
    for r in rows:
        r.unpersist()
    return [flat[i * k:(i + 1) * k] for i in range(len(maps))]


def compare_models(task: str, train: DataFrame, test: DataFrame, numeric, categorical, label: str,
                   names: Sequence[str] | None = None, weight_col: str | None = None, balanced: bool = False) -> DataFrame:
    """M7: one row per model, metrics rounded to 4; a failing model gets an error text."""
    spark = train.sparkSession
    names = list(names) if names else model_names(task)
    used = list(dict.fromkeys([*numeric, *categorical, label, *([weight_col] if weight_col else [])]))
    train, test = gathered(train.select(*used)), gathered(test.select(*used))

    def one(name: str) -> tuple:
        try:
            _, pred = train_and_score(name, task, train, test, numeric, categorical, label, weight_col, balanced)
            if task == "classification":
                r = classification_scores(pred).first()
                return (name, *[None if r[k] is None else round(float(r[k]), 4)
                                for k in ("accuracy", "precision", "recall", "f1", "roc_auc")], None)
            r = evaluate.regression_metrics(pred, "label", "prediction").first()
            return (name, *[None if r[k] is None else round(float(r[k]), 4) for k in ("r2", "rmse", "mae", "mse")], None)
        except Exception as e:  # noqa: BLE001 - per-model error row, as the reference
            return (name, *([None] * (5 if task == "classification" else 4)), str(e)[:500])

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(one, names))
    if task == "classification":
        schema = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, error string"
    else:
        schema = "model string, r2 double, rmse double, mae double, mse double, error string"
    return spark.createDataFrame(rows, schema)


def fold_column(df: DataFrame, label: str | None, key: str, k: int = 5, seed: int = SEED, col: str = "fold") -> DataFrame:
    """Stratified fold id (0..k-1): position within class in md5 order, modulo k."""
    from .order import ordered_prefix
    grp = F.col(label).cast("string") if label else F.lit("all")
    base = df.withColumn("_cls", grp).withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    pref, _ = ordered_prefix(base, ["_h", key], ["_cls"], collect_totals=False)
    return pref.withColumn(col, (F.col("_start") % k).cast("int")).drop("_cls", "_h", "_start", "_w")


def kfold_cv(task: str, df: DataFrame, numeric, categorical, label: str, key: str, model_name: str, k: int = 5,
             balance_strategy: str | None = None) -> DataFrame:
    """M8: k-fold CV (stratified for classification; accuracy / r2), refitting
    preprocessing and balancing inside each training fold. Mean and population std."""
    from .prep import balance
    used = list(dict.fromkeys([key, *numeric, *categorical, label, "fold"]))
    folded = gathered(fold_column(df, label if task == "classification" else None, key, k).select(*used))
    made_up = balance_strategy if balance_strategy in _SYNTHETIC else None

    def one(f: int) -> float:
        train = folded.where(F.col("fold") != f)
        test = folded.where(F.col("fold") == f)
        if task == "classification" and balance_strategy and not made_up:
            train = balance(train, label, key, balance_strategy, numeric)
        _, pred = train_and_score(model_name, task, train, test, numeric, categorical, label,
                                  balanced=balance_strategy == "class_weight", balance_strategy=made_up)
        if task == "classification":
            return float(pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
        return float(evaluate.regression_metrics(pred, "label", "prediction").first()["r2"])

    with ThreadPoolExecutor(k) as pool:  # a fold's jobs are small beside a cluster; folds fill it
        scores = list(pool.map(one, range(k)))
    mean = sum(scores) / k
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / k)
    return df.sparkSession.createDataFrame(
        [(model_name, k, "accuracy" if task == "classification" else "r2", scores, mean, std)],
        "model string, n_folds int, scoring string, scores array<double>, mean double, std double")


def cv_scores_long(cv: DataFrame) -> DataFrame:
    """C11: k-fold scores as (model, fold, score) rows for a box plot."""
    return cv.select("model", F.posexplode("scores").alias("fold", "score"))


def grid_search(df: DataFrame, numeric, categorical, label: str, key: str, model_name: str,
                grid: dict[str, list], k: int = 3, parallelism: int = 8) -> DataFrame:
    """M9: exhaustive search with k-fold accuracy by ``cross_validated`` on a stratified fold
    column; returns (params, mean_test_score, std_test_score, rank_test_score)."""
    from pyspark.ml.tuning import ParamGridBuilder
    folded = gathered(fold_column(df, label, key, k, col="_fold").select(*dict.fromkeys([*numeric, *categorical, label, "_fold"])))
    pipe = build_pipeline(model_name, "classification", numeric, categorical, label, folded)
    est = pipe.getStages()[-1]
    builder = ParamGridBuilder()
    for p, vals in grid.items():
        builder = builder.addGrid(est.getParam(p), vals)
    maps = builder.build()
    rows = []
    for pm, scores in zip(maps, cross_validated(folded, pipe, maps, k, parallelism), strict=True):
        rows.append((", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda t: t[0].name)), float(np.mean(scores)),
                     float(np.std(scores))))
    res = df.sparkSession.createDataFrame(rows, "params string, mean_test_score double, std_test_score double")
    return evaluate.cv_rank(res, "mean_test_score")


def random_search(df: DataFrame, numeric, categorical, label: str, key: str, model_name: str,
                  space: dict[str, tuple], n_trials: int = 50, k: int = 3, seed: int = SEED,
                  parallelism: int = 8) -> DataFrame:
    """Seeded random search over int / float / log-float / categorical spaces,
    maximising mean CV accuracy. All trials are sampled first and evaluated by
    ``cross_validated`` (parallel fits); returns the trial log (trial, params, value)."""
    rng = random.Random(seed)
    folded = gathered(fold_column(df, label, key, k, col="_fold").select(*dict.fromkeys([*numeric, *categorical, label, "_fold"])))
    pipe = build_pipeline(model_name, "classification", numeric, categorical, label, folded)
    est = pipe.getStages()[-1]
    maps, shown = [], []
    for _t in range(n_trials):
        pm = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "int":
                v = rng.randint(spec[1], spec[2])
            elif kind == "float":
                v = rng.uniform(spec[1], spec[2])
            elif kind == "logfloat":
                v = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            else:
                v = rng.choice(spec[1])
            pm[est.getParam(name)] = v
        maps.append(pm)
        shown.append(", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda t: t[0].name)))
    found = cross_validated(folded, pipe, maps, k, parallelism)
    rows = [(t, shown[t], float(np.mean(v))) for t, v in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, value double")


def top_trials(trials: DataFrame, k: int = 10) -> DataFrame:
    """K4: the k best trials by value (ties by trial number)."""
    return trials.orderBy(F.desc("value"), "trial").limit(k)


def kmeans(df: DataFrame, numeric, categorical=(), k: int = 3):
    """E13 + L13 + M13: standardise/one-hot on all rows, KMeans(k, seed 42); returns
    (predictions, silhouette). MLlib's silhouette uses squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    data = df.dropna(subset=list(numeric) + list(categorical))
    pipe = Pipeline(stages=feature_stages(numeric, categorical) + [K.KMeans(k=k, seed=SEED, featuresCol="features")])
    model = pipe.fit(data)
    pred = model.transform(data)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(pred)
    return pred, sil


def pca_2d(df: DataFrame, features_col: str = "features") -> DataFrame:
    """2-D projection; Spark's PCA does not centre, so centre first."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    scaled = StandardScaler(inputCol=features_col, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=2, inputCol="_c", outputCol="_pc").fit(scaled)
    out = model.transform(scaled).withColumn("_a", vector_to_array("_pc"))
    return out.withColumn("pc1", F.col("_a")[0]).withColumn("pc2", F.col("_a")[1]).drop("_c", "_pc", "_a")
