"""Evaluation (M1-M6, M11, M13): metrics as aggregates over (label, prediction[, score])."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import label_pairs, ordered_prefix


def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M3 (sparse): observed (label, prediction, count) cells."""
    return (df.select(F.col(y).cast("string").alias("label"), F.col(yhat).cast("string").alias("prediction"))
            .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M3: every (label, prediction) pair over the label set (null is a label), zeros filled.
    The grid is made from the distinct label table by joins; no label reaches the driver."""
    cells = confusion_counts(df, y, yhat).persist(StorageLevel.MEMORY_AND_DISK)
    labels = cells.select("label").union(cells.select("prediction")).distinct()
    grid = label_pairs(labels, "label").select(F.col("a.label").alias("label"), F.col("b.label").alias("prediction"))
    seen = cells.select(F.col("label").alias("_l"), F.col("prediction").alias("_p"), "count")
    same = grid["label"].eqNullSafe(seen["_l"]) & grid["prediction"].eqNullSafe(seen["_p"])
    return grid.join(seen, same, "left").select("label", "prediction", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M4: per class precision, recall, f1, support (0 on zero division)."""
    cells = confusion_counts(df, y, yhat)
    tp = cells.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"), F.col("count").alias("tp"))
    sup = cells.groupBy(F.col("label").alias("class")).agg(F.sum("count").alias("support"))
    pred = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("count").alias("predicted"))
    t = sup.join(pred, "class", "full_outer").join(tp, "class", "left").na.fill(0, ["support", "predicted", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return t.select("class", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"))


def report_with_averages(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M4, whole: the classes' rows, then accuracy (its value in the three scores) and the plain and the
    support-weighted means of the classes, each with the number of rows."""
    rep = classification_report(df, y, yhat).persist(StorageLevel.MEMORY_AND_DISK)
    n = F.sum("support").alias("support")
    scores = ("precision", "recall", "f1")
    plain = rep.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in scores), n)
    weighted = rep.agg(F.lit("weighted avg").alias("class"), *(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores), n)
    right = rep.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("a"), n)
    accuracy = right.select(F.lit("accuracy").alias("class"), *(F.col("a").alias(c) for c in scores), "support")
    return rep.union(accuracy).union(plain).union(weighted)


def classification_metrics(df: DataFrame, y: str, yhat: str, positive=None) -> DataFrame:
    """M1/M2: accuracy; precision/recall/F1 binary (positive = the larger label, or the one
    given) when y has exactly two classes, else support-weighted. One row."""
    rep = classification_report(df, y, yhat).where(F.col("support") > 0).persist(StorageLevel.MEMORY_AND_DISK)
    classes = [r["class"] for r in rep.select("class").collect()]
    acc = df.agg(F.avg((F.col(y).cast("string") == F.col(yhat).cast("string")).cast("double")).alias("accuracy"))
    if len(classes) == 2:
        pos = str(positive) if positive is not None else max(classes, key=lambda v: (_num_or_str(v)))
        m = rep.where(F.col("class") == pos).select("precision", "recall", "f1")
    else:
        tot = F.sum("support")
        m = rep.agg((F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                    (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                    (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))
    a = acc.first()[0]
    return m.select(F.lit(a).cast("double").alias("accuracy"), "precision", "recall", "f1")


def _num_or_str(v):
    try:
        return (0, float(v))
    except (TypeError, ValueError):
        return (1, str(v))


def roc_curve(df: DataFrame, y: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """M5: ROC points (fpr, tpr, threshold) from distinct scores in descending order,
    plus the (0, 0, inf) start. Cumulative counts come from ``ordered_prefix`` over the
    distinct-score table (no global window). ``drop_intermediate`` keeps only corners,
    as scikit-learn's default does."""
    spark = df.sparkSession
    d = (df.select(F.col(y).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
         .where(F.col("y").isNotNull() & F.col("s").isNotNull())
         .groupBy("s").agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("cnt")))
    d = d.withColumn("neg", F.col("cnt") - F.col("pos"))
    pref, _ = ordered_prefix(d, [F.desc("s")], weight_col=None, sum_cols=["pos", "neg"])
    P, N = pref.agg(F.sum("pos"), F.sum("neg")).first()
    pts = pref.select("s", F.col("_start").alias("idx"), (F.col("_cum_pos") + F.col("pos")).alias("tps"),
                      (F.col("_cum_neg") + F.col("neg")).alias("fps"))
    start = spark.createDataFrame([(float("inf"), -1, 0, 0)], "s double, idx long, tps long, fps long")
    pts = start.unionByName(pts)
    if drop_intermediate:
        prev = pts.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp0"), F.col("fps").alias("fp0"))
        nxt = pts.select((F.col("idx") - 1).alias("idx"), F.col("tps").alias("tp2"), F.col("fps").alias("fp2"))
        j = pts.join(prev, "idx", "left").join(nxt, "idx", "left")
        keep = (F.col("tp0").isNull() | F.col("tp2").isNull()
                | ((F.col("fp2") - 2 * F.col("fps") + F.col("fp0")) != 0)
                | ((F.col("tp2") - 2 * F.col("tps") + F.col("tp0")) != 0))
        pts = j.where(keep).select("s", "idx", "tps", "fps")
    return pts.select(F.col("idx").alias("point"),
                      F.try_divide(F.col("fps").cast("double"), F.lit(float(N))).alias("fpr"),
                      F.try_divide(F.col("tps").cast("double"), F.lit(float(P))).alias("tpr"),
                      F.col("s").alias("threshold"))


def roc_auc(df: DataFrame, y: str, score: str) -> float | None:
    """M5: AUC with ties counted half (the trapezoid under the full ROC curve)."""
    d = (df.select(F.col(y).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
         .where(F.col("y").isNotNull() & F.col("s").isNotNull())
         .groupBy("s").agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("cnt")))
    d = d.withColumn("neg", F.col("cnt") - F.col("pos"))
    # for each distinct score: negatives tied * (positives above + half tied positives)
    pp, _ = ordered_prefix(d.select("s", "neg", F.col("pos").alias("w")), [F.desc("s")], weight_col="w")
    P, N, area = pp.agg(F.sum("_w"), F.sum("neg"), F.sum(F.col("neg") * (F.col("_start") + F.col("_w") / 2.0))).first()
    if not P or not N:
        return None
    return float(area) / (float(P) * float(N))


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M6: mse, rmse, mae, r2 in one aggregate."""
    e = F.col(y) - F.col(yhat)
    agg = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    return agg.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                      (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def feature_importance(model, names) -> DataFrame:
    """Tree importances or linear coefficients (mean absolute over classes)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if hasattr(model, "featureImportances"):
        vals = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        vals = list(abs(m).mean(axis=0)) if m.shape[0] > 1 else list(m[0])
    elif hasattr(model, "coefficients"):
        vals = list(model.coefficients.toArray())
    else:
        raise ValueError("model has no importances or coefficients")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")


def top_abs(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """K3: top-k rows by absolute value, ties by the other columns."""
    return df.orderBy(F.desc(F.abs(F.col(col))), *[c for c in df.columns if c != col]).limit(k)


def cv_rank(results: DataFrame, score: str = "mean") -> DataFrame:
    """Rank of each tuning result by mean score (min rank on ties); one row per
    candidate, so the window is small."""
    return results.coalesce(1).withColumn("rank_test_score", F.rank().over(Window.orderBy(F.desc(score))))
