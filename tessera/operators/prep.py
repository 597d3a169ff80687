"""ML preparation (L1-L8, L12, L13), leakage-safe: every statistic is fitted on the
training rows only.

Splits and samples are deterministic and engine-neutral: rows are ordered by
``md5(concat(key, '-', seed))`` within their class, and exact per-class positions come
from ``ordered_prefix`` (range-partitioned, no per-class window that would put a whole
hot class in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_numeric_type
from .order import ordered_prefix


def label_index(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """L1: strings -> index by sorted string order (0-based); numerics -> integer cast."""
    if is_numeric_type(df.schema[label].dataType):
        return df.withColumn(out, F.col(label).cast("long").cast("double"))
    from pyspark.ml.feature import StringIndexer
    si = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    return si.fit(df).transform(df)


def _hash_order(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def stratified_split(df: DataFrame, label: str | None, key: str, test_size: float = 0.2, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """Per class, the first ceil(test_size * n_class) rows in md5 order are 'test',
    the rest 'train'; with ``label=None`` the whole table is one stratum (plain split)."""
    grp = F.col(label).cast("string") if label else F.lit("all")
    base = df.withColumn("_cls", grp).withColumn("_h", _hash_order(key, seed))
    pref, _ = ordered_prefix(base, ["_h", key], ["_cls"], collect_totals=False, with_total=True)
    n_test = F.ceil(F.lit(test_size) * F.col("_total"))
    return pref.withColumn(split_col, F.when(F.col("_start") < n_test, "test").otherwise("train")).drop(
        "_cls", "_h", "_start", "_w", "_total")


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """L3: (x - mean) / population std with statistics from ``fit_on`` (the training rows)."""
    src = fit_on if fit_on is not None else df
    r = src.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        m, s = r[f"m{i}"], r[f"s{i}"]
        z = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.col(c) - F.lit(m)
        out = out.withColumn(c + suffix, z)
    return out


def one_hot(df: DataFrame, col: str, fit_on: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """L4: all levels kept (alphabetical), unseen levels -> all zeros; array<double> out."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array
    out = out or f"{col}_onehot"
    src = fit_on if fit_on is not None else df
    si = StringIndexer(inputCol=col, outputCol=f"{col}__idx", stringOrderType="alphabetAsc", handleInvalid="keep").fit(src)
    ohe = OneHotEncoder(inputCols=[f"{col}__idx"], outputCols=[f"{col}__vec"], dropLast=True).fit(si.transform(src))
    res = ohe.transform(si.transform(df))
    return res.withColumn(out, vector_to_array(f"{col}__vec")).drop(f"{col}__idx", f"{col}__vec")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, count, weight = n / (k * n_class)); one row per class."""
    agg = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    n, k = agg.agg(F.sum("count"), F.count(F.lit(1))).first()
    return agg.withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("count")))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Rows with the weight of their class (null without a class), joined on the class."""
    w = class_weights(df, label).select(F.col("class").alias("_cls"), F.col("weight").alias(weight_col))
    return df.join(w, F.col(label).cast("string") == F.col("_cls"), "left").drop("_cls")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the minority size, keeping the first rows in md5 order."""
    base = df.withColumn("_cls", F.col(label).cast("string")).withColumn("_h", _hash_order(key, seed))
    pref, _ = ordered_prefix(base, ["_h", key], ["_cls"], collect_totals=False, with_total=True)
    m = pref.agg(F.min("_total")).first()[0] or 0
    return pref.where(F.col("_start") < m).drop("_cls", "_h", "_start", "_w", "_total")


def balance(df: DataFrame, label: str, key: str, strategy: str | None, features: Sequence[str] = (), seed: int = 42):
    """None / class_weight -> unchanged (weights are a training option); undersample;
    smote / adasyn / smote_tomek -> synthetic minority rows; unknown -> unchanged."""
    if strategy in (None, "none", "class_weight"):
        return df
    if strategy == "undersample":
        return undersample(df, label, key, seed)
    if strategy in ("smote", "adasyn", "smote_tomek"):
        from .sampling import adasyn, smote, smote_tomek
        fn = {"smote": smote, "adasyn": adasyn, "smote_tomek": smote_tomek}[strategy]
        return fn(df, label, key, list(features), seed=seed)
    return df


def class_distribution_before_after(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts and ratios before and after balancing, tagged."""
    from .profile import class_distribution
    return (class_distribution(before, label).withColumn("stage", F.lit("before"))
            .unionByName(class_distribution(after, label).withColumn("stage", F.lit("after"))))


def passthrough_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remaining columns as numeric features - booleans to 0/1, timestamps and dates
    to epoch seconds, numbers unchanged (so a VectorAssembler can take them)."""
    from pyspark.sql import types as T
    out = df
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.BooleanType):
            out = out.withColumn(c, F.col(c).cast("double"))
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            out = out.withColumn(c, F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
                                           f"CAST(`{c}` AS TIMESTAMP_NTZ))").cast("double"))
        elif isinstance(dt, T.DateType):
            out = out.withColumn(c, (F.unix_date(F.col(c)) * 86400).cast("double"))
        else:
            out = out.withColumn(c, F.col(c).cast("double"))
    return out
