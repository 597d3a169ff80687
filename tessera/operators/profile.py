"""Profiling operators (A1-A17, P14, P15): tall per-column summaries.

Every summary is one scan of the source: columns are unpivoted (Expand, no shuffle)
and aggregated by column name with partial aggregation, so many columns cost one job
instead of one job per column. Quantiles are exact (order statistics of the
distinct-value table, see ``binning.exact_quantiles``) - no single task ever buffers a
whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (categorical_cols, count_edges, is_numeric_type, numeric_cols, require_columns)
from .binning import distinct_counts, exact_quantiles, long_values


def _strings_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*items)))


def _quantile_frame(spark, qres: dict, names: Sequence[str]) -> DataFrame:
    rows = [(k[0], *[float(v) for v in vals]) for k, (vals, _n) in qres.items()]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def _missing(df: DataFrame) -> list:
    """Missing cells per column; NaN is missing, as in every other summary."""
    return [F.count_if(F.col(c).isNull() | F.isnan(c)) if t in ("float", "double") else F.count_if(F.col(c).isNull())
            for c, t in df.dtypes]


def table_shape(df: DataFrame) -> DataFrame:
    """A1: n_rows, n_cols, total_missing, n_numeric, n_categorical (one row, one scan)."""
    miss = _missing(df)
    total = miss[0] if len(miss) == 1 else sum(miss[1:], miss[0])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("total_missing")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), "total_missing",
        F.lit(len(numeric_cols(df))).alias("n_numeric"), F.lit(len(categorical_cols(df))).alias("n_categorical"))


def missing_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """A2 (+P12): column, missing, missing_rate (percent of rows)."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[m.alias(f"m{i}") for i, m in enumerate(_missing(df))])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("missing"))
                               for i, c in enumerate(df.columns)]))
    out = agg.select("_n", stack).select(
        "column", "missing", (F.try_divide(F.col("missing") * 100.0, F.col("_n").cast("double"))).alias("missing_rate"))
    return out.where(F.col("missing") > 0) if only_missing else out


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: column, count, mean, std, min, p25, p50, p75, max (pandas describe, numeric)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    require_columns(df, cols)
    spark = df.sparkSession
    long = long_values(df, cols)
    base = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(distinct_counts(long), ["feature"], [0.25, 0.5, 0.75])
    qf = _quantile_frame(spark, q, ["p25", "p50", "p75"])
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    return (names.join(base, "feature", "left").join(F.broadcast(qf), "feature", "left")
            .select(F.col("feature").alias("column"), F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    "mean", "std", "min", "p25", "p50", "p75", "max"))


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: column, count, unique, top, freq; ``top`` ties go to the lowest value."""
    cols = list(cols) if cols is not None else categorical_cols(df)
    require_columns(df, cols)
    vc = _strings_long(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("cnt"))
    return vc.groupBy("feature").agg(
        F.sum("cnt").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").cast("long").alias("freq")).withColumnRenamed("feature", "column")


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column, count, missing, missing_rate, n_unique, mean, median, std, min, q1, q3, max."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    spark = df.sparkSession
    long = long_values(df, cols, keep_nulls=True)
    dist = distinct_counts(long.where(F.col("value").isNotNull()))
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    nun = dist.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    q = exact_quantiles(dist, ["feature"], [0.5, 0.25, 0.75])
    qf = _quantile_frame(spark, q, ["median", "q1", "q3"])
    return (base.join(nun, "feature", "left").join(F.broadcast(qf), "feature", "left")
            .select(F.col("feature").alias("column"), F.col("count").cast("long").alias("count"),
                    F.col("missing").cast("long").alias("missing"),
                    (F.col("missing") * 100.0 / F.col("_n")).alias("missing_rate"),
                    F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
                    "mean", "median", "std", "min", "q1", "q3", "max"))


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column, count, missing, missing_rate, n_unique, mode, mode_freq."""
    cols = list(cols) if cols is not None else categorical_cols(df)
    long = _strings_long(df, cols)
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    nn = F.col("value").isNotNull()
    return vc.groupBy("feature").agg(
        F.sum(F.when(nn, F.col("cnt")).otherwise(0)).cast("long").alias("count"),
        F.sum(F.when(~nn, F.col("cnt")).otherwise(0)).cast("long").alias("missing"),
        F.sum("cnt").alias("_n"),
        F.count_if(nn).cast("long").alias("n_unique"),
        F.min_by(F.col("value"), F.when(nn, F.struct(-F.col("cnt"), F.col("value")))).alias("mode"),
        F.coalesce(F.max(F.when(nn, F.col("cnt"))), F.lit(0)).cast("long").alias("mode_freq")).select(
        F.col("feature").alias("column"), "count", "missing", (F.col("missing") * 100.0 / F.col("_n")).alias("missing_rate"),
        "n_unique", "mode", "mode_freq")


def column_overview(df: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """A8 overview + J9: column, dtype, missing, missing_rate, n_unique, kind, description."""
    spark = df.sparkSession
    cols = df.columns
    long = _strings_long(df, cols)
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    stats = vc.groupBy("feature").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).cast("long").alias("missing"),
        F.sum("cnt").alias("_n"), F.count_if(F.col("value").isNotNull()).cast("long").alias("n_unique"))
    meta = spark.createDataFrame(
        [(c, df.schema[c].dataType.simpleString(), "numeric" if is_numeric_type(df.schema[c].dataType) else "categorical", i)
         for i, c in enumerate(cols)], "feature string, dtype string, kind string, ord int")
    out = meta.join(stats, "feature", "left")
    if dictionary is not None:
        out = out.join(dictionary.select(F.col("column").alias("feature"), "description"), "feature", "left")
    else:
        out = out.withColumn("description", F.lit(None).cast("string"))
    return out.select(F.col("feature").alias("column"), "dtype", "missing",
                      (F.col("missing") * 100.0 / F.col("_n")).alias("missing_rate"), "n_unique", "kind",
                      F.coalesce("description", F.lit("")).alias("description"))


def outlier_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column with >= 4 values: IQR (1.5) and 3-sigma bounds and counts;
    columns with no outlier under either rule are omitted."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    spark = df.sparkSession
    long = long_values(df, cols)
    stats = {r["feature"]: r for r in long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).collect()}
    keep = [c for c in cols if c in stats and stats[c]["n"] >= 4]
    if not keep:
        return spark.createDataFrame([], "column string, iqr_count long, iqr_lower double, iqr_upper double, "
                                         "sigma_count long, sigma_lower double, sigma_upper double")
    q = exact_quantiles(distinct_counts(long.where(F.col("feature").isin(keep))), ["feature"], [0.25, 0.75])
    bounds = {}
    for c in keep:
        (q1, q3), _ = q[(c,)]
        iqr = q3 - q1
        m, s = stats[c]["mean"], stats[c]["std"]
        bounds[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr, m - 3 * s, m + 3 * s)
    aggs = []
    for i, c in enumerate(keep):
        lo, hi, slo, shi = bounds[c]
        x = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
        aggs.append(F.count_if((x < lo) | (x > hi)).alias(f"i{i}"))
        aggs.append(F.count_if((x < slo) | (x > shi)).alias(f"s{i}"))
    counts = df.agg(*aggs)
    stack = F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"i{i}").cast("long").alias("iqr_count"),
        F.lit(bounds[c][0]).alias("iqr_lower"), F.lit(bounds[c][1]).alias("iqr_upper"),
        F.col(f"s{i}").cast("long").alias("sigma_count"),
        F.lit(bounds[c][2]).alias("sigma_lower"), F.lit(bounds[c][3]).alias("sigma_upper")) for i, c in enumerate(keep)]))
    return counts.select(stack).where((F.col("iqr_count") > 0) | (F.col("sigma_count") > 0))


def outlier_rows(df: DataFrame, col: str, rule: str = "iqr") -> DataFrame:
    """Rows of df outside the IQR fence (or 3-sigma band) of ``col``."""
    long = long_values(df, [col])
    if rule == "iqr":
        q = exact_quantiles(distinct_counts(long), ["feature"], [0.25, 0.75])
        if (col,) not in q:
            return df.limit(0)
        (q1, q3), _ = q[(col,)]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    else:
        r = long.agg(F.avg("value"), F.stddev_samp("value")).first()
        lo, hi = r[0] - 3 * r[1], r[0] + 3 * r[1]
    x = F.col(col).cast("double")
    return df.where((x < lo) | (x > hi))


def value_counts(df: DataFrame, col: str, k: int | None = 10) -> DataFrame:
    """A10/K5: (value, count) by count desc then value; nulls dropped; top k."""
    out = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
           .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value"))
    return out.limit(k) if k else out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tall contingency table (a, b, count); pairs with a null dropped."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b)
            .agg(F.count(F.lit(1)).alias("count")))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group, count, mean, std (null group keys dropped, as pandas groupby)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")))


def class_distribution(df: DataFrame, y: str) -> DataFrame:
    """Class (string), count, ratio rounded to 4."""
    agg = df.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    total = df.where(F.col(y).isNotNull()).count()
    return agg.withColumn("ratio", F.round(F.col("count") / F.lit(float(total) if total else None), 4))


def histogram_bins(n: int) -> int:
    return int(min(30, max(5, n // 10)))


def histogram(df: DataFrame, col: str, bins: int | None = None, group: str | None = None,
              density: bool = False) -> DataFrame:
    """Equal-width histogram as ``np.histogram`` (last bin closed); empty bins
    kept. ``bins`` defaults to min(30, max(5, n // 10)). With ``group`` the same edges
    are used for every group. ``density`` adds count / (n * width)."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    src = df.select(x.alias("_x"), *( [F.col(group).alias("_g")] if group else []))
    src = src.where(F.col("_x").isNotNull())
    r = src.agg(F.count(F.lit(1)), F.min("_x"), F.max("_x")).first()
    n, mn, mx = int(r[0]), r[1], r[2]
    schema = ("bin_id int, lower double, upper double, count long" if not group
              else "group string, bin_id int, lower double, upper double, count long")
    if n == 0:
        return spark.createDataFrame([], schema)
    b = bins or histogram_bins(n)
    lo, hi = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    edges = [float(e) for e in np.linspace(lo, hi, b + 1)]
    bin_id = (count_edges(F.col("_x"), edges[1:-1], strict=False) + 1).cast("int")
    keys = [F.col("_g").cast("string").alias("group")] if group else []
    counts = src.groupBy(*keys, bin_id.alias("bin_id")).agg(F.count(F.lit(1)).alias("count"))
    dim = spark.createDataFrame([(i + 1, edges[i], edges[i + 1]) for i in range(b)],
                                "bin_id int, lower double, upper double")
    if group:
        # every (group, bin) cell: each distinct group expands to its b bin ids, then an
        # equi-join with the (<= 30 row) bin dimension - no cartesian product
        cells = counts.select("group").distinct().select("group", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("bin_id"))
        out = (cells.join(F.broadcast(dim), "bin_id", "inner")
               .join(counts, ["group", "bin_id"], "left"))
    else:
        out = dim.join(counts, ["bin_id"], "left")
    out = out.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    if density:
        if not group:
            out = out.coalesce(1)  # b <= 30 bins: the total needs no exchange
        tot = Window.partitionBy("group") if group else Window.partitionBy(F.lit(1))
        out = out.withColumn("density", F.col("count") / (F.sum("count").over(tot) * (F.col("upper") - F.col("lower"))))
    return out


def chart_recommendation(df: DataFrame) -> DataFrame:
    """Column, kind, recommended chart from cardinality."""
    ov = column_overview(df)
    n = df.count()
    cnt = F.lit(n) - F.col("missing")
    ratio = F.col("n_unique") / F.greatest(cnt, F.lit(1))
    num = (F.when((ratio < 0.05) | (F.col("n_unique") <= 10), "bar")
           .when(F.col("n_unique") > 30, "histogram").otherwise("box"))
    cat = F.when(F.col("n_unique") <= 6, "pie").otherwise("bar")
    return ov.select("column", "kind", F.when(F.col("kind") == "numeric", num).otherwise(cat).alias("chart"))


def target_guess(df: DataFrame) -> DataFrame:
    """First numeric column with <= 5 distinct values is the target, else the last
    column; every other column is a feature. Output (column, role, ord)."""
    spark = df.sparkSession
    nums = numeric_cols(df)
    target = None
    if nums:
        # exact distinct counts of all numeric columns in one aggregate
        capped = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(nums)]).first()
        for i, c in enumerate(nums):
            if capped[f"d{i}"] <= 5:
                target = c
                break
    if target is None:
        target = df.columns[-1]
    rows = [(c, "target" if c == target else "feature", i) for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "column string, role string, ord int")


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _micros(c: str):
    """Microseconds since the epoch of a timestamp column, independent of the session
    time zone (timestamp_ntz arithmetic)."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST(`{c}` AS TIMESTAMP_NTZ))")


def _from_micros(x):
    return F.expr(f"timestampadd(MICROSECOND, CAST(round({x}) AS BIGINT), {_EPOCH})")


def describe_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: column, count, mean, min, p25, p50, p75, max for timestamp columns (no std);
    quartiles by linear interpolation on the microsecond scale."""
    from ..functions.exprs import datetime_cols
    cols = list(cols) if cols is not None else datetime_cols(df)
    spark = df.sparkSession
    wide = df.select(*[_micros(c).cast("double").alias(c) for c in cols])
    long = long_values(wide, cols)
    # exact mean of integral microseconds (a double sum would drift by microseconds)
    base = long.groupBy("feature").agg(F.count(F.lit(1)).alias("count"),
                                       F.avg(F.col("value").cast("decimal(38,0)")).alias("_mean"),
                                       F.min("value").alias("_min"), F.max("value").alias("_max"))
    q = exact_quantiles(distinct_counts(long), ["feature"], [0.25, 0.5, 0.75])
    qf = _quantile_frame(spark, q, ["_p25", "_p50", "_p75"])
    j = base.join(F.broadcast(qf), "feature", "left")
    return j.select(F.col("feature").alias("column"), F.col("count").cast("long").alias("count"),
                    *[_from_micros(c).alias(c[1:]) for c in ["_mean", "_min", "_p25", "_p50", "_p75", "_max"]])


_WIDTH = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "double": 8, "float": 4, "boolean": 1,
          "timestamp": 8, "timestamp_ntz": 8, "date": 4}


def memory_usage(df: DataFrame) -> DataFrame:
    """Estimated bytes per column: fixed width x non-null rows for fixed-width
    types, UTF-8 bytes for strings (one aggregate)."""
    aggs = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            aggs.append(F.coalesce(F.sum(F.octet_length(F.col(f.name))), F.lit(0)).cast("long").alias(f.name))
        else:
            aggs.append((F.count(F.col(f.name)) * F.lit(_WIDTH.get(t, 8))).cast("long").alias(f.name))
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bytes")) for c in df.columns])))


def api_summary(df: DataFrame) -> DataFrame:
    """One row per column - dtype, missing, and the statistics of its kind (numeric:
    mean, std, min, max; categorical: unique, top, freq). Built from A8 overview, A3 and
    A4, each one pass."""
    ov = column_overview(df).select("column", "dtype", "missing", "kind")
    nums = numeric_cols(df)
    cats = categorical_cols(df)
    out = ov
    if nums:
        d = describe_numeric(df, nums).select("column", "mean", "std", "min", "max")
        out = out.join(d, "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max")])
    if cats:
        c = describe_categorical(df, cats).select("column", "unique", "top", "freq")
        out = out.join(c, "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
                         F.lit(None).cast("long").alias("freq"))
    return out
