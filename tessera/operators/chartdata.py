"""Chart-data reductions (C2-C8, C10). Charts are not rendered; the billion-row input is
reduced on Spark to what a chart needs (bin counts, fitted lines, box statistics)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_edges
from .order import ordered_prefix


def _x(c: str):
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def scatter_trend(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """OLS trend line per colour group: n, slope, intercept, r2."""
    keys = [F.col(color).cast("string").alias("group")] if color else []
    xx, yy = _x(x), _x(y)
    src = df.select(*keys, xx.alias("x"), yy.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return src.groupBy(*(["group"] if color else [])).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Per group q1, median, q3 (exact), whiskers at the last points inside 1.5 IQR,
    count of points outside, n. Rows without a group or value are left out. Order statistics
    come from running counts over the distinct values; nothing per group is collected."""
    g = F.col(group).cast("string") if group else F.lit("all")
    src = df.select(g.alias("group"), _x(value).alias("value")).where(F.col("group").isNotNull() & F.col("value").isNotNull())
    dist = src.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))
    pref, _ = ordered_prefix(dist, ["value"], ["group"], weight_col="n", collect_totals=False)
    placed = pref.join(dist.groupBy("group").agg(F.sum("n").alias("total")), "group")

    def at(position):
        here = (F.col("_start") <= position) & (position < F.col("_start") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    stats = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = (F.col("total") - 1) * F.lit(p)
        low = F.floor(rank)
        stats += [at(low).alias(f"{name}_a"), at(F.least(low + 1, F.col("total") - 1)).alias(f"{name}_b"),
                  F.first(rank - low).alias(f"{name}_t")]

    def between(name):
        a, b, t = F.col(f"{name}_a"), F.col(f"{name}_b"), F.col(f"{name}_t")
        return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)

    q = placed.groupBy("group").agg(*stats).select("group", *[between(n).alias(n) for n in ("q1", "median", "q3")])
    width = F.col("q3") - F.col("q1")
    bounds = q.withColumn("lo", F.col("q1") - 1.5 * width).withColumn("hi", F.col("q3") + 1.5 * width)
    j = dist.join(bounds, "group")
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    agg = j.groupBy("group").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).cast("long").alias("outliers"))
    return bounds.join(agg, "group").select("group", F.col("n").cast("long").alias("n"), "q1", "median", "q3",
                                            "whisker_low", "whisker_high", "outliers")


def bar_data(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> DataFrame:
    """C4: category counts, or the sum of y by x (and colour)."""
    keys = [x] + ([color] if color else [])
    src = df.where(F.col(x).isNotNull())
    if y is None:
        return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    return src.groupBy(*keys).agg(F.sum(y).cast("double").alias("value"))


def pie_data(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Category counts with their percent of all rows that have a category; with ``k``
    only the k largest slices."""
    counts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label"))
              .agg(F.count(F.lit(1)).alias("count")))
    total = df.agg(F.count(F.col(col))).first()[0]
    slices = counts.withColumn("percent", F.col("count") * 100.0 / F.lit(total))
    return slices if k is None else slices.orderBy(F.desc("count"), "label").limit(k)


def _uniform_edges(mn: float, mx: float, b: int) -> list[float]:
    lo, hi = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    return [float(e) for e in np.linspace(lo, hi, b + 1)]


def _bin_col(c, edges):
    return (count_edges(c, edges[1:-1], strict=False) + 1).cast("int")


def pair_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """2-D bin counts for every column pair i < j (2-5 columns): one scan, one
    aggregate over (pair, bx, by)."""
    cols = list(cols)
    if not 2 <= len(cols) <= 5:
        raise ValueError("a pair plot takes 2 to 5 columns")
    mm = df.agg(*[F.min(_x(c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                *[F.max(_x(c)).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    edges = {c: _uniform_edges(mm[f"mn{i}"], mm[f"mx{i}"], bins) for i, c in enumerate(cols)}
    items = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            items.append(F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
                                  F.when(_x(a).isNotNull() & _x(b).isNotNull(), _bin_col(_x(a), edges[a])).alias("bx"),
                                  F.when(_x(a).isNotNull() & _x(b).isNotNull(), _bin_col(_x(b), edges[b])).alias("by")))
    long = df.select(F.inline(F.array(*items))).where(F.col("bx").isNotNull())
    return long.groupBy("col_x", "col_y", "bx", "by").agg(F.count(F.lit(1)).alias("count"))


def distribution_shift(expected: DataFrame, actual: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Both samples binned on common equal-width edges: (dataset, bin_id, lower, upper, count)."""
    spark = expected.sparkSession
    e = expected.select(_x(col).alias("v")).where(F.col("v").isNotNull()).withColumn("dataset", F.lit("expected"))
    a = actual.select(_x(col).alias("v")).where(F.col("v").isNotNull()).withColumn("dataset", F.lit("actual"))
    both = e.unionByName(a)
    mn, mx = both.agg(F.min("v"), F.max("v")).first()
    if mn is None:
        return spark.createDataFrame([], "dataset string, bin_id int, lower double, upper double, count long")
    edges = _uniform_edges(mn, mx, bins)
    counts = both.groupBy("dataset", _bin_col(F.col("v"), edges).alias("bin_id")).agg(F.count(F.lit(1)).alias("count"))
    dim = spark.createDataFrame([(d, i + 1, edges[i], edges[i + 1]) for d in ("expected", "actual") for i in range(bins)],
                                "dataset string, bin_id int, lower double, upper double")
    return dim.join(counts, ["dataset", "bin_id"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("long"))


def actual_vs_predicted_range(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """The diagonal reference line spans min..max of both columns."""
    return df.agg(F.least(F.min(y), F.min(yhat)).cast("double").alias("lo"),
                  F.greatest(F.max(y), F.max(yhat)).cast("double").alias("hi"))


def model_bars(scores: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """C11: bars of a model comparison, (model, metric, value); models that failed have no bar."""
    names = list(metrics) if metrics else [c for c in scores.columns if c not in ("model", "error")]
    bars = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return scores.select("model", bars.alias("b")).select("model", "b.metric", "b.value").where(F.col("value").isNotNull())
