"""Bin edges (qcut / cut / supervised tree) for many features in one pass.

Plan: ``unpivot`` the features to (feature, value) - an Expand, no shuffle - and
aggregate to distinct (feature, value) with counts. Map-side partial aggregation
shrinks repeated values before the shuffle and turns any hot value into one row, so
skew cannot reach a reducer. Exact quantiles then come from order statistics over that
distinct table (``ordered_prefix``); only the (n_bins+1)*2 order statistics per
feature reach the driver, where numpy's float arithmetic reproduces pandas' edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import dedupe_edges, linear_quantile_plan, linear_quantiles_from_stats, ordered_prefix


def long_values(df: DataFrame, features: Sequence[str], extra: Sequence[str] = (),
                keep_nulls: bool = False) -> DataFrame:
    """(feature, value double, *extra) for numeric features; NaN → null."""
    cols = [F.col(c) for c in extra]
    vals = [F.col(f).cast("double").alias(f) for f in features]
    wide = df.select(*cols, *vals)
    long = wide.unpivot(list(extra), list(features), "feature", "value")
    long = long.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))
    return long if keep_nulls else long.where(F.col("value").isNotNull())


def distinct_counts(long: DataFrame, extra_aggs=()) -> DataFrame:
    """(feature, value, n, *extra) - one row per distinct value of each feature."""
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *extra_aggs)


def exact_quantiles(dist: DataFrame, key_cols: Sequence[str], qs: Sequence[float], weight_col: str = "n",
                    value_col: str = "value") -> dict[tuple, tuple[list[float], int]]:
    """Exact numpy/pandas linear quantiles per key over a distinct-value table.

    ``dist`` holds one row per (key..., value) with a count. Returns
    {key_tuple: (quantiles, n)}. Only the order statistics the quantiles need are read
    back (at most 2 per quantile per key), found by a broadcast join of the wanted
    positions against the per-value [start, start + count) ranges.
    """
    spark = dist.sparkSession
    keys = list(key_cols)
    pref, totals = ordered_prefix(dist.select(*keys, value_col, weight_col), [value_col], keys,
                                  weight_col=weight_col)
    if not totals:
        return {}
    plans = {k: linear_quantile_plan(int(n), qs) for k, n in totals.items()}
    want = [(*k, int(i)) for k, plan in plans.items() for i in sorted({j for p, nx, _ in plan for j in (p, nx)})]
    schema = T.StructType([dist.schema[c] for c in keys] + [T.StructField("_want", T.LongType(), False)])
    want_df = spark.createDataFrame(want, schema)
    cond = [pref[c].eqNullSafe(want_df[c]) for c in keys]
    cond.append((want_df["_want"] >= pref["_start"]) & (want_df["_want"] < pref["_start"] + pref["_w"]))
    hits = (pref.join(F.broadcast(want_df), cond, "inner")
            .select(*[want_df[c] for c in keys], want_df["_want"], pref[value_col]).collect())
    found: dict[tuple, dict[int, float]] = {}
    for r in hits:
        found.setdefault(tuple(r[:len(keys)]), {})[int(r["_want"])] = float(r[value_col])
    out = {}
    for k, plan in plans.items():
        vals = found.get(k, {})
        out[k] = (linear_quantiles_from_stats(plan, lambda i, vals=vals: vals[i]), int(totals[k]))
    return out


def quantile_edges_from_distinct(dist: DataFrame, n_bins: int, weight_col: str = "n"):
    """Exact pandas ``qcut`` edges for every feature of a distinct-value table.

    Returns {feature: (raw_edges, n)} where raw_edges has n_bins+1 entries (duplicates
    not yet dropped). Features with no values are absent.
    """
    res = exact_quantiles(dist, ["feature"], np.linspace(0, 1, n_bins + 1), weight_col)
    return {k[0]: v for k, v in res.items()}


def equal_width_edges(mn: float, mx: float, n_bins: int) -> list[float]:
    """pandas ``cut(x, bins=n_bins)`` edges from the column min/max."""
    if mn == mx:
        lo = mn - (0.001 * abs(mn) if mn != 0 else 0.001)
        hi = mx + (0.001 * abs(mx) if mx != 0 else 0.001)
        return [float(e) for e in np.linspace(lo, hi, n_bins + 1, endpoint=True)]
    bins = np.linspace(mn, mx, n_bins + 1, endpoint=True)
    bins[0] -= (mx - mn) * 0.001
    return [float(e) for e in bins]


def equal_width_edges_multi(long: DataFrame, n_bins: int):
    rows = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                       F.count(F.lit(1)).alias("n")).collect()
    return {r["feature"]: (equal_width_edges(r["mn"], r["mx"], n_bins), int(r["n"])) for r in rows
            if r["mn"] is not None}


def approx_quantiles(long: DataFrame, qs: Sequence[float], accuracy: int = 10_000):
    """Opt-in approximate quantiles: one aggregation with ``percentile_approx`` (a
    fixed-size sketch per feature, mergeable, rank error ~ 1/accuracy). Not equal to pandas'
    interpolated quantiles; use when exactness is not needed at very large scale."""
    rows = long.groupBy("feature").agg(
        F.percentile_approx("value", list(qs), accuracy).alias("q"), F.count(F.lit(1)).alias("n")).collect()
    return {r["feature"]: ([float(v) for v in r["q"]], int(r["n"])) for r in rows}


def feature_edges(df: DataFrame, features: Sequence[str], n_bins: int = 10, method: str = "quantile",
                  approx_accuracy: int | None = None):
    """{feature: deduped edges} for numeric features (pandas qcut / cut semantics).
    ``approx_accuracy`` switches quantile edges to the approximate sketch."""
    long = long_values(df, features)
    if method == "quantile" and approx_accuracy:
        raw = approx_quantiles(long, list(np.linspace(0, 1, n_bins + 1)), approx_accuracy)
    elif method == "quantile":
        dist = distinct_counts(long)
        raw = quantile_edges_from_distinct(dist, n_bins)
    elif method == "equal_width":
        raw = equal_width_edges_multi(long, n_bins)
    else:
        raise ValueError(f"unknown binning method: {method}")
    return {f: dedupe_edges(e) for f, (e, _n) in raw.items()}


def edges_frame(spark, edges: dict, name_col: str = "feature"):
    """Tall (feature, edge_id, edge) DataFrame of edge lists - the A18/A19 query output."""
    rows = [(f, i, float(e)) for f, es in edges.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, f"{name_col} string, edge_id int, edge double")


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
