"""KS / lift / gain tables (R1-R3) over score deciles.

The reference sorts by score descending and cuts the *row index* with ``qcut``: row i
(0-based) of n lands in bin ``count(edges < i)`` (row 0 in bin 1), where the edges are
numpy's linear quantiles of 0..n-1 - not ``ntile``. Global positions come from
``ordered_prefix`` (range-partitioned sort + broadcast partition offsets), so no
single-partition window touches the rows; ties in score are broken by a key column.
The per-decile aggregate has at most n_bins rows, so the running sums over it are free.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_edges, sort_small
from .order import dedupe_edges, ordered_prefix, pandas_qcut_index_edges


def decile_summary(df: DataFrame, y_col: str | Column, score_col: str | Column, key_col: str,
                   n_bins: int = 10) -> DataFrame:
    """(decile int, count long, events long) - rows ordered by score desc, key asc."""
    y = y_col if isinstance(y_col, Column) else F.col(y_col)
    s = score_col if isinstance(score_col, Column) else F.col(score_col)
    base = (df.select(y.cast("long").alias("_y"), s.cast("double").alias("_score"), F.col(key_col).alias("_key"))
            .where(F.col("_y").isNotNull() & F.col("_score").isNotNull()))
    pref, totals = ordered_prefix(base, [F.desc("_score"), F.asc("_key"), F.asc("_y")])
    n = int(sum(totals.values())) if totals else 0
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "decile int, count long, events long")
    edges = dedupe_edges(pandas_qcut_index_edges(n, n_bins))
    pos = F.col("_start").cast("double")
    decile = F.greatest(F.lit(1), count_edges(pos, edges)).cast("int")
    out = (pref.groupBy(decile.alias("decile"))
           .agg(F.count(F.lit(1)).alias("count"), F.sum("_y").cast("long").alias("events")))
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def _running(col: str) -> Column:
    # at most n_bins rows: a single-partition window over this tiny table is intended
    return F.sum(col).over(Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0))


def ks_table(summary: DataFrame) -> DataFrame:
    summary = summary.coalesce(1)  # <= n_bins rows: windows below need no exchange
    tot = Window.partitionBy(F.lit(1))
    t = (summary.withColumn("non_events", (F.col("count") - F.col("events")).cast("long"))
         .withColumn("event_rate", F.col("events") / F.col("count"))
         .withColumn("cum_events", _running("events").cast("long"))
         .withColumn("cum_non_events", _running("non_events").cast("long"))
         .withColumn("_te", F.sum("events").over(tot))
         .withColumn("_tn", F.sum("non_events").over(tot))
         .withColumn("cum_event_pct", F.try_divide(F.col("cum_events").cast("double"), F.col("_te").cast("double")))
         .withColumn("cum_non_event_pct", F.try_divide(F.col("cum_non_events").cast("double"), F.col("_tn").cast("double")))
         .withColumn("ks", F.abs(F.col("cum_event_pct") - F.col("cum_non_event_pct"))))
    return sort_small(t.select("decile", "count", "events", "non_events", "event_rate", "cum_events", "cum_non_events",
                               "cum_event_pct", "cum_non_event_pct", "ks"), "decile")


def ks_value(summary: DataFrame) -> float | None:
    r = ks_table(summary).agg(F.max("ks")).first()
    return None if r is None else r[0]


def lift_table(summary: DataFrame) -> DataFrame:
    summary = summary.coalesce(1)  # <= n_bins rows: windows below need no exchange
    tot = Window.partitionBy(F.lit(1))
    t = (summary.withColumn("response_rate", F.col("events") / F.col("count"))
         .withColumn("_ce", _running("events"))
         .withColumn("_cc", _running("count"))
         .withColumn("cum_response_rate", F.col("_ce") / F.col("_cc"))
         .withColumn("_overall", F.sum("events").over(tot) / F.sum("count").over(tot))
         .withColumn("cumulative_lift", F.try_divide(F.col("cum_response_rate"), F.col("_overall"))))
    return sort_small(t.select("decile", "response_rate", "cumulative_lift", "cum_response_rate"), "decile")


def gain_table(summary: DataFrame) -> DataFrame:
    summary = summary.coalesce(1)  # <= n_bins rows: windows below need no exchange
    tot = Window.partitionBy(F.lit(1))
    t = (summary.withColumn("_ce", _running("events"))
         .withColumn("cumulative_gain", F.try_divide(F.col("_ce").cast("double"),
                                                     F.sum("events").over(tot).cast("double")))
         .withColumn("percentile", F.col("decile") * (F.lit(100.0) / F.max("decile").over(tot))))
    origin = summary.sparkSession.createDataFrame([(0, 0.0, 0.0)], "decile int, percentile double, cumulative_gain double")
    return sort_small(origin.unionByName(t.select("decile", "percentile", "cumulative_gain")), "decile").select(
        "percentile", "cumulative_gain")
