"""Scorecard queries: PSI (A23, A24), WOE/IV (A20-A22, A26) and KS/lift/gain.

Each query reads the driver tables at ``sf_dir`` and runs one operator over whole tables;
the paired DuckDB SQL is its oracle. Column names and types match on both sides and
doubles are rounded to 6 digits in both engines before comparison.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.exprs import IV_ELSE, IV_LADDER, PSI_ELSE, PSI_LADDER, ladder_sql
from ..operators import risk, scorecard
from .registry import qs_sql as _qs_sql
from .registry import register
from .tables import round_doubles, table, ts

SHIP_SPLIT = "1998-06-01"
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


# ---------------------------------------------------------------------------
# PSI (A23, A24, J1, J2) - lineitem split by ship date
# ---------------------------------------------------------------------------

def _psi_sql_core(columns, bins=10) -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    on = ", ".join(columns)
    return f"""
WITH ew AS (SELECT {cols} FROM lineitem WHERE l_shipdate < TIMESTAMP '{SHIP_SPLIT}'),
aw AS (SELECT {cols} FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SHIP_SPLIT}'),
e AS (SELECT variable, value FROM (UNPIVOT ew ON {on} INTO NAME variable VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)),
a AS (SELECT variable, value FROM (UNPIVOT aw ON {on} INTO NAME variable VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT variable, list_sort(list_distinct(quantile_cont(value, {_qs_sql(bins)}))) AS edges FROM e GROUP BY variable),
qq AS (SELECT variable, edges, len(edges) - 1 AS k, edges[2:len(edges) - 1] AS inner_edges FROM q WHERE len(edges) >= 2),
dim AS (SELECT variable, k, CAST(i AS INTEGER) AS bin_id,
               CASE WHEN i = 1 THEN CAST('-inf' AS DOUBLE) ELSE edges[i] END AS lower,
               CASE WHEN i = k THEN CAST('inf' AS DOUBLE) ELSE edges[i + 1] END AS upper
        FROM (SELECT variable, k, edges, unnest(range(1, k + 1)) AS i FROM qq)),
ec AS (SELECT e.variable, CAST(1 + len(list_filter(qq.inner_edges, lambda x: x < e.value)) AS INTEGER) AS bin_id, count(*) AS c
       FROM e JOIN qq USING (variable) GROUP BY ALL),
ac AS (SELECT a.variable, CAST(1 + len(list_filter(qq.inner_edges, lambda x: x < a.value)) AS INTEGER) AS bin_id, count(*) AS c
       FROM a JOIN qq USING (variable) GROUP BY ALL),
t AS (SELECT d.variable, d.bin_id, d.lower, d.upper, d.k,
             CAST(coalesce(ec.c, 0) AS BIGINT) AS expected_count, CAST(coalesce(ac.c, 0) AS BIGINT) AS actual_count
      FROM dim d LEFT JOIN ec USING (variable, bin_id) LEFT JOIN ac USING (variable, bin_id)),
p AS (SELECT *, (expected_count + CAST(0.5 AS DOUBLE)) / (sum(expected_count) OVER (PARTITION BY variable) + CAST(0.5 AS DOUBLE) * k) AS expected_pct,
                (actual_count + CAST(0.5 AS DOUBLE)) / (sum(actual_count) OVER (PARTITION BY variable) + CAST(0.5 AS DOUBLE) * k) AS actual_pct
      FROM t),
pc AS (SELECT *, (actual_pct - expected_pct) * ln(actual_pct / expected_pct) AS psi_component FROM p)"""


def _psi_split(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_shipdate") < ts(SHIP_SPLIT)), li.where(F.col("l_shipdate") >= ts(SHIP_SPLIT))


@register("a23_psi_table", _psi_sql_core(["l_extendedprice"]) + """
SELECT variable, bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, expected_count, actual_count,
       round(expected_pct, 6) AS expected_pct, round(actual_pct, 6) AS actual_pct, round(psi_component, 6) AS psi_component
FROM pc""")
def q_a23_psi_table(spark, sf):
    exp, act = _psi_split(spark, sf)
    return round_doubles(scorecard.psi_table(exp, act, "l_extendedprice", bins=10))


@register("a24_psi_report", _psi_sql_core(LINEITEM_NUM) + f"""
SELECT variable, round(sum(psi_component), 4) AS psi,
       {ladder_sql('round(sum(psi_component), 4)', PSI_LADDER, PSI_ELSE)} AS stability,
       CAST(NULL AS VARCHAR) AS error
FROM pc GROUP BY variable""")
def q_a24_psi_report(spark, sf):
    exp, act = _psi_split(spark, sf)
    return scorecard.psi_report(exp, act, LINEITEM_NUM, bins=10)


# ---------------------------------------------------------------------------
# WOE / IV (A21, A22, A26) - target l_returnflag = 'R'
# ---------------------------------------------------------------------------

WOE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _woe_sql(features_num, features_str=(), n_bins=10, null_every=None) -> str:
    """SQL for the multi-feature WOE table over lineitem (target l_returnflag='R')."""
    sel = [f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y"]
    for f in features_num:
        expr = f if null_every is None else f"CASE WHEN l_orderkey % {null_every} = 0 THEN NULL ELSE {f} END"
        sel.append(f"CAST({expr} AS DOUBLE) AS {f}")
        sel.append(f"CAST({expr} AS VARCHAR) AS {f}__s")
    for f in features_str:
        sel.append(f"CAST(NULL AS DOUBLE) AS {f}")
        sel.append(f"CAST({f} AS VARCHAR) AS {f}__s")
    allf = list(features_num) + list(features_str)
    union = " UNION ALL ".join(
        f"SELECT y, '{f}' AS feature, {f} AS value, {f}__s AS cat, {str(f in features_num).upper()} AS is_num FROM base"
        for f in allf)
    return f"""
WITH base AS (SELECT {', '.join(sel)} FROM lineitem),
long AS ({union}),
nu AS (SELECT feature, bool_or(is_num) AS is_num, count(DISTINCT value) AS nunique FROM long GROUP BY feature),
kind AS (SELECT feature, CASE WHEN NOT is_num OR nunique <= {n_bins} THEN 'cat' ELSE 'cont' END AS kind FROM nu),
cv AS (SELECT l.* FROM long l JOIN kind USING (feature) WHERE kind = 'cont' AND value IS NOT NULL),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_qs_sql(n_bins)}))) AS edges FROM cv GROUP BY feature),
dim AS (SELECT feature, CAST(i AS INTEGER) AS bin_id, edges[i] AS lower, edges[i + 1] AS upper
        FROM (SELECT feature, edges, unnest(range(1, len(edges))) AS i FROM q)),
cb AS (SELECT cv.feature, CASE WHEN cv.value = q.edges[1] THEN 1 ELSE len(list_filter(q.edges, lambda x: x < cv.value)) END AS bin_id, y
       FROM cv JOIN q USING (feature)),
cc AS (SELECT feature, CAST(bin_id AS INTEGER) AS bin_id, count(*) AS cnt, sum(y) AS ev FROM cb
       WHERE bin_id >= 1 GROUP BY ALL),
cont AS (SELECT d.feature, d.bin_id, d.lower, d.upper, CAST(NULL AS VARCHAR) AS category,
                CAST(coalesce(cc.cnt, 0) AS BIGINT) AS count, CAST(coalesce(cc.ev, 0) AS BIGINT) AS events
         FROM dim d LEFT JOIN cc USING (feature, bin_id)),
catv AS (SELECT l.feature, coalesce(l.cat, 'nan') AS category, count(*) AS cnt, sum(y) AS ev
         FROM long l JOIN kind USING (feature) WHERE kind = 'cat' GROUP BY ALL),
cat AS (SELECT feature, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) AS INTEGER) AS bin_id,
               CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, category,
               CAST(cnt AS BIGINT) AS count, CAST(ev AS BIGINT) AS events FROM catv),
tab AS (SELECT *, count - events AS non_events FROM (SELECT * FROM cont UNION ALL SELECT * FROM cat)),
w AS (SELECT *, count(*) OVER (PARTITION BY feature) AS k, sum(events) OVER (PARTITION BY feature) AS te,
             sum(non_events) OVER (PARTITION BY feature) AS tn FROM tab),
s AS (SELECT *, (events + CAST(0.5 AS DOUBLE)) / (te + CAST(0.5 AS DOUBLE) * k) AS de,
                (non_events + CAST(0.5 AS DOUBLE)) / (tn + CAST(0.5 AS DOUBLE) * k) AS dn FROM w),
woe AS (SELECT feature, bin_id, lower, upper, category, count, events, CAST(non_events AS BIGINT) AS non_events,
               CASE WHEN count > 0 THEN CAST(events AS DOUBLE) / count END AS event_rate,
               CASE WHEN te > 0 AND tn > 0 THEN ln(de / dn) END AS woe,
               CASE WHEN te > 0 AND tn > 0 THEN (de - dn) * ln(de / dn) END AS iv_component,
               CASE WHEN te > 0 AND tn > 0 THEN NULL ELSE 'target has a single class' END AS err
        FROM s)"""


def _woe_cols_sql():
    return ("feature, bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, category, count, events, "
            "non_events, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe, "
            "round(iv_component, 6) AS iv_component")


def _returnflag_r(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))


@register("a21_woe_table", _woe_sql(["l_extendedprice"]) + f"\nSELECT {_woe_cols_sql()} FROM woe")
def q_a21_woe_table(spark, sf):
    return round_doubles(scorecard.woe_table(_returnflag_r(spark, sf), "l_extendedprice", "is_r", n_bins=10))


@register("a21_woe_multi", _woe_sql(WOE_FEATURES, ["l_linestatus"]) + f"\nSELECT {_woe_cols_sql()} FROM woe")
def q_a21_woe_multi(spark, sf):
    tab, _ = scorecard.woe_tables(_returnflag_r(spark, sf), WOE_FEATURES + ["l_linestatus"], "is_r", n_bins=10)
    return round_doubles(tab.drop("_err"))


@register("a26_woe_null_bins", _woe_sql(["l_tax", "l_quantity"], null_every=7)
          + f"\nSELECT {_woe_cols_sql()} FROM woe")
def q_a26_woe_null_bins(spark, sf):
    li = _returnflag_r(spark, sf)
    nul = F.pmod(F.col("l_orderkey"), F.lit(7)) == 0
    li = (li.withColumn("l_tax", F.when(nul, None).otherwise(F.col("l_tax")))
          .withColumn("l_quantity", F.when(nul, None).otherwise(F.col("l_quantity"))))
    tab, _ = scorecard.woe_tables(li, ["l_tax", "l_quantity"], "is_r", n_bins=10)
    return round_doubles(tab.drop("_err"))


@register("a22_iv_table", _woe_sql(WOE_FEATURES, ["l_linestatus"]) + f"""
SELECT feature, CASE WHEN max(err) IS NULL THEN round(sum(iv_component), 4) ELSE 0.0 END AS iv,
       {ladder_sql('CASE WHEN max(err) IS NULL THEN round(sum(iv_component), 4) ELSE 0.0 END', IV_LADDER, IV_ELSE)} AS predictive_power,
       max(err) AS error
FROM woe GROUP BY feature""")
def q_a22_iv_table(spark, sf):
    return scorecard.iv_table(_returnflag_r(spark, sf), WOE_FEATURES + ["l_linestatus"], "is_r", n_bins=10)


# ---------------------------------------------------------------------------
# KS / lift / gain (R1-R3, W1, W2) - orders: y = status 'F', score = total price
# ---------------------------------------------------------------------------

def _decile_sql(n_bins=10) -> str:
    qs = ", ".join(f"{repr(float(q))}::DOUBLE" for q in np.linspace(0, 1, n_bins + 1))
    return f"""
WITH base AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS score, o_orderkey AS key
              FROM orders WHERE o_totalprice IS NOT NULL),
r AS (SELECT y, CAST(row_number() OVER (ORDER BY score DESC, key ASC, y ASC) - 1 AS DOUBLE) AS i, count(*) OVER () AS n FROM base),
nn AS (SELECT DISTINCT n FROM r),
qv AS (SELECT n, unnest([{qs}]) AS q FROM nn),
vi AS (SELECT n, ((q * 100.0) / 100) * (n - 1) AS v FROM qv),
ed AS (SELECT list_sort(list_distinct(list(CASE WHEN v >= n - 1 THEN CAST(n - 1 AS DOUBLE)
              WHEN v - floor(v) >= 0.5 THEN (floor(v) + 1) - 1.0 * (1 - (v - floor(v)))
              ELSE floor(v) + 1.0 * (v - floor(v)) END))) AS edges FROM vi),
dec AS (SELECT CAST(greatest(1, len(list_filter(ed.edges, lambda e: e < r.i))) AS INTEGER) AS decile, y FROM r, ed),
s AS (SELECT decile, count(*) AS count, CAST(sum(y) AS BIGINT) AS events FROM dec GROUP BY decile)"""


def _orders_summary(spark, sf):
    o = table(spark, sf, "orders")
    return risk.decile_summary(o, (F.col("o_orderstatus") == "F").cast("int"), "o_totalprice", "o_orderkey", 10)


@register("r1_ks_table", _decile_sql() + """,
k AS (SELECT *, count - events AS non_events,
             sum(events) OVER (ORDER BY decile) AS cum_events,
             sum(count - events) OVER (ORDER BY decile) AS cum_non_events,
             sum(events) OVER () AS te, sum(count - events) OVER () AS tn FROM s)
SELECT decile, count, events, CAST(non_events AS BIGINT) AS non_events,
       round(CAST(events AS DOUBLE) / count, 6) AS event_rate,
       CAST(cum_events AS BIGINT) AS cum_events, CAST(cum_non_events AS BIGINT) AS cum_non_events,
       round(CAST(cum_events AS DOUBLE) / te, 6) AS cum_event_pct,
       round(CAST(cum_non_events AS DOUBLE) / tn, 6) AS cum_non_event_pct,
       round(abs(CAST(cum_events AS DOUBLE) / te - CAST(cum_non_events AS DOUBLE) / tn), 6) AS ks
FROM k""")
def q_r1_ks_table(spark, sf):
    return round_doubles(risk.ks_table(_orders_summary(spark, sf)))


@register("r2_lift_table", _decile_sql() + """,
k AS (SELECT *, sum(events) OVER (ORDER BY decile) AS ce, sum(count) OVER (ORDER BY decile) AS cc,
             CAST(sum(events) OVER () AS DOUBLE) / sum(count) OVER () AS overall FROM s)
SELECT decile, round(CAST(events AS DOUBLE) / count, 6) AS response_rate,
       round((CAST(ce AS DOUBLE) / cc) / overall, 6) AS cumulative_lift,
       round(CAST(ce AS DOUBLE) / cc, 6) AS cum_response_rate
FROM k""")
def q_r2_lift_table(spark, sf):
    return round_doubles(risk.lift_table(_orders_summary(spark, sf)))


@register("r3_gain_table", _decile_sql() + """,
k AS (SELECT *, sum(events) OVER (ORDER BY decile) AS ce, sum(events) OVER () AS te, max(decile) OVER () AS mx FROM s)
SELECT 0.0::DOUBLE AS percentile, 0.0::DOUBLE AS cumulative_gain
UNION ALL
SELECT round(decile * (100.0::DOUBLE / mx), 6) AS percentile, round(CAST(ce AS DOUBLE) / te, 6) AS cumulative_gain FROM k""")
def q_r3_gain_table(spark, sf):
    return round_doubles(risk.gain_table(_orders_summary(spark, sf)))


@register("a20_woe_tree_bins")
def q_a20_woe_tree_bins(spark, sf):
    """Supervised (best-first Gini tree) bins; no SQL equivalent - checked against a
    single-machine implementation in tests."""
    tab, _ = scorecard.woe_tables(_returnflag_r(spark, sf), ["l_extendedprice", "l_quantity"], "is_r", n_bins=10,
                                  method="tree")
    return round_doubles(tab.drop("_err"))
