"""Supervised tree bins (A20): best-first CART (Gini, max_leaf_nodes = n_bins) on one
feature, as scikit-learn's DecisionTreeClassifier grows it, without pulling the feature
to the driver.

Features are compared as float32 (the estimator's input dtype). Per feature the
distinct values are aggregated to (v, n, events) and given exclusive running sums
(``ordered_prefix``), then cached. A node is an index range [lo, hi) of distinct values;
its best split is one aggregation over the cached rows in that range (every candidate
position scored from the running sums, ties to the smallest position). Best-first order
uses the weighted impurity decrease; thresholds are float32 midpoints in float64.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ordered_prefix

EPS = float(np.finfo(np.float64).eps)


def _gini(n, e):
    if n <= 0:
        return 0.0
    p = e / n
    return 1.0 - p * p - (1.0 - p) * (1.0 - p)


def _gini_col(n, e):
    p = e / n
    return F.lit(1.0) - p * p - (F.lit(1.0) - p) * (F.lit(1.0) - p)


class _Node:
    __slots__ = ("lo", "hi", "n", "e", "bn", "be")

    def __init__(self, lo, hi, n, e, bn, be):
        self.lo, self.hi, self.n, self.e, self.bn, self.be = lo, hi, n, e, bn, be


def _best_split(tab: DataFrame, node: _Node):
    """(position, nl, el, proxy, previous value, value) of the best split of ``node`` or None."""
    if node.hi - node.lo < 2:
        return None
    nl = F.col("_cum_n") - F.lit(node.bn)
    el = F.col("_cum_e") - F.lit(node.be)
    nr = F.lit(node.n) - nl
    er = F.lit(node.e) - el
    proxy = -(nr * _gini_col(nr, er) + nl * _gini_col(nl, el))
    cand = tab.where((F.col("_start") > node.lo) & (F.col("_start") < node.hi))
    r = cand.agg(F.max_by(F.struct(F.col("_start").alias("i"), nl.alias("nl"), el.alias("el"), proxy.alias("p"),
                                   F.col("v").alias("v"), F.col("_prev_v").alias("pv")),
                          F.struct(proxy, -F.col("_start")))).first()[0]
    return None if r is None else (int(r["i"]), float(r["nl"]), float(r["el"]), float(r["p"]), float(r["pv"]),
                                   float(r["v"]))


def tree_thresholds(tab: DataFrame, n_total: float, e_total: float, m: int, max_leaf_nodes: int) -> list[float]:
    """Best-first growth over the cached (v, n, e, _start, _cum_n, _cum_e) table."""
    frontier, counter, thresholds = [], 0, []

    def push(node):
        nonlocal counter
        imp = _gini(node.n, node.e)
        split = None
        if node.n >= 2 and imp > EPS:
            split = _best_split(tab, node)
        if split is None:
            return
        i, nl, el, _p, pv, v = split
        nr, er = node.n - nl, node.e - el
        improvement = (node.n / n_total) * (imp - nr / node.n * _gini(nr, er) - nl / node.n * _gini(nl, el))
        heapq.heappush(frontier, (-improvement, counter, node, i, nl, el, pv, v))
        counter += 1

    push(_Node(0, m, n_total, e_total, 0.0, 0.0))
    splits_left = max_leaf_nodes - 1
    while frontier and splits_left > 0:
        _neg, _c, node, i, nl, el, pv, v = heapq.heappop(frontier)
        lo_v, hi_v = np.float32(pv), np.float32(v)
        thr = float(lo_v) / 2.0 + float(hi_v) / 2.0
        if thr == float(hi_v) or np.isinf(thr):
            thr = float(lo_v)
        thresholds.append(thr)
        splits_left -= 1
        push(_Node(node.lo, i, nl, el, node.bn, node.be))
        push(_Node(i, node.hi, node.n - nl, node.e - el, node.bn + nl, node.be + el))
    return sorted(set(thresholds))


def tree_edges(cdist: DataFrame, n_bins: int) -> dict[str, list[float]]:
    """{feature: [-inf, thresholds..., inf]} from a WOE distinct table
    (feature, value, n_valid, events)."""
    out = {}
    feats = [r[0] for r in cdist.select("feature").distinct().collect()]
    for f in feats:
        d = (cdist.where((F.col("feature") == f) & (F.col("n_valid") > 0))
             .groupBy(F.col("value").cast("float").cast("double").alias("v"))
             .agg(F.sum("n_valid").cast("long").alias("n"), F.sum("events").cast("long").alias("e")))
        pref, totals = ordered_prefix(d, ["v"], sum_cols=["n", "e"])
        # each distinct value with its predecessor (equi-join on position - 1), so a split's
        # threshold comes back with the split itself
        prev = pref.select((F.col("_start") + 1).alias("_start"), F.col("v").alias("_prev_v"))
        tab = pref.join(prev, "_start", "left").persist(StorageLevel.MEMORY_AND_DISK)
        m = int(totals[()]) if totals else 0
        if m == 0:
            continue
        n_total, e_total = tab.agg(F.sum("n"), F.sum("e")).first()
        thr = tree_thresholds(tab, float(n_total), float(e_total), m, n_bins)
        out[f] = [float("-inf"), *thr, float("inf")]
        tab.unpersist()
    return out
