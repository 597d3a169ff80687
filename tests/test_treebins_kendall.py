import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.treebins import tree_edges


def _gini(n, e):
    p = e / n
    return 1 - p * p - (1 - p) * (1 - p)


def _reference_best_first(x, y, max_leaf):
    """Single-machine best-first CART on one float32 feature (independent loop)."""
    x = x.astype(np.float32)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    vals = np.unique(xs)
    n_by = np.array([np.sum(xs == v) for v in vals], dtype=float)
    e_by = np.array([ys[xs == v].sum() for v in vals], dtype=float)
    N = n_by.sum()

    def best(lo, hi):
        n, e = n_by[lo:hi].sum(), e_by[lo:hi].sum()
        if hi - lo < 2 or n < 2 or _gini(n, e) <= np.finfo(float).eps:
            return None
        bestv = None
        for i in range(lo + 1, hi):
            nl, el = n_by[lo:i].sum(), e_by[lo:i].sum()
            nr, er = n - nl, e - el
            p = -(nr * _gini(nr, er) + nl * _gini(nl, el))
            if bestv is None or p > bestv[0]:
                bestv = (p, i, nl, el)
        _, i, nl, el = bestv
        imp = (n / N) * (_gini(n, e) - (n - nl) / n * _gini(n - nl, e - el) - nl / n * _gini(nl, el))
        return imp, i

    heap, cnt, thr = [], itertools.count(), []
    b = best(0, len(vals))
    if b:
        heapq.heappush(heap, (-b[0], next(cnt), 0, len(vals), b[1]))
    left = max_leaf - 1
    while heap and left > 0:
        _, _, lo, hi, i = heapq.heappop(heap)
        t = float(vals[i - 1]) / 2.0 + float(vals[i]) / 2.0
        thr.append(float(vals[i - 1]) if t == float(vals[i]) else t)
        left -= 1
        for a, c in ((lo, i), (i, hi)):
            bb = best(a, c)
            if bb:
                heapq.heappush(heap, (-bb[0], next(cnt), a, c, bb[1]))
    return sorted(set(thr))


def test_tree_bins_equal_single_machine(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=600).round(2)
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x))).astype(int)
    pdf = pd.DataFrame({"feature": "x", "value": x, "n_valid": 1, "events": y})
    dist = spark.createDataFrame(pdf).groupBy("feature", "value").agg(F.sum("n_valid").alias("n_valid"),
                                                                     F.sum("events").alias("events"))
    got = tree_edges(dist, 6)["x"]
    assert got[1:-1] == _reference_best_first(x, y, 6)
    assert len(got) - 1 <= 6


def _brute_kendall(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i + 1, n))
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - tx) * (n0 - ty))


def test_kendall_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    a = rng.integers(0, 15, 300).astype(float)
    b = (a + rng.integers(0, 10, 300)).astype(float)
    c = rng.normal(size=300)
    b[::17] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c}))
    got = stats.correlation(df, ["a", "b", "c"], "kendall").toPandas().set_index(["col_a", "col_b"])
    cols = {"a": a, "b": b, "c": c}
    for x, y in [("a", "b"), ("a", "c"), ("b", "c")]:
        m = ~(np.isnan(cols[x]) | np.isnan(cols[y]))
        want = _brute_kendall(cols[x][m], cols[y][m])
        assert abs(got.loc[(x, y), "r"] - want) < 1e-12
        assert 0 <= got.loc[(x, y), "p_value"] <= 1
