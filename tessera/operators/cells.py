"""Rows as cells: how many rows lie in each combination of bins.

What a tree is grown from are sums over (node, feature, bin), and a node is a set of bins. So rows that share all
their bins (and class) never part, and one pass that counts them holds all that any number of trees, rounds or
candidates can ask of the rows. There are at most as many cells as the product of the bins, however many rows;
beyond ``MOST`` of them (many features) the callers go on with the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: cells that the driver takes
MOST = 1 << 19
#: tables whose values MLlib takes as they are, or as many rows of larger ones (the larger of this and bins^2)
SAMPLE_ROWS = 10_000
#: quantiles of all rows that stand for the values of a column
SKETCH = 4096


def look(df: DataFrame, cols: Sequence[str], label: str) -> tuple[int, int, bool, list[bool]]:
    """(rows, classes, whether no number is missing, columns that hold nothing but 0 and 1, both of them). One pass."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("k"), *(x for j, c in enumerate(cols) for x in (
        F.max(F.isnan(c) | F.isnull(c)).alias(f"o{j}"), F.sum(F.col(c).isin(0.0, 1.0).cast("long")).alias(f"i{j}"),
        (F.min(c) < F.max(c)).alias(f"t{j}")))).first()
    some = range(len(cols))
    return r["n"], int(r["k"] or 0) + 1, not any(r[f"o{j}"] for j in some), [r[f"i{j}"] == r["n"] and bool(r[f"t{j}"]) for j in some]


def fraction(n: int, max_bins: int) -> float:
    """Share of n rows from which MLlib chooses cuts."""
    return min(1.0, max(min(max_bins, n) ** 2, SAMPLE_ROWS) / max(n, 1))


def sampled(df: DataFrame, share: float, seed: int) -> list[np.ndarray]:
    """Columns of the rows from which MLlib chooses the cuts of a fit on ``df``: the same draw by the same seed."""
    if share < 1:
        spark = df.sparkSession
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        df = DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD().sample(False, share, draw), df._jdf.schema()), spark)
    t = df.toArrow()
    return [t.column(j).to_numpy() for j in range(t.num_columns)]


def cuts(values: np.ndarray, weights: np.ndarray, n_splits: int, total: float, count: int) -> np.ndarray:
    """MLlib's thresholds for sorted distinct values: ``total`` is the weight expected of the ``count`` rows, and what
    the values other than 0 lack of it counts as 0."""
    on = values != 0
    v, w = values[on], weights[on]
    if not len(v):
        return v
    lacking = total - w.sum()
    if lacking > 2.0 ** -52 * count * 100:
        at = np.searchsorted(v, 0.0)
        v, w = np.insert(v, at, 0.0), np.insert(w, at, lacking)
    return ((v[:-1] + v[1:]) / 2)[thresholds(w, n_splits, total)]


def thresholds(weights: np.ndarray, n_splits: int, total: float | None = None) -> np.ndarray:
    """MLlib's choice of cuts: places i, each a cut after the i-th value, from the weights of the sorted values."""
    if len(weights) - 1 <= n_splits:
        return np.arange(len(weights) - 1)
    w = np.asarray(weights, float).tolist()
    stride = (sum(w) if total is None else total) / (n_splits + 1)
    out, upto, target = [], w[0], stride
    for i in range(1, len(w)):
        before, upto = upto, upto + w[i]
        if abs(before - target) < abs(upto - target):
            out.append(i - 1)
            target += stride
    return np.array(out, int)


def quantile_edges(df: DataFrame, cols: Sequence[str], n_bins: int) -> list[np.ndarray]:
    """Upper ends of each column's bins but the last, from quantiles of all rows; one pass."""
    qs = [(i + 0.5) / SKETCH for i in range(SKETCH)]
    r = df.agg(*(F.percentile_approx(c, qs, 4 * SKETCH).alias(f"q{j}") for j, c in enumerate(cols)), *(F.max(c).alias(f"m{j}") for j, c in enumerate(cols))).first()
    found = []
    for j in range(len(cols)):
        v = np.unique([x for x in r[f"q{j}"] if x < r[f"m{j}"]])
        found.append(v if len(v) < n_bins else np.unique(v[len(v) * np.arange(1, n_bins) // n_bins]))
    return found


def merged(parts: list) -> tuple:
    """Sums by code of [(codes, rows, values)]."""
    code, n, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    some, to = np.unique(code, return_inverse=True)
    return some, np.bincount(to, n, len(some)).astype(np.int64), np.bincount(to, s, len(some))


def counted(df: DataFrame, cols: Sequence[str], edges: Sequence[np.ndarray], groups: Sequence[tuple[str, int]] = (),
            value: str | None = None, most: int | None = None):
    """(bins, groups, rows, sums of ``value``) of the cells in order, or None where they are more than ``most``. Bin b
    of a column holds edges[b - 1] < x <= edges[b]; ``groups`` are columns of numbers below a size."""
    sizes = [*(len(e) + 1 for e in edges), *(size for _, size in groups)]
    most = MOST if most is None else most
    if sum(np.log2(sizes)) >= 62:
        return None
    n_cols = len(cols)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for j, size in enumerate(sizes):
                x = batch.column(j).to_numpy(zero_copy_only=False)
                code = code * size + (np.searchsorted(edges[j], x, side="left") if j < n_cols else x.astype(np.int64))
            v = batch.column(len(sizes)).to_numpy(zero_copy_only=False)
            parts.append(merged([(code, np.ones(len(code)), v)]))
            held += len(parts[-1][0])
            if held > 1 << 20:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["code", "n", "s"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["code", "n", "s"])

    v = F.col(value).cast("double") if value else F.lit(0.0)
    rows = df.select(*(F.col(c).cast("double") for c in cols), *(F.col(c).cast("long") for c, _ in groups), v.alias("_v"))
    found = rows.mapInArrow(run, "code long, n long, s double").groupBy("code").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).persist()
    try:
        if found.count() > most:
            return None
        t = found.toArrow()
    finally:
        found.unpersist()
    code, n, s = (t.column(i).to_numpy() for i in range(3))
    order = np.argsort(code)
    code, n, s = code[order], n[order], s[order]
    places = []
    for size in reversed(sizes):
        code, at = np.divmod(code, size)
        places.insert(0, at)
    return np.stack(places[:n_cols], 1) if n_cols else np.zeros((len(n), 0), int), places[n_cols:], n, s
