"""Smooth chart curves (C2 LOWESS, C9 density curves and violins), reduced to a grid on Spark.

* ``density_curve``: a Gaussian kernel estimate at evenly spaced points, per group. Values are
  counted in ``FINE`` equal bins first, so a group costs at most FINE kernels a point; the
  bandwidth is Scott's, sd * n ** (-1 / 5), and the grid reaches ``CUT`` bandwidths beyond
  the data.
* ``lowess``: locally weighted lines (Cleveland, 1979) at anchors, straight between them. The
  anchors are evenly spaced ranks of x; a window is the nearest ``frac`` of the rows, its half
  width a difference of order statistics that counts over fine bins of rank bound, one pass
  for all anchors; the weighted sums of all windows are one aggregate a round (tasks add up
  their rows, then Spark the tasks). Each robust round weighs rows by their distance from
  the last curve over six times the median distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINE = 2048
CUT = 3.0


def _number(c: str):
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def density_curve(df: DataFrame, value: str, group: str | None = None, points: int = 100) -> DataFrame:
    """(group, point, x, density) per group; a group of one value only has no curve. Rows without a value
    (or group, if one is named) are left out."""
    g = F.col(group).cast("string") if group else F.lit("all")
    src = df.select(g.alias("group"), _number(value).alias("v")).where(F.col("group").isNotNull() & F.col("v").isNotNull())
    st = src.groupBy("group").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    st = st.where("hi > lo").withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    width = (F.col("hi") - F.col("lo")) / FINE
    cells = src.join(st, "group").withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(FINE - 1)))
    cells = cells.groupBy("group", "b").agg(F.count("*").alias("c"))
    cells = cells.join(st, "group").select("group", "c", (F.col("lo") + (F.col("b") + 0.5) * width).alias("at"))
    grid = st.select("group", "n", "h", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    left = F.col("lo") - CUT * F.col("h")
    grid = grid.withColumn("x", left + F.col("point") * (F.col("hi") + CUT * F.col("h") - left) / (points - 1))
    u = (F.col("x") - F.col("at")) / F.col("h")
    out = grid.join(cells, "group").groupBy("group", "point").agg(
        F.first("x").alias("x"), (F.sum(F.col("c") * F.exp(-0.5 * u * u)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))
    return out.select("group", F.col("point").cast("int").alias("point"), "x", "density")


def _half_widths(at: np.ndarray, values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Distance from each point of ``at`` to its k-th nearest row, rows given as (values, counts)."""
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(values - a)
        order = np.argsort(d, kind="stable")
        out[i] = d[order][np.searchsorted(np.cumsum(counts[order]), k)]
    return out


def lowess(df: DataFrame, x: str, y: str, frac: float = 2 / 3, rounds: int = 3, anchors: int = 100, bins: int = 4096) -> DataFrame:
    """(x, fitted) at the anchors, in the order of x. Up to ``bins`` distinct x are used as they are; beyond that,
    window widths come from the means of that many equal ranges of rank."""
    rows = df.select(_number(x).alias("x"), _number(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("r", F.lit(0.0)).persist()  # r: distance from the last curve
    n = rows.count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "x double, fitted double")
    distinct = rows.groupBy("x").agg(F.count("*").alias("c"))
    few = distinct.limit(bins + 1).count() <= bins
    if not few:  # equal ranges of rank, from approximate quantiles
        cuts = sorted(set(rows.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 20 * bins)).first()[0]))
        place = F.lit(0)
        edges = F.array(*map(F.lit, cuts))
        place = F.size(F.filter(edges, lambda e: e < F.col("x")))
        distinct = rows.groupBy(place.alias("p")).agg(F.avg("x").alias("x"), F.count("*").alias("c"))
    table = distinct.select("x", "c").toPandas().sort_values("x")  # ``bins`` rows at most
    values, counts = table["x"].to_numpy(), table["c"].to_numpy()
    upto = np.cumsum(counts)
    at = np.unique(values[np.searchsorted(upto, np.linspace(1, n, min(anchors, len(values))))])
    k = max(1, min(n, int(frac * n + 1e-10)))
    half = _half_widths(at, values, counts, k)
    half = np.where(half > 0, half, 1e-12)
    fitted, scale = np.zeros(len(at)), 0.0
    for turn in range(rounds + 1):
        def sums(batches, scale=scale, turn=turn):
            total = np.zeros((5, len(at)))
            for batch in batches:
                xs, ys, rs = (c.to_numpy() for c in batch.columns)
                robust = np.ones(len(xs)) if not turn else np.where(np.abs(rs) < scale, (1 - (rs / max(scale, 1e-300)) ** 2) ** 2, 0.0)
                for i in range(0, len(xs), 4096):  # anchors x rows at a time
                    d = (xs[i:i + 4096] - at[:, None])
                    w = np.clip(1 - (np.abs(d) / half[:, None]) ** 3, 0, None) ** 3 * robust[i:i + 4096]
                    yy = ys[i:i + 4096]
                    total += [w.sum(1), (w * d).sum(1), (w * d * d).sum(1), w @ yy, (w * d) @ yy]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), *map(pa.array, total)], names=["a", "w", "wd", "wdd", "wy", "wdy"])

        part = rows.mapInArrow(sums, "a int, w double, wd double, wdd double, wy double, wdy double")
        s = part.groupBy("a").agg(*(F.sum(c).alias(c) for c in ("w", "wd", "wdd", "wy", "wdy"))).toPandas().sort_values("a")
        w, wd, wdd, wy, wdy = (s[c].to_numpy() for c in ("w", "wd", "wdd", "wy", "wdy"))
        det = w * wdd - wd * wd
        line = (wdd * wy - wd * wdy) / np.where(det > 1e-10 * np.maximum(w * wdd, 1e-300), det, np.nan)
        fitted = np.where(np.isfinite(line), line, np.where(w > 0, wy / np.where(w > 0, w, 1), fitted))
        if turn == rounds:
            break

        def rest(batches, fitted=fitted):
            for batch in batches:
                xs, ys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ys - np.interp(xs, at, fitted))], names=["x", "y", "r"])

        rows = rows.mapInArrow(rest, "x double, y double, r double")
        scale = 6 * (rows.agg(F.percentile_approx(F.abs("r"), 0.5, 10_000)).first()[0] or 0.0)
        if scale <= 1e-12:
            break
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(at, fitted)], "x double, fitted double")


def durbin_watson(df: DataFrame, target: str, features: list[str], order: str, intercept: float, coefs: list[float]) -> float | None:
    """Sum of squared differences of neighbouring residuals, in the order of a unique key, over their sum of
    squares: places come from ``ordered_prefix``, neighbours from a join on them."""
    from .order import ordered_prefix
    used = [order, target, *features]
    e = F.col(target).cast("double") - F.lit(float(intercept))
    for c, b in zip(features, coefs):
        e = e - F.lit(float(b)) * F.col(c).cast("double")
    rows = df.dropna(subset=used).select(F.col(order).alias("_k"), e.alias("e"))
    placed, _ = ordered_prefix(rows, ["_k"], collect_totals=False)
    placed = placed.select(F.col("_start").alias("p"), "e")
    before = placed.select((F.col("p") + 1).alias("p"), F.col("e").alias("e0"))
    r = placed.join(before, "p", "left").agg(F.sum((F.col("e") - F.col("e0")) ** 2), F.sum(F.col("e") ** 2)).first()
    return None if not r[1] else float((r[0] or 0.0) / r[1])


def ols_summary(df: DataFrame, target: str, features: list[str], order: str) -> DataFrame:
    """(section, term, value) of the whole summary: fit statistics with Durbin-Watson over rows in the
    order of a unique key, then coefficient, standard error, t, p-value and interval of every term."""
    from .stats import ols
    coef, fit = ols(df, target, features)
    by = {r["term"]: r["coef"] for r in coef.collect()}  # one row a term
    dw = durbin_watson(df, target, features, order, by["const"], [by[f] for f in features])
    fit = fit.union(df.sparkSession.createDataFrame([("durbin_watson", dw)], "metric string, value double"))
    names = ["coef", "std_err", "t", "p_value", "ci_low", "ci_high"]
    parts = F.explode(F.array(*(F.struct(F.concat_ws(":", "term", F.lit(c)).alias("term"), F.col(c).alias("value")) for c in names))).alias("x")
    return fit.select(F.lit("fit").alias("section"), F.col("metric").alias("term"), "value").union(
        coef.select(F.lit("coef").alias("section"), parts).select("section", "x.term", "x.value"))


def silhouette(df: DataFrame, features: list[str], label: str, key: str, max_queries: int = 20_000, block: int = 2_000, seed: int = 42) -> DataFrame:
    """One row (silhouette, std_error, n_scored, n_clusters, n_noise), by Euclidean distance; label -1 is noise, and a
    class of its own for the score, as the reference has it. Exact while there are at most ``max_queries`` rows. Beyond that
    the mean is estimated from that many, drawn by the hash of a unique key; each is still scored against all rows, and
    std_error tells how far the mean may be off. No score with one class, or as many as rows."""
    spark = df.sparkSession
    names = [f"x{j}" for j in range(len(features))]
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(label).cast("string").alias("c"),
                     *(F.col(c).cast("double").alias(n) for c, n in zip(features, names))).dropna().persist()
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row a class
    n, classes = sum(sizes.values()), sorted(sizes)
    out = [None, None, 0, len([c for c in classes if c != "-1"]), sizes.get("-1", 0)]
    if 1 < len(classes) < n:
        drawn = rows.withColumn("h", F.xxhash64("k", F.lit(seed))).orderBy("h", "k").limit(max_queries).toPandas()
        number, total = {c: i for i, c in enumerate(classes)}, []
        for at in range(0, len(drawn), block):
            q = drawn.iloc[at:at + block]
            x = q[names].to_numpy()

            def sums(batches, x=x):
                s = np.zeros((len(x), len(classes)))
                for batch in batches:
                    y = np.stack([batch.column(2 + j).to_numpy() for j in range(len(names))], 1)
                    c = np.array([number[v] for v in batch.column(1).to_pylist()], np.int64)
                    for i in range(0, len(y), 1024):
                        d = np.sqrt(np.maximum(((x[:, None, :] - y[None, i:i + 1024]) ** 2).sum(2), 0))
                        for k in np.unique(c[i:i + 1024]):
                            s[:, k] += d[:, c[i:i + 1024] == k].sum(1)
                q_at, c_at = np.nonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(q_at), pa.array(c_at), pa.array(s[q_at, c_at])], names=["q", "c", "s"])

            got = rows.mapInArrow(sums, "q long, c long, s double").groupBy("q", "c").agg(F.sum("s").alias("s")).toPandas()
            s = np.zeros((len(x), len(classes)))
            s[got["q"], got["c"]] = got["s"]
            own = np.array([number[c] for c in q["c"]])
            count, here = np.array([sizes[c] for c in classes], float), np.arange(len(x))
            a = s[here, own] / np.maximum(count[own] - 1, 1)
            mean = s / count
            mean[here, own] = np.inf
            b = mean.min(1)
            total.append(np.where(count[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0))
        v = np.concatenate(total)
        out[:3] = float(v.mean()), 0.0 if len(v) == n else float(v.std(ddof=1) / math.sqrt(len(v)) * math.sqrt(1 - len(v) / n)), len(v)
    rows.unpersist()
    return spark.createDataFrame([tuple(out)], "silhouette double, std_error double, n_scored long, n_clusters int, n_noise long")
