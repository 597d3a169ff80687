"""Statistical tests (T1-T12): aggregate on Spark -> statistic -> p-value.

Each test reduces the data to sufficient statistics with one distributed aggregate
(counts, means, central moments, cell counts, covariance matrices); only those scalars
reach the driver, where the p-value is evaluated (``functions.special``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.exprs import (CORR_ELSE, CORR_LADDER, CRAMER_ELSE, CRAMER_LADDER, ETA_ELSE, ETA_LADDER,
                               ladder, numeric_cols, require_columns)
from .order import label_pairs, ordered_prefix


TEST_SCHEMA = ("test string, statistic double, df1 double, df2 double, p_value double, effect_size double, "
               "effect_label string")


def _label(v, steps, otherwise):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    for thr, lab in steps:
        if v < thr:
            return lab
    return otherwise


def _num(c: str):
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def _f(v):
    return None if v is None else float(v)


def _row(spark, test, stat, df1, df2, p, eff=None, lab=None):
    return spark.createDataFrame([(test, _f(stat), _f(df1), _f(df2), _f(p), _f(eff), lab)], TEST_SCHEMA)


def ttest_ind(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """Pooled-variance two-sample t test of two columns (nulls dropped per column)."""
    require_columns(df, [c1, c2])
    r = df.agg(F.count(_num(c1)), F.avg(_num(c1)), F.var_samp(_num(c1)),
               F.count(_num(c2)), F.avg(_num(c2)), F.var_samp(_num(c2))).first()
    n1, m1, v1, n2, m2, v2 = r
    if n1 < 2 or n2 < 2:
        raise ValueError("a t test needs at least two values in each column")
    dof = n1 + n2 - 2
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
    se = math.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    t = (m1 - m2) / se if se > 0 else float("nan")
    return _row(df.sparkSession, "ttest_ind", t, float(dof), None, special.t_sf2(t, dof))


def ttest_1samp(df: DataFrame, c: str, mu: float = 0.0) -> DataFrame:
    """One-sample t test against ``mu`` (default 0)."""
    require_columns(df, [c])
    n, m, sd = df.agg(F.count(_num(c)), F.avg(_num(c)), F.stddev_samp(_num(c))).first()
    if n < 2:
        raise ValueError("a t test needs at least two values")
    t = (m - mu) / (sd / math.sqrt(n)) if sd and sd > 0 else float("nan")
    return _row(df.sparkSession, "ttest_1samp", t, float(n - 1), None, special.t_sf2(t, n - 1))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """T4 + T5: chi-square test of independence with Yates' correction when df = 1;
    effect size Cramér's V. Cells never observed contribute their expected count, so
    only observed cells are touched (no row x column product)."""
    require_columns(df, [a, b])
    cells = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b)
             .agg(F.count(F.lit(1)).alias("o"))).persist(StorageLevel.MEMORY_AND_DISK)
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    n, r, c = cells.agg(F.sum("o"), F.count_distinct(a), F.count_distinct(b)).first()
    spark = df.sparkSession
    if not n:
        raise ValueError("no complete pairs")
    dof = (r - 1) * (c - 1)
    e = F.col("ra") * F.col("cb") / F.lit(float(n))
    j = cells.join(ra, a).join(cb, b)
    if dof == 0:
        chi2 = 0.0
    elif dof == 1:
        # 2x2 table: all four cells from the two marginals (bounded by construction)
        obs = {(x[a], x[b]): x["o"] for x in cells.collect()}
        rows = {x[a]: x["ra"] for x in ra.collect()}
        cols = {x[b]: x["cb"] for x in cb.collect()}
        chi2 = 0.0
        for ka, va in rows.items():
            for kb, vb in cols.items():
                ex = va * vb / n
                o = obs.get((ka, kb), 0)
                d = abs(o - ex)
                d = max(d - min(0.5, d), 0.0)
                chi2 += d * d / ex
    else:
        s_obs, s_e = j.agg(F.sum((F.col("o") - e) ** 2 / e), F.sum(e)).first()
        chi2 = s_obs + (n - s_e)
    min_dim = min(r, c) - 1
    v = math.sqrt(chi2 / (n * min_dim)) if min_dim > 0 else None
    p = special.chi2_sf(chi2, dof) if dof > 0 else 1.0
    return _row(spark, "chi_square", float(chi2), float(dof), None, p, v, _label(v, CRAMER_LADDER, CRAMER_ELSE))


def _group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    v = _num(value)
    return (df.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(group)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2")))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """T6 + T8: one-way ANOVA over groups with >= 2 values; effect size eta^2 with the
    grand mean over all non-null values (as the reference)."""
    require_columns(df, [group, value])
    g = _group_moments(df, group, value).where(F.col("n") >= 2).persist(StorageLevel.MEMORY_AND_DISK)
    k, N, sw = g.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("mean"))).first()
    if not k or k < 2:
        raise ValueError("at least two groups with two values each are needed")
    gm = sw / N
    gm_all = df.agg(F.avg(_num(value))).first()[0]
    ssb, ssw, ssb_all, sst_all = g.agg(
        F.sum(F.col("n") * (F.col("mean") - gm) ** 2), F.sum("m2"),
        F.sum(F.col("n") * (F.col("mean") - gm_all) ** 2),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - gm_all) ** 2)).first()
    d1, d2 = k - 1, N - k
    f = (ssb / d1) / (ssw / d2) if ssw > 0 else float("inf")
    eta = ssb_all / sst_all if sst_all > 0 else None
    return _row(df.sparkSession, "anova", float(f), float(d1), float(d2), special.f_sf(f, d1, d2), eta,
                _label(eta, ETA_LADDER, ETA_ELSE))


def tukey_hsd(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Tukey HSD over all clean rows: group1 < group2, meandiff = mean2 - mean1,
    std_err, q statistic, p-value (studentized range), reject. The k(k-1)/2 comparisons are
    made from the group table by joins, for any number of groups."""
    g = _group_moments(df, group, value).persist(StorageLevel.MEMORY_AND_DISK)
    k, N, ssw = g.agg(F.count(F.lit(1)), F.sum("n"), F.sum("m2")).first()
    mse = ssw / (N - k)
    pairs = label_pairs(g.select(F.col(group).alias("g"), "n", "mean"), "g", above=True).select(
        F.col("a.g").cast("string").alias("group1"), F.col("b.g").cast("string").alias("group2"),
        (F.col("b.mean") - F.col("a.mean")).alias("meandiff"),
        F.sqrt(F.lit(mse / 2.0) * (1.0 / F.col("a.n") + 1.0 / F.col("b.n"))).alias("std_err"))
    pairs = pairs.withColumn("q", F.abs(F.col("meandiff")) / F.col("std_err"))
    dfree = float(N - k)

    @F.pandas_udf("double")
    def p_tukey(q):
        return q.apply(lambda x: special.ptukey_sf(float(x), int(k), dfree) if x == x else float("nan"))

    return pairs.withColumn("p_value", p_tukey("q")).withColumn("reject", F.col("p_value") < alpha)


def _pairs(cols):
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def _corr_expr(x, y):
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.when(both, x), F.when(both, y)
    return (F.count_if(both).alias("n"),
            F.try_divide(F.covar_pop(mx, my), F.stddev_pop(mx) * F.stddev_pop(my)).alias("r"))


def _corr_p(r, n):
    if r is None or n is None or n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return special.t_sf2(t, n - 2)


def correlation(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Tall correlation matrix (col_a < col_b by position): n (pairwise
    complete rows), r, p_value (t with n-2 df; 1.0 below 3 rows)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    require_columns(df, cols)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    spark = df.sparkSession
    pairs = _pairs(cols)
    if method == "pearson":
        aggs = []
        for i, (a, b) in enumerate(pairs):
            n, r = _corr_expr(_num(a), _num(b))
            aggs += [n.alias(f"n{i}"), r.alias(f"r{i}")]
        row = df.agg(*aggs)
        tall = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                                      F.col(f"n{i}").cast("long").alias("n"),
                                                      F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))
    elif method == "spearman":
        tall = _spearman(df, pairs)
    elif method == "kendall":
        from .kendall import kendall_tau_b
        tall = kendall_tau_b(df, pairs)
    else:
        raise ValueError(f"unknown method: {method}")

    @F.pandas_udf("double")
    def pval(r, n):
        return pd.Series([_corr_p(None if rv != rv else float(rv), int(nv)) for rv, nv in zip(r, n)], dtype=float)

    if method == "kendall":
        return tall
    return (tall.withColumn("p_value", pval("r", "n"))
            .withColumn("strength", ladder(F.abs(F.col("r")), CORR_LADDER, CORR_ELSE)))


def pair_long(df: DataFrame, pairs) -> DataFrame:
    """(pair index, x, y) for pairwise-complete rows of every column pair (Generate, no
    shuffle); an integer pair key keeps the later hash aggregations cheap."""
    items = [F.struct(F.lit(i).alias("pair"), _num(a).alias("x"), _num(b).alias("y")) for i, (a, b) in enumerate(pairs)]
    return df.select(F.inline(F.array(*items))).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def average_ranks(long: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, avg_rank) - 1-based average rank of ties within ``key``, from
    cumulative counts over distinct values (no global window)."""
    dist = long.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    pref, _ = ordered_prefix(dist, [value], [key], weight_col="n", collect_totals=False)
    return pref.select(key, value, (F.col("_start") + (F.col("_w") + 1) / 2.0).alias("avg_rank"))


def _spearman(df: DataFrame, pairs) -> DataFrame:
    """Spearman per pair over pairwise-complete rows. Rows collapse to weighted distinct
    (pair, x, y) cells before any join; average ranks come from running counts over the
    distinct x (and y) values; the correlation is taken about the exact mean rank
    (N + 1) / 2 in one weighted aggregate."""
    cells = (pair_long(df, pairs).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
             .persist(StorageLevel.MEMORY_AND_DISK))

    # x and y distinct values of every pair ranked in one ordered_prefix pass
    dx_ = cells.groupBy("pair", F.col("x").alias("v")).agg(F.sum("w").alias("n")).withColumn("side", F.lit("x"))
    dy_ = cells.groupBy("pair", F.col("y").alias("v")).agg(F.sum("w").alias("n")).withColumn("side", F.lit("y"))
    pref, tot = ordered_prefix(dx_.unionByName(dy_), ["v"], ["pair", "side"], weight_col="n")
    pref = pref.select("pair", "side", "v", (F.col("_start") + (F.col("_w") + 1) / 2.0).alias("rank"))
    rx = pref.where(F.col("side") == "x").select("pair", F.col("v").alias("x"), F.col("rank").alias("rx"))
    ry = pref.where(F.col("side") == "y").select("pair", F.col("v").alias("y"), F.col("rank").alias("ry"))
    totals = {(k[0],): n for k, n in tot.items() if k[1] == "x"}
    mean = F.element_at(F.create_map(*[x for k, n in totals.items() for x in (F.lit(k[0]), F.lit((n + 1) / 2.0))]),
                        F.col("pair"))
    j = cells.join(rx, ["pair", "x"]).join(ry, ["pair", "y"]).withColumn("_m", mean)
    dx, dy, w = F.col("rx") - F.col("_m"), F.col("ry") - F.col("_m"), F.col("w")
    out = j.groupBy("pair").agg(F.sum("w").alias("n"),
                                F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))).alias("r"))
    names_a = F.array(*[F.lit(a) for a, _ in pairs])
    names_b = F.array(*[F.lit(b) for _, b in pairs])
    return out.select(F.element_at(names_a, F.col("pair") + 1).alias("col_a"),
                      F.element_at(names_b, F.col("pair") + 1).alias("col_b"), F.col("n").cast("long").alias("n"), "r")


def ols(df: DataFrame, target: str, features: Sequence[str]):
    """OLS with intercept, listwise null drop. Returns (coef_df, stats_df).

    X'X comes from one aggregate of means and pairwise covariances (numerically stable
    merges), so the solve is (k+1)x(k+1) on the driver regardless of row count; a
    second pass aggregates residual moments for skew / kurtosis / Jarque-Bera.
    """
    require_columns(df, [target, *features])
    spark = df.sparkSession
    cols = [*features, target]
    d = df.select(*[_num(c).alias(c) for c in cols]).dropna()
    k = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}"))
    r = d.agg(*aggs).first()
    n = r["n"]
    if n < 2 or n <= k + 1:
        raise ValueError("not enough complete rows for regression")
    means = np.array([r[f"m{i}"] for i in range(len(cols))])
    cov = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    sxx = cov[:k, :k] * (n - 1)
    sxy = cov[:k, k] * (n - 1)
    syy = cov[k, k] * (n - 1)
    inv = np.linalg.pinv(sxx)
    beta = inv @ sxy
    b0 = means[k] - beta @ means[:k]
    resid = F.col(target) - F.lit(float(b0))
    for i, c in enumerate(features):
        resid = resid - F.lit(float(beta[i])) * F.col(c)
    e = d.select(resid.alias("e"))
    s1, s2, s3, s4 = e.agg(F.sum("e"), F.sum(F.col("e") ** 2), F.sum(F.col("e") ** 3), F.sum(F.col("e") ** 4)).first()
    sse = s2
    dfree = n - k - 1
    sigma2 = sse / dfree
    se_b = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0))
    se_0 = math.sqrt(max(sigma2 * (1.0 / n + means[:k] @ inv @ means[:k]), 0))
    tcrit = special.t_ppf(0.975, dfree)
    rows = []
    for name, coef, se in [("const", b0, se_0)] + [(f, beta[i], se_b[i]) for i, f in enumerate(features)]:
        t = coef / se if se > 0 else float("nan")
        rows.append((name, float(coef), float(se), float(t), float(special.t_sf2(t, dfree)),
                     float(coef - tcrit * se), float(coef + tcrit * se)))
    coef_df = spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p_value double, "
                                          "ci_low double, ci_high double")
    r2 = 1 - sse / syy if syy > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dfree
    fstat = (r2 / k) / ((1 - r2) / dfree) if k > 0 and r2 < 1 else float("nan")
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    mu = s1 / n
    m2 = s2 / n - mu * mu
    m3 = s3 / n - 3 * mu * s2 / n + 2 * mu ** 3
    m4 = s4 / n - 4 * mu * s3 / n + 6 * mu * mu * s2 / n - 3 * mu ** 4
    skew = m3 / m2 ** 1.5 if m2 > 0 else float("nan")
    kurt = m4 / m2 ** 2 if m2 > 0 else float("nan")
    jb = n / 6.0 * (skew ** 2 + (kurt - 3) ** 2 / 4.0)
    xtx = np.zeros((k + 1, k + 1))
    xtx[0, 0] = n
    xtx[0, 1:] = xtx[1:, 0] = n * means[:k]
    xtx[1:, 1:] = sxx + n * np.outer(means[:k], means[:k])
    ev = np.linalg.eigvalsh(xtx)
    cond = math.sqrt(ev.max() / ev.min()) if ev.min() > 0 else float("inf")
    stats = [("n", float(n)), ("r2", r2), ("adj_r2", adj), ("f_stat", fstat),
             ("f_p_value", special.f_sf(fstat, k, dfree)), ("aic", -2 * llf + 2 * (k + 1)),
             ("bic", -2 * llf + math.log(n) * (k + 1)), ("log_likelihood", llf), ("skew", skew),
             ("kurtosis", kurt), ("jarque_bera", jb), ("jb_p_value", special.chi2_sf(jb, 2)),
             ("cond_no", cond)]
    stats_df = spark.createDataFrame([(a, float(b)) for a, b in stats], "metric string, value double")
    return coef_df, stats_df
