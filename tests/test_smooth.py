"""Density curves, LOWESS, the OLS summary, silhouettes, report averages and exact p-values against plain computations."""

from itertools import permutations

import numpy as np
import pytest

from tessera.functions import special
from tessera.operators import evaluate, kendall, smooth


def test_density_curve(spark):
    rng = np.random.default_rng(1)
    x = np.append(rng.normal(0, 1, 300), rng.normal(5, 0.5, 200))
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 1.0), (None, 2.0), ("a", None)], "g string, v double")
    got = smooth.density_curve(df, "v", "g").orderBy("point").collect()
    assert {r["group"] for r in got} == {"a"} and len(got) == 100
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 100)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in got], grid) and np.allclose([r["density"] for r in got], want, atol=1e-4)
    assert np.trapezoid(want, grid) == pytest.approx(1, abs=0.01)


def plain_lowess(x, y, at, frac, rounds):
    k, robust = int(frac * len(x) + 1e-10), np.ones(len(x))
    for turn in range(rounds + 1):
        fit = []
        for a in at:
            d = np.abs(x - a)
            w = np.clip(1 - (d / np.sort(d)[k - 1]) ** 3, 0, None) ** 3 * robust
            b = np.polyfit(x - a, y, 1, w=np.sqrt(w))
            fit.append(b[1])
        r = y - np.interp(x, at, fit)
        s = 6 * np.sort(np.abs(r))[(len(r) - 1) // 2]
        robust = np.where(np.abs(r) < s, (1 - (r / s) ** 2) ** 2, 0)
    return np.array(fit)


@pytest.mark.parametrize("bins", [4096, 64])
def test_lowess(spark, bins):
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 10, 400))
    y = np.sin(x) + rng.normal(0, 0.1, 400)
    y[::37] += 20  # outliers, which robust rounds leave out
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)], "x double, y double").repartition(3)
    got = smooth.lowess(df, "x", "y", frac=0.3, bins=bins).toPandas()
    want = plain_lowess(x, y, got["x"].to_numpy(), 0.3, 3)
    assert np.abs(got["fitted"] - want).max() < (1e-6 if bins > 400 else 0.05)
    assert np.abs(got["fitted"] - np.sin(got["x"])).max() < 0.35
    assert smooth.lowess(df.where("x < 0"), "x", "y").count() == 0
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in smooth.lowess(same, "x", "y").collect()] == [(1.0, 3.0)]


def test_ols_summary(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 80))
    y = 1 + 2 * a - b + np.cumsum(rng.normal(0, 0.3, 80))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))], "k long, a double, b double, y double").repartition(4)
    got = {(r["section"], r["term"]): r["value"] for r in smooth.ols_summary(df, "y", ["a", "b"], "k").collect()}
    X = np.column_stack([np.ones(80), a, b])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    assert got["fit", "durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum())
    assert got["coef", "a:coef"] == pytest.approx(beta[1]) and got["fit", "cond_no"] == pytest.approx(np.linalg.cond(X))
    llf = -40 * (np.log(2 * np.pi) + np.log((e ** 2).mean()) + 1)
    assert got["fit", "aic"] == pytest.approx(6 - 2 * llf) and got["fit", "bic"] == pytest.approx(3 * np.log(80) - 2 * llf)


def plain_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, k in enumerate(c):
        own = (c == k) & (np.arange(len(c)) != i)
        a = d[i, own].mean() if own.any() else None
        b = min(d[i, c == o].mean() for o in set(c) if o != k)
        out.append(0 if a is None else (b - a) / max(a, b))
    return np.array(out)


def test_silhouette(spark):
    rng = np.random.default_rng(4)
    c = np.append(np.arange(240) % 3, [7, -1, -1])
    x = np.array([[0, 0], [3, 0], [0, 3], [9, 9], [1, 1], [2, 2], [4, 4], [5, 5]])[c] + rng.normal(0, 1, (243, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, c, strict=True))], "i long, a double, b double, c int").repartition(3)
    want = plain_silhouette(x, c)
    for block in (1000, 50):
        r = smooth.silhouette(df, ["a", "b"], "c", "i", block=block).first()
        assert r["silhouette"] == pytest.approx(want.mean()) and (r["std_error"], r["n_scored"], r["n_clusters"], r["n_noise"]) == (0.0, 243, 4, 2)
    r = smooth.silhouette(df, ["a", "b"], "c", "i", max_queries=120).first()
    assert r["n_scored"] == 120 and abs(r["silhouette"] - want.mean()) < 4 * r["std_error"] and r["std_error"] > 0
    assert smooth.silhouette(df.where("c = 1"), ["a", "b"], "c", "i").first()["silhouette"] is None


def test_report_averages(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    got = {r["class"]: tuple(r)[1:] for r in evaluate.report_with_averages(df, "y", "p").collect()}
    assert got["accuracy"] == pytest.approx((0.6, 0.6, 0.6, 5))
    assert got["macro avg"] == pytest.approx((7 / 18, 0.5, (0.5 + 0.8) / 3, 5))
    assert got["weighted avg"] == pytest.approx((7 / 15, 0.6, (0.5 * 2 + 0.8 * 2) / 5, 5))


def test_exact_kendall_p(spark):
    for n in (2, 4, 6):
        inv = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
        pairs = n * (n - 1) // 2
        for d in range(pairs + 1):
            far = np.mean([abs(2 * v - pairs) >= abs(2 * d - pairs) for v in inv])
            assert special.kendall_exact_p(n, d) == pytest.approx(far)
    x, y = [3, 1, 4, 0, 5, 9, 2, 6], [2, 7, 1, 8, 0.5, 3, 4, 6]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    d = sum((x[i] - x[j]) * (y[i] - y[j]) < 0 for i in range(8) for j in range(i))
    assert kendall.kendall_tau_b(df, [("x", "y")]).first()["p_value"] == pytest.approx(special.kendall_exact_p(8, d))
