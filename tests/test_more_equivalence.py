"""More operator outputs checked against direct pandas / numpy computations."""

import numpy as np
import pandas as pd

from tessera.operators import chartdata, profile, scorecard


def _frame(spark, seed=31, n=700):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2.0, 3.0, n).round(1)
    x[rng.random(n) < 0.1] = np.nan
    g = rng.choice(["p", "q", "r"], n)
    s = rng.choice(["u", "v", "w", None], n, p=[0.5, 0.3, 0.15, 0.05])
    pdf = pd.DataFrame({"x": x, "g": g, "s": s})
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, g string, s string"), pdf


def test_numeric_summary_equals_pandas(spark):
    df, pdf = _frame(spark)
    got = profile.numeric_summary(df, ["x"]).first()
    x = pdf["x"]
    assert got["count"] == x.count() and got["missing"] == x.isna().sum()
    assert got["n_unique"] == x.nunique()
    for k, v in [("mean", x.mean()), ("median", x.median()), ("std", x.std()), ("q1", x.quantile(0.25)),
                 ("q3", x.quantile(0.75)), ("min", x.min()), ("max", x.max())]:
        assert abs(got[k] - v) < 1e-9, k
    assert abs(got["missing_rate"] - x.isna().mean() * 100) < 1e-9


def test_categorical_summary_equals_pandas(spark):
    df, pdf = _frame(spark)
    got = profile.categorical_summary(df, ["s"]).first()
    s = pdf["s"]
    vc = s.value_counts()
    assert got["count"] == s.count() and got["missing"] == s.isna().sum() and got["n_unique"] == s.nunique()
    assert got["mode"] == sorted(vc[vc == vc.max()].index)[0] and got["mode_freq"] == vc.max()


def test_psi_table_per_bin(spark):
    # quarters of 1..100 end at 25.75, 50.5 and 75.25; the actual rows are the odd numbers and 200
    base = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    now = spark.createDataFrame([(float(i),) for i in [*range(1, 101, 2), 200]], "v double")
    got = scorecard.psi_table(base, now, "v", 4).orderBy("bin_id").collect()
    assert [r["expected_count"] for r in got] == [25] * 4 and [r["actual_count"] for r in got] == [13, 12, 13, 13]
    assert [r["lower"] for r in got[1:]] == [25.75, 50.5, 75.25]
    assert all(abs(r["expected_pct"] - 25.5 / 102) < 1e-15 for r in got)


def test_box_stats_equal_numpy(spark):
    df, pdf = _frame(spark)
    got = chartdata.box_stats(df, "x", "g").toPandas().set_index("group")
    for grp, sub in pdf.dropna(subset=["x"]).groupby("g"):
        v = sub["x"]
        q1, med, q3 = v.quantile([0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got.loc[grp]
        assert (r["q1"], r["median"], r["q3"]) == (q1, med, q3)
        assert r["whisker_low"] == inside.min() and r["whisker_high"] == inside.max()
        assert r["outliers"] == ((v < lo) | (v > hi)).sum() and r["n"] == len(v)


def test_grouped_histogram_has_every_cell(spark):
    df, pdf = _frame(spark)
    got = profile.histogram(df, "x", bins=12, group="g").toPandas()
    assert len(got) == 3 * 12
    x = pdf.dropna(subset=["x"])
    counts, _ = np.histogram(x["x"], bins=12)
    assert list(got.groupby("bin_id")["count"].sum().sort_index()) == list(counts)
