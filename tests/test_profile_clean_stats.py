import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import clean, profile, stats


def test_describe_numeric_equals_pandas(spark, stats10):
    got = profile.describe_numeric(stats10, ["A", "B", "C"]).toPandas().set_index("column")
    ref = stats10.toPandas()[["A", "B", "C"]].describe().T
    for c in ["A", "B", "C"]:
        assert got.loc[c, "count"] == ref.loc[c, "count"]
        for a, b in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                     ("p75", "75%"), ("max", "max")]:
            assert abs(got.loc[c, a] - ref.loc[c, b]) < 1e-12


def test_describe_categorical_ties_to_lowest(spark, stats10):
    got = profile.describe_categorical(stats10, ["Group", "Gender"]).toPandas().set_index("column")
    assert got.loc["Group", "top"] == "Z" and got.loc["Group", "freq"] == 4
    assert got.loc["Gender", "top"] == "F" and got.loc["Gender", "unique"] == 2


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=997)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = profile.histogram(df, "x").toPandas().sort_values("bin_id")
    counts, edges = np.histogram(x, bins=min(30, max(5, len(x) // 10)))
    assert list(got["count"]) == list(counts)
    assert np.allclose(got["lower"], edges[:-1], atol=0)


def test_missing_and_overview(spark, nulls5):
    m = profile.missing_report(nulls5).toPandas().set_index("column")
    assert m.loc["A", "missing"] == 1 and m.loc["C", "missing"] == 1 and m.loc["A", "missing_rate"] == 20.0
    ov = profile.column_overview(nulls5).toPandas().set_index("column")
    assert ov.loc["C", "kind"] == "categorical" and ov.loc["B", "n_unique"] == 4


def test_outlier_report(spark):
    vals = [1.0] * 20 + [2.0] * 20 + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.outlier_report(df, ["x"]).first()
    assert r["iqr_count"] == 1 and r["sigma_count"] == 1


def test_fill_strategies(spark, nulls5):
    mean = clean.fill_missing(nulls5, "mean").toPandas()
    assert mean["A"].tolist() == [3.0, 9.0, 6.0, 5.0, 7.0]
    assert mean["B"].tolist()[0] == 14.0
    assert clean.fill_missing(nulls5, "drop").count() == 3
    per = clean.fill_missing_per_column(nulls5, {"A": {"strategy": "mean"}, "B": {"strategy": "median"},
                                                 "C": {"strategy": "fill_value", "fill_value": "Unknown"}}).toPandas()
    assert per["B"].tolist()[0] == 14.0 and per["C"].tolist()[2] == "Unknown"
    with pytest.raises(ValueError):
        clean.fill_missing(nulls5, "fill_value")


def test_convert_type(spark, nulls5):
    out = clean.convert_type(nulls5, "A", "float").toPandas()
    assert out["A"].isna().sum() == 1
    with pytest.raises(TypeError):
        clean.convert_type(nulls5, "C", "int")
    df = spark.createDataFrame([(2.7,), (-2.7,)], "x double")
    assert [r[0] for r in clean.convert_type(df, "x", "int").collect()] == [2, -2]


def test_replace_value(spark, stats10):
    out, n = clean.replace_value(stats10, "A", "1", "100")
    assert n == 1 and out.agg(F.max("A")).first()[0] == 100.0
    same, n0 = clean.replace_value(stats10, "A", "999", "1")
    assert n0 == 0


def test_special_functions_against_commons_math(spark):
    jvm = spark.sparkContext._jvm
    dist = jvm.org.apache.commons.math3.distribution
    for t, df in [(2.306, 8), (1.0, 3), (4.5, 30)]:
        want = 2 * (1 - dist.TDistribution(float(df)).cumulativeProbability(t))
        assert abs(special.t_sf2(t, df) - want) < 1e-9
    for x, df in [(3.841, 1), (10.0, 4), (0.5, 2)]:
        want = 1 - dist.ChiSquaredDistribution(float(df)).cumulativeProbability(x)
        assert abs(special.chi2_sf(x, df) - want) < 1e-9
    for f, d1, d2 in [(4.74, 2, 7), (1.2, 3, 40)]:
        want = 1 - dist.FDistribution(float(d1), float(d2)).cumulativeProbability(f)
        assert abs(special.f_sf(f, d1, d2) - want) < 1e-9
    assert abs(special.t_sf2(2.306, 8) - 0.05) < 1e-3


def test_studentized_range_known_values():
    # published 5 % critical values q(0.05; k, df): k=3, df=10 -> 3.877; k=4, df=20 -> 3.958
    assert abs(special.ptukey_sf(3.877, 3, 10) - 0.05) < 2e-3
    assert abs(special.ptukey_sf(3.958, 4, 20) - 0.05) < 2e-3


def test_ttest_and_anova_on_demo_frame(spark, stats10):
    pdf = stats10.toPandas()
    t = stats.ttest_ind(stats10, "B", "C").first()
    b, c = pdf.B, pdf.C
    sp2 = ((len(b) - 1) * b.var() + (len(c) - 1) * c.var()) / (len(b) + len(c) - 2)
    assert abs(t["statistic"] - (b.mean() - c.mean()) / math.sqrt(sp2 * (2 / 10))) < 1e-12
    a = stats.anova(stats10, "Group", "B").first()
    assert a["df1"] == 2 and a["df2"] == 7 and 0 < a["p_value"] < 0.05
    assert a["effect_label"] == "large"


def test_chi_square_yates_and_cramer(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 10
    df = spark.createDataFrame(rows, "p string, q string")
    r = stats.chi_square(df, "p", "q").first()
    obs = np.array([[12, 5], [3, 10]])
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    d = np.abs(obs - e)
    want = (np.maximum(d - np.minimum(0.5, d), 0) ** 2 / e).sum()
    assert abs(r["statistic"] - want) < 1e-12 and r["df1"] == 1


def test_correlations(spark):
    rows = list(zip(range(1, 11), [2, 4, 5, 8, 10, 12, 14, 16, 18, 20], range(10, 0, -1)))
    df = spark.createDataFrame(rows, "A int, B int, C int")
    p = stats.correlation(df, ["A", "B", "C"], "pearson").toPandas().set_index(["col_a", "col_b"])
    assert abs(p.loc[("A", "C"), "r"] + 1) < 1e-12
    s = stats.correlation(df, ["A", "B", "C"], "spearman").toPandas().set_index(["col_a", "col_b"])
    assert abs(s.loc[("A", "B"), "r"] - 1) < 1e-12


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(size=500), rng.normal(size=500)
    y = 3 + 2 * x1 - x2 + rng.normal(scale=0.01, size=500)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x1": x1, "x2": x2}))
    coef, model = stats.ols(df, "y", ["x1", "x2"])
    c = coef.toPandas().set_index("term")["coef"]
    assert abs(c["const"] - 3) < 0.01 and abs(c["x1"] - 2) < 0.01 and abs(c["x2"] + 1) < 0.01
    m = model.toPandas().set_index("metric")["value"]
    assert m["r2"] > 0.999
