"""Edge fixtures from the quirk ledger: constant / all-null / two-valued columns, bad
targets, singleton groups, unseen categories, odd casts."""

import math

import numpy as np
import pandas as pd
import pytest


from tessera.operators import clean, prep, profile, scorecard, stats
from tessera.operators.binning import equal_width_edges, feature_edges


def test_constant_column_correlation_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    r = stats.correlation(df, ["c", "x"]).first()
    assert r["r"] is None and r["p_value"] == 1.0


def test_constant_column_equal_width_edges():
    assert equal_width_edges(0.0, 0.0, 2) == list(pd.cut(pd.Series([0.0, 0.0]), 2, retbins=True)[1])


def test_all_null_column_profiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    m = profile.missing_report(df).toPandas().set_index("column")
    assert m.loc["a", "missing"] == 2
    ns = profile.numeric_summary(df, ["a", "b"]).toPandas().set_index("column")
    assert ns.loc["a", "count"] == 0 and ns.loc["b", "median"] == 1.5


def test_two_valued_column_qcut_edges_collapse(spark):
    vals = [0.0] * 70 + [1.0] * 30
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    _, bins = pd.qcut(pd.Series(vals), 10, retbins=True, duplicates="drop")
    assert feature_edges(df, ["x"], 10)["x"] == list(bins)


def test_woe_rejects_non_binary_target(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(30)], "x double, y int")
    with pytest.raises(ValueError):
        scorecard.woe_table(df, "x", "y")


def test_anova_ignores_singleton_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 6.0), ("c", 100.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = stats.anova(df, "g", "v").first()
    assert r["df1"] == 1 and r["df2"] == 3  # group c (one value) excluded from F
    # eta^2 uses the grand mean of all non-null values, including group c
    gm = np.mean([1, 2, 3, 5, 6, 100])
    ssb = 3 * (2 - gm) ** 2 + 2 * (5.5 - gm) ** 2
    sst = sum((v - gm) ** 2 for v in [1, 2, 3, 5, 6])
    assert math.isclose(r["effect_size"], ssb / sst, rel_tol=1e-12)


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    out = {r["c"]: r["c_onehot"] for r in prep.one_hot(test, "c", fit_on=train).collect()}
    assert out["a"] == [1.0, 0.0] and out["z"] == [0.0, 0.0]


def test_casts_of_odd_strings(spark):
    df = spark.createDataFrame([("False",), ("true",), (None,)], "s string")
    got = [r[0] for r in clean.convert_type(df, "s", "bool").collect()]
    assert got == [False, True, None]  # parsed, null stays null (not pandas' non-empty => True)
    bad = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(TypeError):
        clean.convert_type(bad, "s", "float")


def test_single_class_psi_and_empty_actual(spark):
    e = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    empty = spark.createDataFrame([], "v double")
    r = scorecard.psi_report(e, empty, ["v"]).first()
    # both smoothed distributions are 1/k per bin here (uniform baseline, empty actual)
    assert r["error"] is None and r["psi"] == 0.0

