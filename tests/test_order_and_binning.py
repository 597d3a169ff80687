import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.binning import equal_width_edges, exact_quantiles, feature_edges
from tessera.operators.order import dedupe_edges, ordered_prefix, pandas_qcut_index_edges


@pytest.mark.parametrize("b", [3, 5, 10, 20])
def test_index_edges_equal_numpy(b):
    for n in list(range(1, 120)) + [181, 997, 1170]:
        want = np.percentile(np.arange(n), np.linspace(0, 1, b + 1) * 100.0)
        got = pandas_qcut_index_edges(n, b)
        assert got == [float(x) for x in want], (n, b)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 91, 181, 250])
def test_decile_assignment_equals_pandas_qcut(n):
    b = 10
    want = pd.qcut(pd.RangeIndex(n), b, labels=False, duplicates="drop") + 1
    edges = dedupe_edges(pandas_qcut_index_edges(n, b))
    got = [max(1, sum(1 for e in edges if e < i)) for i in range(n)]
    if n > 1:
        assert list(want) == got


def test_ordered_prefix_matches_pandas_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 5000
    grp = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))  # one group holds most rows
    val = rng.integers(0, 50, n).astype(float)
    w = rng.integers(1, 5, n)
    pdf = pd.DataFrame({"g": grp, "v": val, "k": np.arange(n), "w": w})
    df = spark.createDataFrame(pdf)
    out, totals = ordered_prefix(df, ["v", "k"], ["g"], weight_col="w", num_partitions=7, sum_cols=["k"])
    got = out.select("k", "_start", "_cum_k").toPandas().sort_values("k").reset_index(drop=True)
    ref = pdf.sort_values(["g", "v", "k"])
    ref["_start"] = ref.groupby("g")["w"].cumsum() - ref["w"]
    ref["_cum_k"] = ref.groupby("g")["k"].cumsum() - ref["k"]
    ref = ref.sort_values("k").reset_index(drop=True)
    assert (got["_start"].to_numpy() == ref["_start"].to_numpy()).all()
    assert (got["_cum_k"].to_numpy() == ref["_cum_k"].to_numpy()).all()
    assert totals[("hot",)] == int(pdf.loc[pdf.g == "hot", "w"].sum())


def test_exact_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.zeros(2000)])  # a hot value: 40 % zeros
    pdf = pd.DataFrame({"feature": "x", "value": vals})
    dist = spark.createDataFrame(pdf).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got, n = exact_quantiles(dist, ["feature"], qs)[("x",)]
    assert n == len(vals)
    assert got == [float(v) for v in pd.Series(vals).quantile(qs)]


def test_equal_width_edges_equal_pandas_cut():
    x = pd.Series([1.5, 2.0, 7.25, 3.0, 10.0])
    _, bins = pd.cut(x, bins=4, retbins=True)
    assert equal_width_edges(1.5, 10.0, 4) == list(bins)
    _, bins = pd.cut(pd.Series([5.0, 5.0]), bins=3, retbins=True)
    assert equal_width_edges(5.0, 5.0, 3) == list(bins)


def test_unweighted_positions_jvm_path(spark):
    rng = np.random.default_rng(17)
    n = 3000
    grp = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    pdf = pd.DataFrame({"g": grp, "v": rng.integers(0, 20, n).astype(float), "k": np.arange(n)})
    out, totals = ordered_prefix(spark.createDataFrame(pdf), ["v", "k"], ["g"], num_partitions=6)
    got = out.select("k", "_start").toPandas().sort_values("k")["_start"].to_numpy()
    ref = pdf.sort_values(["g", "v", "k"]).assign(p=lambda d: d.groupby("g").cumcount()).sort_values("k")["p"].to_numpy()
    assert (got == ref).all() and totals[("hot",)] == int((grp == "hot").sum())


def test_weighted_prefix_across_many_arrow_batches(spark):
    """Running sums must carry across Arrow batches inside a partition (groups that span
    batch boundaries, a hot group spanning many)."""
    rng = np.random.default_rng(23)
    n = 4000
    grp = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"g": grp, "v": rng.normal(size=n), "k": np.arange(n), "w": rng.integers(1, 9, n)})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out, _ = ordered_prefix(spark.createDataFrame(pdf), ["v", "k"], ["g"], weight_col="w", num_partitions=3,
                                sum_cols=["k"])
        got = out.select("k", "_start", "_cum_k").toPandas().sort_values("k").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    ref = pdf.sort_values(["g", "v", "k"])
    ref["_start"] = ref.groupby("g")["w"].cumsum() - ref["w"]
    ref["_cum_k"] = ref.groupby("g")["k"].cumsum() - ref["k"]
    ref = ref.sort_values("k").reset_index(drop=True)
    assert (got["_start"].to_numpy() == ref["_start"].to_numpy()).all()
    assert (got["_cum_k"].to_numpy() == ref["_cum_k"].to_numpy()).all()


def test_approx_edges_close_to_exact(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=5000)}))
    exact = feature_edges(df, ["x"], 10)["x"]
    approx = feature_edges(df, ["x"], 10, approx_accuracy=10_000)["x"]
    assert len(exact) == len(approx) and max(abs(a - b) for a, b in zip(exact[1:-1], approx[1:-1])) < 0.01


def test_offsets_as_a_table_equal_broadcast_ones(spark, monkeypatch):
    from tessera.operators import order, prep
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("g"),
                                 (F.col("id") * 37 % 101).alias("v"), F.lit(2).alias("w"))

    def results():
        out = []
        for weight in (None, "w"):
            pref, totals = order.ordered_prefix(df, ["v", "k"], ["g"], weight_col=weight, num_partitions=5, with_total=True)
            out.append((sorted(map(tuple, pref.select("k", "_start", "_total").collect())), totals))
        out.append(sorted(map(tuple, prep.stratified_split(df, "g", "k").select("k", "split").collect())))
        out.append(sorted(r["k"] for r in prep.undersample(df, "g", "k").collect()))
        return out

    few = results()
    monkeypatch.setattr(order, "BROADCAST_ROWS", 3)
    assert results() == few
    assert len(few[0][0]) == 500 and few[0][1][(None,)] == 72 and len(few[3]) == 7 * min(few[0][1].values())
