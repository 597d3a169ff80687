import numpy as np

from tessera.operators.neighbors import Cells, knn_classify, knn_join
from tessera.operators.sampling import adasyn, smote, smote_tomek


def _brute(q, p, pids, k, qids=None):
    out = {}
    for i, qv in enumerate(q):
        d = np.sqrt(((p - qv) ** 2).sum(axis=1))
        order = sorted(range(len(p)), key=lambda j: (d[j], pids[j]))
        if qids is not None:
            order = [j for j in order if pids[j] != qids[i]]
        out[i] = [pids[j] for j in order[:k]]
    return out


def test_knn_join_exact_with_duplicates(spark):
    rng = np.random.default_rng(21)
    p = rng.normal(size=(400, 3)).round(1)
    p[:120] = p[0]  # a hot duplicate vector: 30 % of the points
    q = np.vstack([rng.normal(size=(30, 3)), p[:5]])
    pts = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "pid long, v array<double>")
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, v array<double>")
    got = knn_join(qs, pts, 5, target_cell=16).toPandas()
    want = _brute(q, p, list(range(len(p))), 5)
    for i in range(len(q)):
        assert got[got.qid == i].sort_values("rank")["pid"].tolist() == want[i], i


def test_knn_self_join_excludes_self(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "id long, v array<double>")
    got = knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "pid"), 3, exclude_self=True,
                   target_cell=8).toPandas()
    want = _brute(p, p, list(range(200)), 3, qids=list(range(200)))
    for i in range(200):
        assert got[got.qid == i].sort_values("rank")["pid"].tolist() == want[i]


def test_knn_classify(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(0, 0.3, size=(100, 2))
    b = rng.normal(3, 0.3, size=(100, 2))
    train = spark.createDataFrame([(i, [float(x) for x in v], 0 if i < 100 else 1)
                                   for i, v in enumerate(np.vstack([a, b]))], "id long, v array<double>, label int")
    test = spark.createDataFrame([(1000, [0.1, 0.0]), (1001, [2.9, 3.1])], "id long, v array<double>")
    pred = {r["id"]: r["prediction"] for r in knn_classify(train, test, 5).collect()}
    assert pred == {1000: 0, 1001: 1}


def _imbalanced(spark):
    rng = np.random.default_rng(3)
    maj = rng.normal(0, 1, size=(120, 2))
    mino = rng.normal(2.5, 0.5, size=(30, 2))
    rows = [(f"k{i}", float(v[0]), float(v[1]), "maj") for i, v in enumerate(maj)]
    rows += [(f"m{i}", float(v[0]), float(v[1]), "min") for i, v in enumerate(mino)]
    return spark.createDataFrame(rows, "key string, x1 double, x2 double, y string"), mino


def test_smote_balances_and_interpolates(spark):
    df, mino = _imbalanced(spark)
    out = smote(df, "y", "key", ["x1", "x2"]).toPandas()
    counts = out["y"].value_counts()
    assert counts["maj"] == counts["min"] == 120
    syn = out[out.key.str.startswith("syn-")][["x1", "x2"]].to_numpy()
    lo, hi = mino.min(axis=0), mino.max(axis=0)
    assert ((syn >= lo - 1e-9) & (syn <= hi + 1e-9)).all()  # inside the minority hull's box


def test_adasyn_and_tomek(spark):
    df, _ = _imbalanced(spark)
    out = adasyn(df, "y", "key", ["x1", "x2"]).toPandas()
    assert abs(out["y"].value_counts()["min"] - 120) <= 30
    st = smote_tomek(df, "y", "key", ["x1", "x2"])
    assert st.count() <= 240



def test_cells_stay_even_on_a_line_of_points():
    """Features that rise together: a grid of quantiles would put all rows into its diagonal cells."""
    x = np.arange(20000.0)
    p = np.stack([x, 6 * x + np.sin(x)], 1)
    cells = Cells(p[::20], 64)
    n = np.bincount(cells.of(p), minlength=cells.n)
    assert cells.n == 64 and n.max() < 2 * n.mean()
    row, leaf = cells.within(p[:1000], np.full(1000, 30.0))
    assert len(row) < 2 * 1000 and (np.bincount(row, minlength=1000) >= 1).all()


def test_knn_join_of_many_dimensions_over_many_cells(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 12)).round(2)
    p[250:] = p[:50]
    rows = [(f"p{i:03d}", [float(x) for x in v]) for i, v in enumerate(p)] + [("none", None), ("part", [None] * 12)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "pid"), 4, exclude_self=True, target_cell=20).toPandas()
    ids = [f"p{i:03d}" for i in range(300)]
    want = _brute(p, p, ids, 4, qids=ids)
    assert set(got.qid) == set(ids)
    for i in range(300):
        assert got[got.qid == ids[i]].sort_values("rank")["pid"].tolist() == want[i]
