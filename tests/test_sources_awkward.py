"""Sources on awkward files, vector collections by URI, and operators without caps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chartdata, evaluate, retrieval, stats
from tessera.sources import readers, vectors


def test_csv_types_after_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,x,flag,none\n1,1.5,True,\nNA,null,False,NA\n3, 2e3 ,TRUE,\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "double"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(
        [(1, 1.5, True, None), (None, None, False, None), (3, 2000.0, True, None)], key=str)


def test_csv_quotes_and_line_ends_inside_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,said\n1,"he said ""hi"", ok"\n2,"two\nlines"\n')
    rows = {r["id"]: r["said"] for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {1: 'he said "hi", ok', 2: "two\nlines"}


def test_csv_folder_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,台北\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,name\n2,高雄市中正區\n".encode("cp950"))
    rows = {r["id"]: r["name"] for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {1: "台北", 2: "高雄市中正區"}


def test_csv_bytes_beyond_the_sample_decide_too(spark, tmp_path):
    body = "id,name\n" + "1,plain\n" * 30_000
    (tmp_path / "a.csv").write_bytes(body.encode() + "2,高雄市中正區\n".encode("cp950"))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.count() == 30_001
    assert df.where("id = 2").first()["name"] == "高雄市中正區"


def test_csv_folder_judges_each_file_by_all_its_bytes(spark, tmp_path):
    """A file whose odd bytes come late does not drag files of the same detected encoding along."""
    late = "id,name\n" + "1,plain\n" * 30_000
    (tmp_path / "a.csv").write_bytes("id,name\n10,台北市\n".encode())
    (tmp_path / "b.csv").write_bytes(late.encode() + "11,高雄市中正區\n".encode("cp950"))
    (tmp_path / "c.csv").write_bytes("id,name\n12,caf\xe9 \xa0\xff\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes("id,name\n13,marked\n".encode("utf-8-sig"))
    (tmp_path / "e f.csv").write_bytes(("id,name\n" + "2,plain\n" * 30_000 + "14,東京\n").encode())
    got = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in readers.file_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "utf-8", "b.csv": "cp950", "c.csv": "latin-1", "d.csv": "utf-8", "e f.csv": "utf-8"}
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name"] and df.count() == 60_005
    assert {r["id"]: r["name"] for r in df.where("id >= 10").collect()} == {
        10: "台北市", 11: "高雄市中正區", 12: "caf\xe9 \xa0\xff", 13: "marked", 14: "東京"}


def test_csv_large_file_is_judged_in_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,name\n" + b"1,plain\n" * 200_000 + "2,高雄\n".encode("cp950") + b"1,plain\n" * 200_000)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        assert readers.file_encodings(spark, str(tmp_path)).first()["encoding"] == "cp950"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_csv_replacement_characters_of_the_source_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,odd � mark\n", encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).first()["name"] == "odd � mark"


def test_csv_of_more_than_200_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(f"c{i}" for i in range(201)) + "\n" + ",".join("1" for _ in range(201)) + "\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert len(df.columns) == 201 and df.count() == 1


def test_txt_keeps_rows_equal_to_the_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\na b\n1 x\na b\n2\n")
    (tmp_path / "b.txt").write_text("a b\n3 z\n")
    rows = sorted((tuple(r) for r in readers.read_txt(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([("1", "x"), ("a", "b"), ("2", None), ("3", "z")], key=str)


def test_txt_in_another_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("id city\n1 台北\n".encode("cp950"))
    assert tuple(readers.read_txt(spark, str(tmp_path / "a.txt"), encoding="cp950").first()) == (1, "台北")


def test_vector_collection_by_uri(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}", [1.0, 0.0]) for i in ids], vectors.COLLECTION_SCHEMA)
    kept = lambda: sorted(r["id"] for r in vectors.get_or_create(spark, root, "kb").collect())
    vectors.add_documents(spark, root, "kb", rows("a", "b"))
    vectors.add_documents(spark, root, "kb", rows("c"))
    assert kept() == ["a", "b", "c"]
    vectors.delete_documents(spark, root, "kb", spark.createDataFrame([("a",), ("c",), (None,)], "id string"))
    assert kept() == ["b"]
    vectors.add_documents(spark, root, "kb", rows("a"))
    assert kept() == ["a", "b"]
    (tmp_path / "kb" / "00000009-add-dead").mkdir()  # a writer that died
    assert kept() == ["a", "b"]
    vectors.clear(spark, root, "kb")
    assert kept() == []
    vectors.add_documents(spark, root, "kb", rows("z"))
    assert kept() == ["z"]


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_topk_in_blocks_with_null_and_zero_vectors(spark, cells, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(5)
    vecs, qs = rng.normal(size=(40, 3)), rng.normal(size=(7, 3))
    coll = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vecs)] + [("n", None), ("z", [0.0] * 3)],
                                 "id string, embedding array<double>")
    q = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(qs)] + [("n", None), ("z", [0.0] * 3)],
                              "query_id string, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.topk_cosine(q, coll, k=4).collect()}
    cos = (qs @ vecs.T) / np.linalg.norm(qs, axis=1)[:, None] / np.linalg.norm(vecs, axis=1)
    want = {(str(i), r + 1): str(j) for i in range(7) for r, j in enumerate(np.argsort(-cos[i])[:4])}
    assert got == want


def test_confusion_grid_with_a_null_label(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("a", "a")], "y string, p string")
    got = {(r["label"], r["prediction"]): r["count"] for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9 and sum(got.values()) == 4
    assert got["a", "a"] == 2 and got["a", "b"] == 1 and got[None, "a"] == 1


def test_tukey_of_many_groups_has_every_comparison(spark):
    df = spark.range(9000).select((F.col("id") % 300).alias("g"), (F.hash("id") % 100).alias("v"))
    out = stats.tukey_hsd(df, "g", "v").select("group1", "group2")
    assert out.count() == out.distinct().count() == 300 * 299 // 2


def test_pie_counts_every_category(spark):
    df = spark.range(100).select((F.col("id") % 25).cast("string").alias("c"))
    rows = chartdata.pie_data(df, "c").collect()
    assert len(rows) == 25 and all(r["percent"] == 4.0 for r in rows)
    assert [r["percent"] for r in chartdata.pie_data(df, "c", 3).collect()] == [4.0] * 3
