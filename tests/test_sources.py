import io
import os
import tempfile
import zipfile

from tessera.functions.text import clean_feature_name
from tessera.sources import readers, sinks


def _xlsx_bytes(rows):
    """A minimal workbook: shared strings for text, numbers inline."""
    strings, cells = [], []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                if v not in strings:
                    strings.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>'
    sst = f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", sst)
    return buf.getvalue()


def test_read_excel_first_sheet(spark):
    d = tempfile.mkdtemp(prefix="tessera-xlsx-")
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_xlsx_bytes([["年齡", "城市"], [25, "台北"], [30, "高雄"]]))
    df = readers.read_excel(spark, d)
    rows = sorted((r["年齡"], r["城市"]) for r in df.collect())
    assert rows == [("25", "台北"), ("30", "高雄")]


def test_encoding_detection_and_csv(spark):
    d = tempfile.mkdtemp(prefix="tessera-enc-")
    text = "姓名,收入\n王小明,35000\n李大華,42000\n"
    with open(os.path.join(d, "big5.csv"), "wb") as f:
        f.write(text.encode("cp950"))
    assert readers.detect_encoding_bytes(text.encode("cp950")) == "cp950"
    assert readers.detect_encoding_bytes(b"\xef\xbb\xbf" + text.encode("utf-8")) == "utf-8-sig"
    df = readers.read_csv(spark, os.path.join(d, "big5.csv"))
    assert df.columns == ["姓名", "收入"] and sorted(r["收入"] for r in df.collect()) == [35000, 42000]


def test_txt_and_unsupported(spark):
    d = tempfile.mkdtemp(prefix="tessera-txt-")
    p = os.path.join(d, "t.txt")
    with open(p, "w") as f:
        f.write("a   b\tc\n1 2.5 x\n 3  4.0   y\n")
    df = readers.read_table(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"} and df.count() == 2
    try:
        readers.read_table(spark, os.path.join(d, "t.parquet"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_csv_bom_roundtrip_and_dictionary(spark):
    d = tempfile.mkdtemp(prefix="tessera-bom-")
    df = spark.createDataFrame([(1, "甲"), (2, "乙")], "id int, name string")
    sinks.write_csv(df, os.path.join(d, "out"), bom=True, single_file=True)
    part = [f for f in os.listdir(os.path.join(d, "out")) if f.endswith(".csv")][0]
    raw = open(os.path.join(d, "out", part), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    back = readers.read_csv(spark, os.path.join(d, "out"))
    assert back.columns == ["id", "name"]
    dic = spark.createDataFrame([("id", "key"), ("ghost", "x"), ("name", " ")], "column string, description string")
    kept = sinks.keep_known_columns(dic, df).collect()
    assert [r["column"] for r in kept] == ["id"]


def test_clean_feature_name(spark):
    df = spark.createDataFrame([("num__age",), ("cat__city_台北",), ("plain",)], "n string")
    assert [r[0] for r in df.select(clean_feature_name("n")).collect()] == ["age", "city_台北", "plain"]


def test_vector_collection_lifecycle(spark):
    from pyspark.sql import functions as F
    from tessera.sources import vectors
    root = tempfile.mkdtemp(prefix="tessera-vec-")
    assert vectors.get_or_create(spark, root, "kb").count() == 0
    docs = spark.createDataFrame([("a", "x" * 150, [1.0, 0.0]), (None, "short", [0.0, 1.0])],
                                 "id string, document string, embedding array<float>")
    vectors.add_documents(spark, root, "kb", docs)
    coll = vectors.get_or_create(spark, root, "kb")
    assert coll.count() == 2 and coll.where(F.col("id").isNull()).count() == 0  # UUID assigned
    stats = vectors.collection_stats(coll, 5).collect()
    assert stats[0]["n_total"] == 2 and any(r["preview"].endswith("...") for r in stats)
    vectors.delete_documents(spark, root, "kb", spark.createDataFrame([("a",)], "id string"))
    assert vectors.get_or_create(spark, root, "kb").count() == 1


def test_passthrough_features(spark):
    from tessera.operators.prep import passthrough_features
    df = spark.sql("SELECT true AS b, TIMESTAMP_NTZ '1970-01-02 00:00:00' AS t, DATE '1970-01-03' AS d")
    r = passthrough_features(df, ["b", "t", "d"]).first()
    assert (r["b"], r["t"], r["d"]) == (1.0, 86400.0, 172800.0)
