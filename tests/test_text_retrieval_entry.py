import numpy as np
import pandas as pd
from tessera.functions import text as tx
from tessera.operators import retrieval

from conftest import SF001


def _py_chunks(text, size=500, overlap=50):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        out.append(text[start:start + size])
        start = start + size - overlap
    return out


def test_chunks_equal_python_loop(spark):
    texts = ["x" * 500, "y" * 501, "".join(chr(0x4E00 + i % 50) for i in range(950)), "", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = retrieval.chunk_documents(df, "doc_id", "text").toPandas()
    for i, t in enumerate(texts):
        g = got[got.doc_id == i].sort_values("chunk_index")["chunk"].tolist()
        assert g == _py_chunks(t), i


def test_text_cleaning(spark):
    df = spark.createDataFrame([("<think>a\nb</think>  hello <think>x</think>\n",), ("```json\n{\"reply\": 1}\n```",)],
                               "t string")
    r = df.select(tx.strip_think("t").alias("a"), tx.strip_code_fence("t").alias("b")).collect()
    assert r[0]["a"] == "hello"
    assert r[1]["b"] == '{"reply": 1}'


def test_intent_tag_order(spark):
    df = spark.createDataFrame([("請幫我畫 chart",), ("PSI drift",), ("ML model",), ("hello",)], "t string")
    got = [r[0] for r in df.select(tx.intent_tag("t")).collect()]
    assert got == ["visualization", "psi_monitoring", "ml", None]


def test_topk_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    emb = rng.normal(size=(300, 8))
    q = rng.normal(size=(4, 8))
    coll = spark.createDataFrame(pd.DataFrame({"id": [f"v{i}" for i in range(300)], "embedding": list(emb)}))
    qdf = spark.createDataFrame(pd.DataFrame({"query_id": [f"q{i}" for i in range(4)], "vector": list(q)}))
    got = retrieval.topk_cosine(qdf, coll.repartition(5), k=3).toPandas()
    for i in range(4):
        d = 1 - emb @ q[i] / (np.linalg.norm(emb, axis=1) * np.linalg.norm(q[i]))
        want = [f"v{j}" for j in np.argsort(d)[:3]]
        assert got[got.query_id == f"q{i}"].sort_values("rank")["id"].tolist() == want


def test_last_turns(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "Step 1 完成" if t == 13 else f"m{t}") for t in range(15)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(r["turn"] for r in retrieval.last_turns(df, 10).collect())
    assert got == [5, 6, 7, 8, 9, 10, 11, 12, 14]


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and "psi" in df.columns
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    for name in ["a01_table_shape", "a22_iv_table", "r1_ks_table", "t04_chi_square", "x01_chunk_documents"]:
        assert qs[name](spark, SF001).count() > 0


def test_psi_flagship_small(spark):
    import __spark_entry__ as entry
    out = entry.queries()["a23_psi_table"](spark, SF001).toPandas()
    assert out["expected_count"].sum() > 0 and (out["psi_component"] >= 0).all()



def test_parse_reply(spark):
    rows = [("<think>x</think>```json\n{\"reply\": \"hi\", \"actions\": [1]}\n```", "anything"),
            ("{\"answer\": 1}", "draw a chart"),
            ("{broken", "psi drift please"),
            ("plain text", "no keywords")]
    df = spark.createDataFrame(rows, "raw string, q string")
    got = [tuple(r[0]) for r in df.select(tx.parse_reply("raw", "q")).collect()]
    assert got[0] == ("hi", None, "{}", "[1]")
    assert got[1] == ('{"answer": 1}', "visualization", "{}", "[]")
    assert got[2][1] == "psi_monitoring" and got[3] == ("plain text", None, "{}", "[]")
