"""The corpus pipeline's stages, each against a plain computation, and awkward rows in every stage."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import mixing

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, key int, kept string"


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    make = {"en": ["the", "of", "and", "thing", "whole", "with", "other", "there"], "es": ["el", "los", "ción", "para", "año", "que", "señor", "más"]}
    out = []
    for i in range(70):
        lang = ["en", "es"][i % 2]
        out.append((i, " ".join(f"{w}{rng.integers(9) if k % 5 == 4 else ''}" for k, w in enumerate(rng.choice(make[lang], 45))), lang))
    words = out[3][1].split()
    out += [(100, out[3][1], "es"), (101, " ".join([*words[:44], "changed"]), "es"), (102, out[5][1] + " " + out[7][1][:60], "es"), (103, out[3][1], "es")]
    item = " ".join(f"question{k}" for k in range(12))
    out += [(200, "the thing of the other whole with it " * 3 + item, "en"), (201, None, None), (202, "", None), (203, "12 + 34 = 46", None), (204, " \n ", "en")]
    out += [(300, " ".join(out[8][1].split() * 1500), "en")]  # a long text
    return [(i, t, x, ["a", "b", None][i % 3], len(t or ""), "x", 1, "y") for i, t, x in out], item


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows[0], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_keeps_what_has_one(spark, docs, rows, sf_dir):
    out = P.language(spark, docs, sf_dir)
    assert out.columns == list(P.COLUMNS)
    gone = set(ids(docs)) - set(ids(out))
    assert {201, 202, 203, 204} <= gone <= {200, 201, 202, 203, 204}  # the rest is clean prose


def test_near_duplicates_keep_one_of_each_group(spark, docs, rows, sf_dir):
    sets = {r[0]: shingles(r[1]) for r in rows[0]}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    out = P.near_duplicates(spark, docs, sf_dir)
    assert out.columns == list(P.COLUMNS) and ids(out) == sorted(i for i in comp if comp[i] == i)
    assert {100, 101, 103}.isdisjoint(ids(out)) and 102 in ids(out)


def test_benchmark_drops_documents_that_hold_an_item(spark, docs, sf_dir):
    out = P.benchmark(spark, docs, sf_dir)
    assert out.columns == list(P.COLUMNS) and ids(out) == [i for i in ids(docs) if i != 200]


def test_mixture_repeats_whole_documents(spark, docs, rows, sf_dir):
    size = {r[0]: len((r[1] or "").split()) for r in rows[0]}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(docs)).collect()}
    out = P.mixture(spark, docs, sf_dir)
    n = Counter(ids(out))
    assert out.columns == list(P.COLUMNS) and set(n) <= set(size) and max(n.values()) <= 2
    for source in ("a", "b", None):
        own = [r[0] for r in rows[0] if r[3] == source and r[0] != 300]
        assert abs(sum(n[i] * size[i] for i in own) - sum(taken[i] for i in own)) <= 2 * max(size[i] for i in own)


def test_tokens_and_the_whole_run(spark, docs, sf_dir, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    crc = {r[0]: zlib.crc32(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows[0]}
    assert {r["doc_id"]: r["ids_crc32"] for r in P.tokens(spark, docs, sf_dir).collect()} == crc
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "benchmark", "mixture", "tokens"] and P.ORACLE_SQL is None
    out = P.run(spark, sf_dir).orderBy("start").collect()
    assert out and all(r["ids_crc32"] == crc[r["doc_id"]] for r in out)
    assert {r["doc_id"] for r in out}.isdisjoint({100, 101, 103, 201, 202, 203, 204, 200})
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]


def test_empty_tables_pass_every_stage(spark, docs, sf_dir):
    none = docs.where("doc_id < 0")
    for name, stage in P.STAGES:
        if name != "language":  # which has nothing to learn from
            assert stage(spark, none, sf_dir).count() == 0, name
