"""Operators of the corpus subpackage against brute force on small tables."""

import hashlib
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import (decontaminate, language_id, license_scan, mixing, near_dedup, quality_cnn, quality_rules, repeats,
                         simple8b, token_counts, token_ids)

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, size long"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdeilnorst"), 5)) for _ in range(400)]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(12)]
    near = base[0].split()
    near[30] = "changed"
    passage = " ".join(rng.choice(vocab, 90))
    out = [*base, base[0], base[0], " ".join(near), base[1] + " " + passage, passage + ". " + base[2], "", None, "  \n ", "one", "two words",
           "x" * 900, "é ñ ü" * 50, base[3] + "\n" + base[3], "Released under the MIT License.", "\n".join(["same line here"] * 6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 7 else None, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][i % 4], len(t or ""), "x", "y", 1)
            for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1]], SCHEMA).repartition(3)  # clashing extra columns, a repeated row, a null id


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(docs, out):
    """Result rows by id, for ids that occur once."""
    return {r["doc_id"]: r for r in out.collect() if r["doc_id"] not in (None, 1)}


def test_token_counts(docs, texts, empty):
    pieces = [b" ", *(bytes([b]) for b in range(256)), b" ab", b"abc", b"cde", b"bcd", b" changed", b"chan", b"ged"]
    have, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            word = word[next(k for k in range(longest, 0, -1) if word[:k] in have):]
            n += 1
        return n

    got = by_text(docs, token_counts.token_counts(docs, pieces))
    for i, r in got.items():
        assert r["n_tokens"] == sum(greedy(b" " + w) for w in words(texts[i])), texts[i]
    assert token_counts.token_counts(empty, pieces).count() == 0
    assert token_counts.Automaton([b"a", b"ab"]).count(b"abz") == 1  # unknown


def test_simple8b():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        v = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        v[n // 2:n // 2 + 2] = 2 ** 64 - 1  # escapes
        w, o = simple8b.encode(v)
        assert (simple8b.decode(w, o, n) == v).all()
        for i in range(len(o) - 1):
            assert (simple8b.find_block(w, o, i, n) == v[i * 1024:(i + 1) * 1024]).all()


def test_token_ids(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted([(-1 if i == 7 else i, x) for i, x in enumerate(texts)] + [(1, texts[1])])
    got = token_ids.token_ids(docs, path).orderBy("start").collect()
    start = 0
    for (i, x), r in zip(rows, got, strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert token_ids.token_ids(empty, path).count() == 0
    odd = spark.createDataFrame([(0, "Don't stop!! a.b c,. <|endoftext|> ΣΑΣ. É. x_y_ 12,5. İ.")], "doc_id long, text string")
    ids = np.array([*t.encode(odd.first()["text"], add_special_tokens=False).ids, 2], "<u4")
    assert token_ids.token_ids(odd, path).first()["ids_crc32"] == zlib.crc32(ids)


def test_repeats(docs, texts, empty):
    rows = [(x or "").encode() for x in [*texts, texts[1]]]
    count = Counter(x[p:p + 400] for x in rows for p in range(len(x) - 399))
    got = by_text(docs, repeats.remove_repeats(docs))
    for i, r in got.items():
        x = rows[i]
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if count[x[p:p + 400]] > 1:
                gone[p:p + 400] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(x), gone.sum(), hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(empty).count() == 0
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_near_duplicates(docs, texts, empty):
    sets = {}
    for i, x in enumerate(texts):
        w = words(x)
        n = min(3, len(w))
        sets[i] = {tuple(v.lower() for v in w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    comp = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    got = by_text(docs, near_dedup.near_duplicates(docs, 3, 85))
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i), texts[i]
    assert near_dedup.near_duplicates(empty, 3, 85).count() == 0


def test_near_duplicate_chain(spark):
    """Links that do not go through the pivot: a chain of texts, each a few words from the next."""
    rng = np.random.default_rng(1)
    at = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(at)))
        at[rng.integers(0, 120)] = f"n{i}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.near_duplicates(d, 3, 85).where("component_id = 0").count() == 40


def test_decontaminate(spark, docs, texts, empty):
    items = [(0, " ".join(texts[4].split()[5:45])), (1, "no such words stand in any of the texts"), (2, None), (3, "two words"), (4, texts[11])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(4, 0), (11, 4)}
    edited = texts[11].split()
    edited[0] = "changed"
    near = spark.createDataFrame([(0, " ".join(edited) + " more words after it")], "doc_id long, text string")
    assert decontaminate.contamination(near, bench).select("item_id").first()[0] == 4
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("item_id < 0")).count() == 0


def test_mixing(docs, empty):
    out = mixing.taken(mixing.mix(docs)).collect()
    assert len(out) == docs.count()
    total = sum(r["size"] for r in out)
    targets = {r["source"]: r["target"] for r in out}
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - t) <= 32 for s, t in targets.items())
    assert mixing.taken(mixing.mix(empty)).count() == 0


def test_language_id(spark, empty):
    rng = np.random.default_rng(2)
    make = {"en": ["the", "of", "and", "thing", "whole", "with"], "es": ["el", "los", "ción", "para", "año", "que"]}
    rows = [(i, " ".join(rng.choice(make[x], 40)), x) for i, x in enumerate(["en", "es"] * 60)]
    rows += [(1000, None, None), (1001, "123 ... 4", None), (1002, "los años para que el", None), (None, "the thing", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(d).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:120])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "es"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert language_id.predict(empty, None).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, marg = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(emit[0, t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            marg[t, y] += p
    mask = np.ones((1, 4), bool)
    assert np.allclose(language_id.forward_backward(emit, trans, mask)[0][0], marg / total)
    assert np.allclose(language_id.posteriors(emit, trans, mask)[0], marg / total)


def test_quality_cnn(spark, docs, empty):
    good = [(i, f"plain words stand here in order {i} and more of them.") for i in range(80)]
    bad = [(100 + i, f"plain### words*** stand$$$ here%%% {i}") for i in range(80)]
    d = spark.createDataFrame([*good, *bad, (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_cnn.classify(d, labels).collect()}
    assert np.mean([got[i]["predicted"] == (i < 100) for i in got if i < 900 and got[i]["held_out"]]) > 0.95
    assert got[999]["score"] == got[998]["score"]
    assert quality_cnn.score(empty, None).count() == 0
    text = b"some bytes, " * 9000  # a text of several slices
    net = quality_cnn.train([[b"a" * 500]], [1])
    assert net.score([text, b"x"])[0] == pytest.approx(net.score([text])[0])


def test_rules_and_licences(docs, texts, empty):
    got = by_text(docs, quality_rules.quality_rules(docs))
    for i, r in got.items():
        w = words(texts[i])
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(hit))
    assert quality_rules.quality_rules(empty).count() == 0
    lic = by_text(docs, license_scan.scan(docs))
    assert [i for i, r in lic.items() if r["licences"]] == [25] and lic[25]["licences"] == ["MIT"]
    assert license_scan.scan(empty).count() == 0
    import re
    assert all(re.search(license_scan.TRIGGER, s) for s in license_scan.SENTENCES.values())


def test_licence_sentences_wrapped_at_any_width(spark):
    import textwrap

    grant, notice, as_is = (license_scan.SENTENCES[k] for k in ("mit_grant", "mit_notice", "as_is"))
    rows = [(w, "\n\n".join("\n".join(textwrap.wrap(s, w)) for s in (f"{grant}:", f"{notice}.", f"{as_is}."))) for w in (20, 60, 70, 76, 1000)]
    rows.append((1, "\n".join(f" * {w}" for s in (grant, notice, as_is) for w in s.split())))
    rows.append((2, f"{grant} and more\n{notice}"))  # a run has to end with a fragment
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(2)["sentence_ids"] == ["mit_notice"]
    for r in got.values():
        assert (r["sentence_ids"], r["licences"]) == (["mit_grant", "mit_notice", "as_is"], ["MIT"])
    # every sentence is found when it stands alone, and against runs made up one by one
    rows = [(i, "\n".join(textwrap.wrap(s, 24))) for i, s in enumerate(license_scan.SENTENCES.values())]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        f = rows[r["doc_id"]][1].split("\n")
        known = {v: k for k, v in license_scan.SENTENCES.items()}
        runs = [(known.get(" ".join(f[i:j])), i) for i in range(len(f)) for j in range(i + 1, len(f) + 1)]
        assert list(zip(r["sentence_ids"], r["fragment_at"], strict=True)) == [x for x in runs if x[0]]
        assert list(license_scan.SENTENCES)[r["doc_id"]] in r["sentence_ids"]


def test_repeats_hot_passage_goes_to_a_bucket_once_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(11)
    passage = rng.bytes(500).hex().encode()
    docs = [rng.bytes(40 + i).hex().encode() + passage + rng.bytes(30).hex().encode() for i in range(60)]
    parts = [repeats.samples(x, 16)[1:] for x in docs]
    rows = [r for x in repeats._deal([(i, -i) for i in range(60)], parts, np.uint32) for r in x.to_pylist()]
    entries = Counter((r["bucket"], h) for r in rows if r["bucket"] >= 0 for h in np.frombuffer(r["hashes"], np.uint32).tolist())
    every = Counter((int(b), int(np.uint32(h & np.uint64(0xFFFFFFFF)))) for h, bs in parts for h, b in zip(h, bs, strict=True))
    assert entries.keys() == every.keys() and set(entries.values()) == {1} and max(every.values()) > 1
    flags = next(r for r in rows if r["bucket"] < 0)
    assert sum(flags["counts"]) * 4 == len(flags["places"]) and sum(flags["counts"]) == sum(n for n in every.values() if n > 1)
    # a document's own repeats, in one bucket: the run that is left has gaps
    assert [r["counts"] for x in repeats._deal([(1, 1)], [(np.array([5, 5, 7], np.uint64), np.zeros(3, np.int64))], np.uint64)
            for r in x.to_pylist()] == [[2], [2]]
    # copies do not reach a bucket more than once, and slices of any size give the same bytes
    texts = [x.decode() for x in docs] + [docs[0].decode()] * 30 + ["y" * 1500, rng.bytes(700).hex()]
    count = Counter(x[p:p + 400] for x in texts for p in range(len(x) - 399))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for size in (1 << 22, 300):
        monkeypatch.setattr(repeats, "SLICE_BYTES", size)
        for r in repeats.remove_repeats(df).collect():
            x = texts[r["doc_id"]]
            gone = np.zeros(len(x), bool)
            for p in range(len(x) - 399):
                if count[x[p:p + 400]] > 1:
                    gone[p:p + 400] = True
            kept = np.frombuffer(x.encode(), np.uint8)[~gone].tobytes()
            assert (r["n_removed"], r["kept_sha256"]) == (gone.sum(), hashlib.sha256(kept).hexdigest())


def test_repeats_hold_little_beside_their_input():
    rng = np.random.default_rng(12)
    # a task's input of four million hashes is dealt in slices
    tile = rng.integers(0, 1 << 63, 4096, dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1024))] * 2, names=["k1", "k2"])
    tracemalloc.start()
    dealt = 0
    for keys, parts in repeats._by_slice([batch], lambda r: (x := tile + np.uint64(r["k1"].as_py()), repeats.bucket_of(x, 64))):
        for x in repeats._deal(keys, parts, np.uint64):
            dealt += sum(len(r) // 8 for r in x.column("hashes").to_pylist() if r is not None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dealt == 1024 * 4096 and peak < 150e6

    # a bucket larger than what is sorted at a time: pairs, a hash of a third of the places, and single ones
    n = 3 << 20
    h = rng.permutation(np.concatenate([np.repeat(np.arange(n // 6, dtype=np.uint64), 2), np.full(n // 3, n), n + 1 + np.arange(n // 3)]).astype(np.uint64))
    docs = np.arange(n // 64)
    pdf = pd.DataFrame({"bucket": 5, "slice": 0, "k1": np.split(docs, 32), "k2": np.split(-docs, 32), "counts": [np.full(len(docs) // 32, 64, np.int32)] * 32,
                        "hashes": [x.tobytes() for x in np.split(h, 32)], "places": None, "buckets": None})
    tracemalloc.start()
    flags = repeats.sort_bucket(pdf, np.uint64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * n
    got = np.zeros(n, bool)
    for k, places in zip(flags["k1"], flags["places"], strict=True):
        got[k * 64 + np.frombuffer(places, np.uint32)] = True
    assert (got == (h <= n)).all() and (flags["k1"] == -flags["k2"]).all()


def test_licence_families(spark):
    k = license_scan.SENTENCES
    bsd2 = f"{k['bsd_grant']}:\n1. {k['bsd_source']}.\n2. {k['bsd_binary']}."
    cut = lambda t: t.rfind(" ", 0, 60)
    gnu = lambda t: f"This library is free software; {t[:cut(t)]}\n * {t[cut(t) + 1:]}."
    texts = {
        bsd2: ["BSD-2-Clause"], f"{bsd2}\n3. {k['bsd_endorse']}.": ["BSD-3-Clause"],
        gnu(k["lgpl21_terms"]): ["LGPL-2.1-or-later"], gnu(k["lgpl3_terms"]): ["LGPL-3.0-or-later"], gnu(k["agpl3_terms"]): ["AGPL-3.0-or-later"],
        "# SPDX-License-Identifier: AGPL-3.0-or-later": ["AGPL-3.0-or-later"], "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["MIT OR Apache-2.0"], "SPDX-License-Identifier: MIT": ["MIT"],
        "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0 OR MIT"], "SPDX-License-Identifier: MIT AND unknown": [],
    }
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(0, rows[0][1], 2)], "doc_id long, text string, licences int")
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(df).collect()}
    assert {t: got[i] for i, t in rows} == texts
    long = "plain words without end " * 40_000 + ". Licensed under the MIT License."
    assert license_scan.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()["licences"] == ["MIT"]


def test_licence_sql_joins_any_number_of_lines(spark):
    import duckdb

    grant = license_scan.SENTENCES["mit_grant"].replace(" ", "\n")
    df = spark.createDataFrame([(1, f"{grant}:"), (2, "Licensed under the\nMIT License"), (3, None), (4, "")], "doc_id long, text string")
    with duckdb.connect() as con:
        con.register("documents", df.toPandas())
        want = sorted(con.execute(f"SELECT doc_id, n_sentences, sentence_ids, licences FROM ({license_scan.oracle()})").fetchall())
    got = sorted((r["doc_id"], len(r["sentence_ids"]), ",".join(r["sentence_ids"]), ",".join(r["licences"])) for r in license_scan.scan(df).collect())
    assert got == want and want[0][1:] == (1, "mit_grant", "MIT")
