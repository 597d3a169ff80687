"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs, queries


def brute(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                piece = words[i:i + length]
                if not any(piece[p:] == piece[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_every_run_of_random_sequences(letters):
    rng = np.random.default_rng(letters)
    for least in (2, 12):
        for n in (0, 1, 2, 3, 11, 40, 130):
            for _ in range(25):
                w = rng.integers(0, letters, n)
                assert [tuple(x) for x in periodic_runs.runs(w, least)] == brute(w.tolist(), least)


def test_every_run_of_built_sequences():
    rng = np.random.default_rng(9)
    fib = [[1], [0]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    cases = [fib[-1], [0, 1] * 20 + [0] + [0, 1] * 20, ([0] * 9 + [1]) * 12 + [0] * 30, [0, 1, 0, 1, 0, 1, 0, 1, 0] + [0, 1] * 4,
             [(i & -i).bit_length() for i in range(1, 200)]]
    for _ in range(60):  # powers of powers, with some letters changed
        w = rng.integers(0, 3, rng.integers(1, 6)).tolist()
        for _ in range(3):
            w = (w * rng.integers(1, 5))[: 200] + rng.integers(0, 3, rng.integers(0, 4)).tolist()
        cases.append(w[:260])
    for w in cases:
        for least in (2, 12):
            assert [tuple(x) for x in periodic_runs.runs(np.array(w), least)] == brute(w, least)


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["é", "b", "C", "c"], k)) for k in (5, 60, 300, 90, 33, 77, 150, 12, 30)] * 5
    texts += [None, "", " \n\t ", "one", "x " * 500, "a b c d e f g h i j k l " * 30, "tab\tand\x0bother\x0cwhite\rspace " * 9, "no break " * 20]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[2], "x", 1), (3, texts[3], "y", 2), (3, texts[3], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for size in (1 << 16, 100):
        monkeypatch.setattr(periodic_runs, "SLICE_WORDS", size)
        got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*cols).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(i, t)) for i, t, *_ in rows)
    out = periodic_runs.periodic_runs(df.where("doc_id = 49")).first()
    assert (out["text"], [tuple(r) for r in out["runs"]]) == ("x", [(0, 500, 1)])
    assert periodic_runs.periodic_runs(df.where("doc_id < 0")).count() == 0


def test_long_text(spark):
    """A text of many slices, its run over all of it."""
    w = [f"w{i}" for i in range(40_000)] * 3
    out = periodic_runs.periodic_runs(spark.createDataFrame([("s", " ".join(w))], "doc_id string, text string")).first()
    assert ([tuple(r) for r in out["runs"]], out["text"]) == ([(0, 120_000, 40_000)], " ".join(w[:40_000]))
