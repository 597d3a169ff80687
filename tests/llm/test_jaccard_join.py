"""The Jaccard join against all pairs."""

from itertools import combinations

import numpy as np
import pytest

from tessera.llm import jaccard_join
from tessera.llm.near_dedup import shingle_set


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        out.append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    return out


def brute(texts, width=5, percent=80):
    sets = sets_of(texts, width)
    comp = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


def corpus(seed):
    """Texts of 1 to 900 words, edits of them from one word to a fifth, shared passages, copies."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, texts = word(60), []
    for n in [1, 3, 5, 8, 9, 10, 12, 14, 15, 16, 20, 24, 31, 33, 40, 64, 90, 130, 250, 500, 900]:
        base = word(n)
        texts += [" ".join(base)] * 2
        for share in (0.01, 0.03, 0.04, 0.05, 0.1):
            w = list(base)
            for _ in range(max(1, int(n * share / 2))):
                at = rng.integers(0, len(w))
                w[at:at + rng.integers(0, 2)] = word(rng.integers(0, 2)) or w[at:at + 1]
            texts.append(" ".join(w))
        texts.append(" ".join(base + word(max(1, n // 5))))
        texts.append(" ".join(passage + base[:70]))
    return texts


def got(df, **kw):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, **kw).collect())


@pytest.mark.parametrize("width, percent", [(5, 80), (3, 90)])
def test_every_component(spark, width, percent):
    texts = corpus(width)
    rows = [(i, t.title() if i % 3 else t, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, key string").repartition(5)
    assert got(df, width=width, percent=percent) == brute([r[1] for r in rows], width, percent)


def test_every_linked_pair_meets_in_a_block_that_both_keep():
    """The pigeonhole guarantee, for sets that differ as much as a link allows."""
    rng = np.random.default_rng(3)
    per_block = jaccard_join.fullest(80)
    for n in [4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 17, 20, 26, 31, 33, 51, 63, 64, 100, 127, 128, 400, 511, 520, 1500]:
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for gone in range(n):  # as many as can go and come
                added = 0
                while 10 * (n - gone) >= 8 * (n + added + 1):
                    added += 1
                if 10 * (n - gone) < 8 * (n + added):
                    break
                if n > 40 and gone % (n // 12):
                    continue
                other = np.unique(np.concatenate([base[rng.permutation(n)[gone:]], rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
                if len(other) == n and not gone:
                    continue
                kept = []
                for s in (base, other):
                    keys = set()
                    for divisions, may_go in jaccard_join.emitted(s, 80, per_block):
                        keys |= {int(k) for d in divisions[:-1] for k in d}
                        # the fullest by any measure that both agree on: here, the smallest keys
                        keys |= set(sorted(map(int, divisions[-1]))[may_go:])
                    kept.append(keys)
                assert kept[0] & kept[1], (n, gone, added)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64))) for _ in "ab")
        bits, _ = jaccard_join.distance(jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b))
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0 or len(np.setxor1d(a, b)) % 2 == 0)


def test_chain_group_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    w, rows = [f"w{i}" for i in range(150)], []
    for i in range(30):  # each a few words from the next, far from the first
        rows.append((i, " ".join(w)))
        w[rng.integers(0, 150)] = f"n{i}"
    group = [f"g{i}" for i in range(200)]
    rows += [(100 + i, " ".join([*group[:i], f"x{i}", *group[i + 1:]])) for i in range(80)]
    rows += [(200 + i, " ".join(group[:60] + [f"y{i}_{k}" for k in range(90)])) for i in range(40)]  # share much, link with none
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "ONE two"), (305, "z " * 30_000), (None, "one two"), (303, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute([t for _, t in rows])
    ids = [i for i, _ in rows]
    least = {}
    for (_, n, c), i in zip(want, ids, strict=True):
        least[c] = min(least.get(c, 10 ** 9), i if i is not None else 10 ** 9)
    expect = sorted(((i, n, least[c] if n else i) for (_, n, c), i in zip(want, ids, strict=True)), key=str)
    out = jaccard_join.jaccard_join(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == expect
    assert jaccard_join.jaccard_join(df.where("doc_id < 0")).count() == 0
    assert jaccard_join.jaccard_join(df.where("doc_id in (300, 301, 303)")).count() == 4


def test_linear_work_in_a_group_of_near_copies(spark, monkeypatch):
    """Pairs that are compared grow with the group, not with its square."""
    made = []
    monkeypatch.setattr(jaccard_join, "near", lambda pairs, *a, f=jaccard_join.near: made.append(pairs.count()) or f(pairs, *a))
    base = [f"g{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i % 120], f"x{i}", *base[i % 120 + 1:]])) for i in range(300)]
    assert jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).where("component_id = 0").count() == 300
    assert sum(made) < 6 * 300


def test_sets_too_small_for_another_partner():
    for n in range(1, 12):
        items = shingle_set(" ".join(f"w{i}" for i in range(n)).encode(), 1)
        links = any(100 * min(n, m) >= 80 * max(n, m) for m in range(1, 20) if m != n) or n >= 9
        assert bool(jaccard_join.emitted(items, 80, jaccard_join.fullest(80))) == links


def test_keys_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (3, 14), (3, 15), (None, 16)], "block long, of long")
    found = jaccard_join.with_mates(df.where("block is not null"))
    assert sorted((r["block"], r["of"], r["mates"]) for r in found.collect()) == [(1, 10, 2), (1, 11, 2), (3, 13, 3), (3, 14, 3), (3, 15, 3)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
