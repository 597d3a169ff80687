"""The prefix trie against rebuilt conversations written out."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import prefix_trie, queries

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, part int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    sub = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        sub[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in sub.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(sub[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made(seed, n_convs, words, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-20, 3 * n_convs), n_convs, replace=False).tolist():
        for k in range(rng.integers(1, longest)):
            turn = [k, None, 3, -k][rng.choice(4, p=[.85, .05, .05, .05])]
            rows.append((c, turn, [None, "", "user", "bot"][rng.integers(4)] if words > 1 else "user",
                         [None, "", "é", "ok", "thanks a lot", "no"][rng.integers(min(words, 6))], "x", 1))
    return rows


@pytest.mark.parametrize("seed, n_convs, words, longest", [(1, 60, 6, 12), (2, 90, 1, 12), (3, 40, 2, 5), (4, 25, 1, 60)])
def test_every_node(spark, tmp_path, seed, n_convs, words, longest):
    rows = made(seed, n_convs, words, longest)
    rows += [(None, 0, "user", "no conversation", "x", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    want = brute(rows)
    assert sorted(map(tuple, got.select(*COLS).collect())) == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        assert sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({queries.ORACLE['op11_prefix_trie']})").fetchall()) == want


def test_one_conversation_over_all_partitions(spark):
    rows = [(7, i, "user", f"turn {i % 3}", "x", 1) for i in range(400)] + [(c, i, "user", f"turn {i % 3}", "x", 1) for c in range(8, 30) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).select(*COLS).collect())) == brute(rows)


def test_empty_tables_and_turnless_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(df).count() == 0
    rows = [(c, 0, "user", "only", "x", 1) for c in range(40)]  # most own turns fall away
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLS).collect())) == brute(rows)


def test_colliding_fingerprints_start_again(spark, monkeypatch):
    """With a root of 1 a sequence's fingerprint does not tell the order of its turns."""
    real, seeds = prefix_trie.roots_of, []
    monkeypatch.setattr(prefix_trie, "roots_of", lambda seed: seeds.append(seed) or ([1] * 4 if seed < 3 else real(seed)))
    rows = [(c, i, "user", f"{(c * i) % 7}", "x", 1) for c in range(0, 60, 5) for i in range(12)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLS).collect())) == brute(rows)
    assert seeds == [1, 2, 3]


def test_labels_refer_to_turns(spark):
    rows = made(8, 50, 6, 10)
    df = spark.createDataFrame([(c, i, r, t, d, p) for i, (c, _, r, t, d, p) in enumerate(rows)], SCHEMA)
    own = defaultdict(list)
    for i, (c, _, r, t, *_) in enumerate(rows):
        own[c].append((r or "", t or ""))
    for r in prefix_trie.prefix_trie(df).where("depth > 0").collect():
        h, base = zlib.crc32(str(r["conv_id"]).encode()) % 9, r["conv_id"] - int(np.fmod(r["conv_id"], 5))
        s = own.get(base, [])[:h] + own[r["conv_id"]][h:]
        assert own[r["ref_conv_id"]][r["ref_turn"] - 1] == s[r["depth"] - 1]


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(i % 2, 0, 0, i) for i in range(-100, 2000)]
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.joined_ids(
        spark.createDataFrame(rows, "depth long, f1 long, f2 long, id long").repartition(6), prefix_trie.NODE, "id").collect()}
    for d in (0, 1):
        assert got[d] == hashlib.sha256(",".join(str(i) for i in range(-100, 2000) if i % 2 == d).encode()).hexdigest()
