"""Prefix trie of rebuilt conversations, by composable fingerprints of turn sequences.

A conversation is rebuilt from the first ``h`` turns of its base and its own turns after its
first ``h``. Rebuilt texts are never put together: the fingerprint of a sequence of turns is an
element of a monoid, (length, sum of letter * root ** place modulo a prime), in which

    (n, x) * (m, y) = (n + m, x + root ** n * y),

so a node of the trie follows from three products that the original conversations have: the
base's head, the own prefix up to a turn, and the own prefix of ``h`` turns, taken away.

1. Each original turn gets a letter, from two 64-bit hashes of its role and text. That
   different turns have different hashes is verified on the texts (grouped, so a text that
   many turns share counts once a task); if not, all starts again with another seed.
2. Prefix products along the conversations: turns are range-partitioned by (conversation,
   order), each partition multiplies up its own part of a conversation, and a conversation
   that spans partitions gets the product of its earlier parts. One of any length is so
   spread over tasks. Four lanes modulo 2**31 - 1 make a fingerprint of 124 bits.
3. Nodes are groups of (depth, fingerprint). Each node keeps a reference to a turn (conversation
   and number) that labels it, and a group is verified: all its turns have the same hashes of
   role and text. Then the sequences without their last turn have the same fingerprint, too
   (a last turn can be divided out), so, by depth, equal groups are equal sequences. A group
   that fails starts all again with another seed. Heads count once for all conversations of
   a base that share them.
4. Sums over subtrees need no walk down the trie. A node's value is credited to its smallest
   member; then a subtree's sum is what the members of its top were credited with, less what
   the top's smallest member got above the top.
5. Ids of conversations that end at a node are joined in order as pieces, and the pieces
   are hashed in order, as a stream.

Defined results: a null role or text is the empty one; turns are ordered by turn (null
first), equal turns by role, then text; repeated rows are turns of their own; rows without a
conversation id belong to no conversation; the remainder of a negative id is that of SQL
(its sign is the id's); an empty table has no node; only the four columns are read, whatever
else the table holds; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PRIME = 2 ** 31 - 1
LANES = 4
#: bytes of joined ids in a piece
PIECE = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def roots_of(seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(2, PRIME - 1) for _ in range(LANES)]


def powers(root: int, n: int) -> np.ndarray:
    """root ** 0 ... root ** (n - 1) modulo PRIME, kept by the worker."""
    have = _POWERS.get(root, np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * pow(root, len(have), PRIME) % PRIME])
    _POWERS[root] = have
    return have[:n]


def prefix_sums(df: DataFrame, group: str, order: list[Column], keep: list[str], values: list[str], roots: list[int] | None, name: str) -> DataFrame:
    """``keep`` and ``values`` with i (a row's number in its group, from 1), s0, s1, ... (sums of
    the values up to and with the row) and, with ``roots``, t0, t1, ... (its own terms): value
    j counts times roots[j] ** (i - 1) modulo PRIME; without, plainly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = range(len(values))
    names = [group, *keep, *values]

    def local(batches):
        part, last, had, carry = TaskContext.get().partitionId(), None, 0, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            new = np.append(g[0] != last, g[1:] != g[:-1])
            row = np.arange(len(g))
            start = np.maximum.accumulate(np.where(new, row, 0))
            on = (start == 0) & (not new[0])  # rows that carry on the group of the batch before
            i = row - start + 1 + np.where(on, had, 0)
            sums, terms = [], []
            for j in lanes:
                t = batch.column(1 + len(keep) + j).to_numpy()
                t = t * powers(roots[j], int(i.max()))[i - 1] % PRIME if roots else t
                upto = np.cumsum(t)
                s = upto - (upto - t)[start] + np.where(on, carry[j], 0)
                sums.append(s % PRIME if roots else s)
                terms.append(t)
            last, had, carry = g[-1], int(i[-1]), [int(s[-1]) for s in sums]
            made = [np.full(len(g), part), i, *sums, *(terms if roots else ())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in made)], names=[*names, *more])

    more = ["part", "i", *(f"s{j}" for j in lanes), *(f"t{j}" for j in lanes if roots)]
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).select(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = written(ranged.mapInArrow(local, kinds + "".join(f", {c} long" for c in more)), name)
    parts = placed.groupBy(group, "part").agg(F.max("i").alias("n"), *(F.max_by(f"s{j}", "i").alias(f"s{j}") for j in lanes))
    # groups that lie in several partitions: at most two of them begin or end in any partition
    parts = parts.withColumn("in_parts", F.count("*").over(Window.partitionBy(group))).where("in_parts > 1").drop("in_parts")

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        """What the earlier parts of a group come to: one row a partition."""
        rows, n0, total = [], 0, [0] * len(values)
        for r in pdf.sort_values("part").itertuples(index=False):
            by = [pow(roots[j], n0, PRIME) if roots else 1 for j in lanes]
            rows.append((r[0], r[1], n0, *total, *by))
            total = [total[j] + by[j] * int(r[3 + j]) for j in lanes]
            total = [x % PRIME for x in total] if roots else total
            n0 += int(r[2])
        return pd.DataFrame(rows, columns=at)

    at = [group, "part", "n0", *(f"o{j}" for j in lanes), *(f"w{j}" for j in lanes)]
    offsets = parts.groupBy(group).applyInPandas(before, ", ".join(f"{c} long" for c in at))
    out = placed.join(F.broadcast(offsets), [group, "part"], "left")
    at_most = lambda c: c % PRIME if roots else c
    zero, one = F.lit(0), F.lit(1)
    return out.select(
        *names, (F.col("i") + F.coalesce("n0", zero)).alias("i"),
        *(at_most(F.coalesce(f"o{j}", zero) + F.coalesce(f"w{j}", one) * F.col(f"s{j}")).alias(f"s{j}") for j in lanes),
        *((F.coalesce(f"w{j}", one) * F.col(f"t{j}") % PRIME).alias(f"t{j}") for j in lanes if roots))


def packed(lane) -> list[Column]:
    """The four lanes as two longs, f1 and f2."""
    return [F.shiftleft(lane(j), 31).bitwiseOR(lane(j + 1)).alias(f"f{1 + j // 2}") for j in (0, 2)]


def letters(k1: str, k2: str) -> list[Column]:
    half = lambda k: (F.shiftrightunsigned(k, 33), F.col(k).bitwiseAND(2 ** 31 - 1))
    return [1 + x % (PRIME - 1) for x in (*half(k1), *half(k2))]


def joined_ids(ends: DataFrame, node: list[str], id_col: str) -> DataFrame:
    """node columns and ends_sha256: the hash of the ids, ascending, joined by commas."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} long" for c in node)

    def pieces(batches):
        part, seq, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        rows: list[tuple] = []

        def close():
            nonlocal seq, held, size
            if held:
                rows.append((*now, part, seq, ",".join(held).encode()))
                seq, held, size = seq + 1, [], 0

        for batch in batches:
            for *key, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if key != now or size >= PIECE:
                    close()
                    now = key
                held.append(text := str(c))
                size += len(text) + 1
            if rows:
                yield from _batch(rows)
                rows = []
        close()
        yield from _batch(rows)

    def _batch(rows):
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())],
                                             names=[*node, "part", "seq", "ids"])

    def hashed(batches):
        now, sha, rows = None, None, []
        for batch in batches:
            for *key, _, _, ids in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        rows.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids)
            if len(rows) > 1000:
                yield _hashes(rows)
                rows = []
        if now is not None:
            yield _hashes([*rows, (*now, sha.hexdigest())])

    def _hashes(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1])], names=[*node, "ends_sha256"])

    ends = ends.select(*node, id_col)
    ends = ends.repartitionByRange(n, *node, id_col).sortWithinPartitions(*node, id_col)
    made = ends.mapInArrow(pieces, kinds + ", part long, seq long, ids binary")
    made = made.repartition(n, *node).sortWithinPartitions(*node, "part", "seq")
    return made.mapInArrow(hashed, kinds + ", ends_sha256 string")


NODE = ["depth", "f1", "f2"]


def _nodes(turns: DataFrame, every: int, heads: int, seed: int):
    """(nodes, own entries, head entries, plan of the conversations), or None if two different
    turns or sequences share a hash."""
    roots = roots_of(seed)
    t = turns.withColumn("k1", F.xxhash64(F.lit(seed), "role", "text")).withColumn("k2", F.xxhash64(F.lit(~seed), "text", "role"))
    contents = t.groupBy("role", "text", "k1", "k2").agg(F.lit(1).alias("one"))
    if not contents.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        return None
    t = t.select("conv_id", "turn", "role", "text", "k1", "k2", F.octet_length("text").cast("long").alias("bytes"),
                 *(x.alias(f"l{j}") for j, x in enumerate(letters("k1", "k2"))))
    # bounds of ranges hold the beginnings of texts only; equal ones stay together and are sorted whole
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("text")]
    t = t.withColumn("head", F.substring("text", 1, 32))
    keep, values = ["k1", "k2", "bytes"], [f"l{j}" for j in range(LANES)]
    prefix = written(prefix_sums(t, "conv_id", order, keep, values, roots, "turns").drop(*values), "prefixes")

    plan = prefix.groupBy("conv_id").agg(F.max("i").alias("n"))
    plan = plan.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long"))
    plan = plan.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    plan = plan.join(plan.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    plan = plan.withColumn("hb", F.least("h", F.coalesce("of_base", F.lit(0)))).drop("of_base")
    low = prefix.where(F.col("i") < heads)
    for c, place, new in (("base", "hb", "g"), ("conv_id", "h", "c")):
        at = low.select(F.col("conv_id").alias(c), F.col("i").alias(place), *(F.col(f"s{j}").alias(f"{new}{j}") for j in range(LANES)))
        plan = plan.join(at, [c, place], "left").fillna(0, [f"{new}{j}" for j in range(LANES)])
    plan = written(plan, "plan")

    inverse = [F.array(*(F.lit(pow(r, -x, PRIME)) for x in range(heads))) for r in roots]
    own = prefix.join(plan, "conv_id").where("i > h")

    def rebuilt(j: int, less: str | None = None) -> Column:
        """Lane j of the base's head times the own turns after the first h, without the last if ``less``."""
        x = F.col(f"s{j}") - F.col(f"c{j}") - (F.col(f"{less}{j}") if less else 0)
        return (F.col(f"g{j}") + F.pmod(x, F.lit(PRIME)) * F.get(inverse[j], F.col("h") - F.col("hb"))) % PRIME

    def parent(lane) -> list[Column]:
        return [c.alias(f"p{i}") for i, c in enumerate(packed(lane), 1)]

    own = own.select((F.col("hb") + F.col("i") - F.col("h")).alias("depth"), *packed(rebuilt), *parent(lambda j: rebuilt(j, "t")),
                     *keep, "conv_id", F.lit(1).alias("n"), F.col("conv_id").alias("ref_conv_id"), F.col("i").alias("ref_turn"),
                     (F.col("i") == F.col("n")).alias("ends"))
    own = written(own, "own")
    shared = plan.select(F.col("base"), "conv_id", F.explode(F.when(F.col("hb") > 0, F.sequence(F.lit(1), "hb"))).alias("depth"))
    shared = shared.groupBy("base", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    upto = low.select(F.col("conv_id").alias("base"), F.col("i").alias("depth"), *packed(lambda j: F.col(f"s{j}")),
                      *parent(lambda j: F.pmod(F.col(f"s{j}") - F.col(f"t{j}"), F.lit(PRIME))), *keep)
    head = written(shared.join(upto, ["base", "depth"]), "heads")
    cols = [*NODE, "p1", "p2", *keep, "conv_id", "n", "ref_conv_id", "ref_turn"]
    entries = own.select(*cols).union(head.withColumn("ref_conv_id", F.col("base")).withColumn("ref_turn", F.col("depth")).select(*cols))
    label = F.min(F.struct("conv_id", "ref_conv_id", "ref_turn"))
    nodes = entries.groupBy(*NODE).agg(
        label.alias("ref"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        (F.min("k1") == F.max("k1")).alias("a"), (F.min("k2") == F.max("k2")).alias("b")).select(
        *NODE, "ref.*", "n_convs", "bytes", "p1", "p2", (F.col("a") & F.col("b")).alias("same"))
    no = F.lit(None).cast("long")
    root = plan.groupBy(F.lit(0).cast("long").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).select(
        "depth", F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id", no, no, "n_convs", F.lit(0).cast("long"), no, no, F.lit(True))
    nodes = written(nodes.union(root), "nodes")
    if not nodes.where("not same").isEmpty():
        return None
    return nodes.drop("same"), own, head, plan


def prefix_trie(conversations: DataFrame, every: int = 5, heads: int = 9, seed: int = 1, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the turn that labels it (ref_conv_id, ref_turn: its number
    there, from 1; null for the root)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    while (made := _nodes(turns, every, heads, seed)) is None:
        seed += 1
    nodes, own, head, plan = made
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"]).join(above, ["depth", "p1", "p2"], "left")
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    cols = ["f1", "f2", "depth", "parent_conv_id", "n_convs", "n_children", "ref_conv_id", "ref_turn"]
    chain = written(prefix_sums(nodes.drop("p1", "p2", "bytes"), "conv_id", [F.asc("depth")], cols, ["leaf", "saved"], None, "chains"), "chains")
    # what the smallest member was credited with above each node, and in all
    credit = chain.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("all_saved"))
    total = [F.sum("leaves").alias("leaves"), F.sum("all_saved").alias("all_saved")]
    by_own = own.join(credit, "conv_id").groupBy(*NODE).agg(*total)
    by_head = plan.where("hb > 0").join(credit, "conv_id").select("base", F.explode(F.sequence(F.lit(1), "hb")).alias("depth"), "leaves", "all_saved")
    by_head = by_head.groupBy("base", "depth").agg(*total).join(head.select("base", *NODE), ["base", "depth"]).select(*NODE, "leaves", "all_saved")
    by_root = credit.agg(*total).select(*(F.lit(0).cast("long").alias(c) for c in NODE), "leaves", "all_saved")
    ends = own.where("ends").select(*NODE, "conv_id").union(
        plan.where("n <= h").select(F.col("hb").alias("depth"), *packed(lambda j: F.col(f"g{j}")), "conv_id"))
    hashes = joined_ids(ends, NODE, "conv_id")
    no_sha, no_sum = F.lit(None).cast("string"), F.lit(None).cast("long")
    of_node = by_own.union(by_head).union(by_root).withColumn("sha", no_sha).union(
        hashes.select(*NODE, no_sum, no_sum, "ends_sha256")).groupBy(*NODE).agg(*total, F.max("sha").alias("sha"))
    return chain.join(of_node, NODE).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("s0") + F.col("leaf")).alias("n_leaves"), (F.col("all_saved") - F.col("s1") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "ref_conv_id", "ref_turn")


def oracle(every: int = 5, heads: int = 9) -> str:
    """DuckDB SQL of the query's rows: every rebuilt prefix written out."""
    step = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS b,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list_transform(range(256), lambda x: {step.format(x="x")}) AS crc),
c0 AS (SELECT conv_id, list(struct_pack(k := k, b := b) ORDER BY i) AS own FROM t GROUP BY conv_id),
c1 AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, s: xor(c >> 8, crc[1 + (xor(c, s) & 255)])), 4294967295) % {heads} AS h, conv_id - conv_id % {every} AS base FROM c0, tab),
c AS (SELECT x.conv_id, list_concat(coalesce(y.own, [])[1:x.h], x.own[x.h + 1:]) AS s FROM c1 x LEFT JOIN c0 y ON y.conv_id = x.base),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c),
m AS (SELECT conv_id, d AS depth, md5(array_to_string(list_transform(s[1:d], lambda e: e.k), '')) AS path, d = len(s) AS ends,
  CASE WHEN d > 0 THEN md5(array_to_string(list_transform(s[1:d - 1], lambda e: e.k), '')) END AS up, CASE WHEN d > 0 THEN s[d].b ELSE 0 END AS b FROM p),
n AS (SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT a.depth, a.path, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.b) AS saved_tokens
  FROM v JOIN m w ON w.conv_id = v.conv_id AND w.depth <= v.depth JOIN n a ON a.depth = w.depth AND a.path = w.path GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, path) LEFT JOIN n u ON u.depth = v.depth - 1 AND u.path = v.up"""
