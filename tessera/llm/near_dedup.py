"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. Sketch: a document's set of word shingles is hashed into ``BANDS * ROWS`` bins in rounds;
   each bin keeps the smallest value of the first round that reaches it. Rounds after the
   ``BANDS * ROWS``-th fill one given bin each, so every coordinate is filled.
2. Documents with the same set form one class (an equality of 128-bit set hashes), which
   goes on as one row however many copies it has.
3. Bands of ``ROWS`` coordinates put classes into buckets. With ``BANDS`` = 32 bands of 4, a
   pair of similarity 0.8 shares no bucket with probability 5e-8 (0.85: 6e-11).
4. In each bucket one pivot, the class with the most bucket mates, is compared with the
   others on the full shingle sets; components follow from the confirmed links. A group
   of thousands of near copies so costs about one comparison per class, not one per pair.
5. What is left are pairs of different components in one bucket. With x, y and pivot p,
   |x & y| <= min(|x & p|, |y & p|) + |(x - p) & (y - p)|, and the first part is known: a
   pair is compared on full sets only if that bound allows a link, or they
   share enough shingles that the pivot lacks: such pairs meet in an equi-join on the
   rarest of those. Both conditions are necessary, so no link between components is lost.

Defined results: null and wordless texts have an empty set, are linked with nothing and
are their own component; repeated rows share their class; a null id takes part, but a
component's id is its smallest non-null id (null if none); kept compares ids null-safely;
an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_table, written

BANDS, ROWS = 32, 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_EMPTY = np.uint64(2 ** 64 - 1)


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_A) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()  # bytes.lower: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))  # fewer words: the whole sequence is one shingle
    s = np.full(len(h) - n + 1, _times(n), np.uint64)
    for k in range(n):
        s = mixed(s + h[k:len(h) - n + 1 + k]) * _A
    return np.unique(s)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set."""
    out = np.full(bins, _EMPTY, np.uint64)
    for i in range(2 * bins):
        v = mixed(items * _B + _times(i + 1))
        if i < bins:
            to = ((v >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            now = np.full(bins, _EMPTY, np.uint64)
            np.minimum.at(now, to, mixed(v))
            out = np.where(out == _EMPTY, now, out)
        elif out[i - bins] == _EMPTY:
            out[i - bins] = mixed(v).min()
        if i >= bins - 1 or not i % 2:
            if not (out == _EMPTY).any():
                break
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    s = sketch(items, BANDS * ROWS).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _A
    for j in range(ROWS):
        key = mixed(key + s[:, j]) * _C
    return key.view(np.int64)


def set_key(items: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(items))
        return b"".join(int(mixed(np.array([mixed(items + salt).sum() + n * salt]))[0]).to_bytes(8, "big") for salt in (_A, _C))


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Written table (doc_id, th: text hash, n_shingles, key, bands): one small row a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        worker_table("none", dict)  # frees another operator's table
        for batch in batches:
            n, key, bands = [], [], []
            for text in batch.column(2):
                items = shingle_set(text.as_py(), width)
                n.append(len(items))
                key.append(set_key(items) if len(items) else None)
                bands.append(band_keys(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n_shingles", "key", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, key binary, bands array<long>"), "sketches")


def class_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Written table (key, items) for the classes in ``wanted`` (key, rep: a member's id and
    text hash), from the texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    w = wanted.select("key", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    # a shuffle at every size: neither side is known to be small
    got = rows.join(w.hint("merge"), (rows["th"] == w["r_th"]) & rows["doc_id"].eqNullSafe(w["r_id"])).select("key", "text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["key", "items"])

    return written(got.dropDuplicates(["key"]).mapInArrow(run, "key binary, items array<long>"), "sets")


def enough(both, nx, ny, percent: int):
    """100 * intersection >= percent * union, for set sizes nx and ny."""
    return both * (100 + percent) >= (nx + ny) * percent


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with both (size of the intersection) and ia, ib (the sets of keys a and b)."""
    a = sets.select(F.col("key").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("key").alias("b"), F.col("items").alias("ib"))
    return pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ia", "ib")))


def components(links: DataFrame) -> DataFrame:
    """Written table (key, comp): the smallest key reachable over links (a, b), by
    neighbours' minima and pointer jumping; one written table a round."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "comp"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "key").select("key", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        new = written(low.join(jump, "comp", "left").select("key", "was", F.least("comp", "far").alias("comp")), "labels")
        if new.where(F.col("comp") != F.col("was")).isEmpty():
            return new.select("key", "comp")
        labels = new.select("key", "comp")


def linked_classes(docs: DataFrame, rows: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """(key, comp) of the classes that have a link; None without any."""
    classes = rows.where(F.col("n_shingles") > 0).groupBy("key").agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    spread = classes.select("key", "n", "rep", F.explode("bands").alias("band"))
    full = spread.groupBy("band").agg(F.count("*").alias("mates")).where(F.col("mates") > 1)
    member = written(spread.join(full, "band"), "buckets")
    wanted = written(member.groupBy("key").agg(F.first("rep").alias("rep"), F.sum("mates").alias("degree")), "wanted")
    if wanted.isEmpty():
        return None
    sets = class_sets(docs, wanted, width, id_col, text_col)
    member = member.drop("rep", "mates").join(wanted.select("key", "degree"), "key")
    pivots = member.groupBy("band").agg(F.max(F.struct("degree", "key", "n")).alias("p"))
    member = written(member.join(pivots, "band").select("band", "key", "n", F.col("p.key").alias("p"), F.col("p.n").alias("np")), "members")
    # every class against the pivots of its buckets
    star = member.where("key <> p").select(F.col("key").alias("a"), F.col("p").alias("b"), "n", "np").distinct()
    star = overlaps(star, sets).withColumn("linked", enough(F.col("both"), F.col("n"), F.col("np"), percent))
    star = written(star.select("a", "b", "both", "linked", F.array_except("ia", "ib").alias("own")), "stars")
    links = star.where("linked").select("a", "b")
    comp = components(links)
    found = written(cross_links(member, star, comp, sets, percent), "links")
    if not found.isEmpty():
        comp = components(links.union(found))
    return comp


def cross_links(member: DataFrame, star: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components, among the pairs that share a bucket."""
    m = member.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    split = m.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    known = star.select(F.col("a").alias("key"), F.col("b").alias("p"), F.col("both").cast("long").alias("both"))
    m = m.join(split, "band").join(known, ["key", "p"], "left").withColumn("both", F.coalesce("both", "n"))
    m = written(m.select("band", "key", "n", "p", "comp", "both"), "open")
    x = lambda c, y: [F.col(k).alias(f"{k}_{y}") for k in c]
    side = ("key", "n", "comp", "both")
    apart = (F.col("key_x") < F.col("key_y")) & (F.col("comp_x") != F.col("comp_y"))
    shared = F.least("both_x", "both_y")
    fits = enough(shared, F.col("n_x"), F.col("n_y"), percent)
    near = m.select("band", *x(side, "x")).join(m.select("band", *x(side, "y")), "band").where(apart & fits)
    # Pairs that need shingles their pivot lacks: at least percent * n - both of x's own ones
    # (sizes differ by that factor at most), so two linked classes meet within the first
    # (100 - percent) percent of n, plus one, of their own shingles, the rarest first.
    own = m.where("key <> p").select("p", *side).distinct().join(
        star.select(F.col("a").alias("key"), F.col("b").alias("p"), "own"), ["key", "p"])
    own = own.select("p", *side, F.explode("own").alias("item"))
    own = own.join(own.groupBy("p", "item").agg(F.count("*").alias("often")), ["p", "item"])
    rarest = F.row_number().over(Window.partitionBy("p", "key").orderBy("often", "item"))
    own = own.withColumn("rank", rarest).where((F.col("often") > 1) & (F.col("rank") <= F.floor(F.col("n") * (100 - percent) / 100) + 1))
    other = own.select("p", "item", *x(side, "x")).join(own.select("p", "item", *x(side, "y")), ["p", "item"]).where(apart & ~fits)
    other = other.select("p", "key_x", "key_y", "n_x", "n_y", "both_x", "both_y").distinct()
    for y in "xy":
        other = other.join(star.select(F.col("a").alias(f"key_{y}"), F.col("b").alias("p"), F.col("own").alias(f"own_{y}")), ["p", f"key_{y}"])
    other = other.where(enough(shared + F.size(F.array_intersect("own_x", "own_y")), F.col("n_x"), F.col("n_y"), percent))
    pairs = near.select(F.col("key_x").alias("a"), F.col("key_y").alias("b"), "n_x", "n_y").union(
        other.select("key_x", "key_y", "n_x", "n_y")).distinct()
    return overlaps(pairs, sets).where(enough(F.col("both"), F.col("n_x"), F.col("n_y"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept), one row per input row."""
    rows = sketched(docs, width, id_col, text_col)
    comp = linked_classes(docs, rows, width, percent, id_col, text_col)
    ids = rows.where(F.col("n_shingles") > 0).groupBy("key").agg(F.min("doc_id").alias("low"))
    if comp is not None:
        ids = ids.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        low = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
        ids = ids.join(low, "comp").select("key", "component_id")
    else:
        ids = ids.select("key", F.col("low").alias("component_id"))
    out = rows.select("doc_id", "th", "n_shingles", "key").join(ids, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(width: int = 3, percent: int = 85) -> str:
    """DuckDB SQL of the query's rows: all pairs that share a shingle, then reachability."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS s FROM w),
k AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS c, s FROM g),
c AS (SELECT c, min(doc_id) AS id, any_value(s) AS s, any_value(n) AS n FROM k WHERE n > 0 GROUP BY c),
e AS (SELECT id, n, unnest(s) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS both_n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
  AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY ALL HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.low, k.doc_id) AS component_id, k.doc_id = coalesce(m.low, k.doc_id) AS kept
FROM k LEFT JOIN c ON k.n > 0 AND k.c = c.c LEFT JOIN m ON m.a = c.id"""
