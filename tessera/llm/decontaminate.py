"""Benchmark decontamination by SimHash of item-sized windows.

1. Words are the runs of letters and digits of the lower-cased text; shingles are five
   words. A document's positions whose shingle also stands in some item say where
   windows can matter: a window that shares no shingle with any item has similarity 0.
   Each such position, with the shingle's places in items, proposes windows of those
   items' sizes, aligned on the shared shingle.
2. Every proposed window and every item gets a 128-bit SimHash of its weighted shingles
   (weight: occurrences).
3. Multi-index: 8 blocks of 16 bits. Two fingerprints within ``RADIUS`` = 31 bits agree in
   some block up to 3 bits, so items are entered under all 697 variants of each block and
   windows look their blocks up: all pairs of equal size within the radius are found.
   A pair of similarity 0.8 is further apart with probability about 0.002.
4. Pairs are verified by exact weighted-shingle Jaccard similarity of 0.8 or more.

All steps are DataFrame operations. The items' shingles are broadcast up to
``BROADCAST_SHINGLES`` of them, beyond that joined by a shuffle.

Defined results: null, empty and short (under five words) texts and items match nothing;
windows are cut at a text's ends; a window's extra words lower its similarity; equal
rows (id and text) give the same hits once; a null id is carried; items that repeat are
separate hits; empty tables give no hit; only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

WIDTH, PERCENT = 5, 80
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_SHINGLES = 1_000_000
_MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")


def shingles(ws: str) -> Column:
    """Hashes of the five-word shingles, in order; empty under five words."""
    last = WIDTH - 1
    return F.when(F.size(ws) > last, F.transform(
        F.slice(ws, F.lit(1), F.size(ws) - last),
        lambda w, i: F.xxhash64(w, *[F.col(ws)[i + F.lit(k)] for k in range(1, WIDTH)]))).otherwise(F.array().cast("array<long>"))


def fingerprint(hashes: str) -> Column:
    """SimHash as BLOCKS integers of BLOCK_BITS bits: a bit is set if it is set in more
    than half of the shingles, counted with their occurrences."""
    per = 64 // BLOCK_BITS
    spread = F.array(F.transform(hashes, lambda h: F.xxhash64(h)), F.transform(hashes, lambda h: F.xxhash64(h, F.lit(1))))

    def block(b):
        # the words of BLOCK_BITS bits that the block votes on
        part = F.transform(F.get(spread, F.floor(b / per).cast("int")), lambda h: F.call_function(
            "shiftrightunsigned", h, (b % per) * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
        bit = lambda acc, j: acc + F.when(
            F.aggregate(part, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftright", h, j).bitwiseAND(F.lit(1))) * 2 > F.size(hashes),
            F.call_function("shiftleft", F.lit(1), j)).otherwise(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)), F.lit(0), bit)

    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block)


def weighted_overlap(a: str, b: str) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda xs, s: F.size(F.filter(xs, lambda y: y == s))
    # if either side has every shingle once, the smaller number is 0 or 1
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s))))


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Written table (item_id, item: row key, size, hs) of items of five words or more."""
    it = benchmark.select(F.col(item_col).alias("item_id"), normal_words(F.col(text_col)).alias("ws"))
    it = it.select("item_id", F.size("ws").alias("size"), shingles("ws").alias("hs")).where(F.size("hs") > 0)
    it = written(it.withColumn("item", F.monotonically_increasing_id()), "items")
    return it.withColumn("fp", fingerprint("hs"))


def proposed(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, windows: array of start and size) of documents that share a shingle."""
    places = items.select("size", F.posexplode("hs").alias("at", "h")).distinct()
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)
    own = docs.select("doc_id", "th", F.posexplode(shingles("ws")).alias("pos", "h"))
    # an anti-aligned start before the text is kept: the window is cut there
    hits = own.join(places, "h").select("doc_id", "th", F.struct((F.col("pos") - F.col("at")).alias("start"), "size").alias("w")).distinct()
    return hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("w")).alias("windows"))


def windows_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, th, start, size, hs): the windows with their shingles, from the texts."""
    f = found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "windows")
    j = docs.join(f, (docs["th"] == f["f_th"]) & docs["doc_id"].eqNullSafe(f["f_id"])).select("doc_id", "th", "windows", shingles("ws").alias("all"))
    one = F.transform("windows", lambda w: F.struct(
        w["start"].alias("start"), w["size"].alias("size"),
        F.slice("all", F.greatest(w["start"], F.lit(0)) + 1,
                F.greatest(F.least(w["start"] + w["size"] - (WIDTH - 1), F.size("all")) - F.greatest(w["start"], F.lit(0)), F.lit(0))).alias("hs")))
    # rows with equal id and text are one document here
    return j.select("doc_id", "th", F.explode(one).alias("w")).select("doc_id", "th", "w.*").where(F.size("hs") > 0).distinct()


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (hs, item) within RADIUS, for distinct windows ``(size, hs, fp)``."""
    # thousands of rows an item: shuffled, whatever Spark estimates their size to be
    probe = items.select("item", "size", F.col("fp").alias("ifp"), F.posexplode("fp").alias("b", "v")).withColumn(
        "v", F.explode(F.transform(F.array(*[F.lit(m) for m in _MASKS]), lambda m: F.col("v").bitwiseXOR(m))))
    look = windows.select("size", "hs", "fp", F.posexplode("fp").alias("b", "v"))
    apart = F.aggregate(F.zip_with("fp", "ifp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return look.join(probe.hint("merge"), ["size", "b", "v"]).where(apart <= RADIUS).select("hs", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, item_id, start: first word of the best window, n_windows, similarity)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), normal_words(F.col(text_col)).alias("ws"))
    items = items_of(benchmark, item_col, item_text)
    found = written(proposed(d, items), "proposed")
    windows = written(windows_of(d, found), "windows")
    # copies of a passage are one distinct window
    distinct = windows.select("size", "hs").distinct().withColumn("fp", fingerprint("hs"))
    pairs = candidates(distinct, items).join(items.select("item", "item_id", F.col("hs").alias("ihs")), "item")
    both = weighted_overlap("hs", "ihs")
    pairs = pairs.withColumn("both", both).withColumn("whole", F.size("hs") + F.size("ihs") - F.col("both")).where(
        F.col("both") * 100 >= F.col("whole") * percent).select("hs", "item", "item_id", (F.col("both") / F.col("whole")).alias("similarity"))
    hits = windows.join(pairs, "hs")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    return hits.groupBy("doc_id", "th", "item", "item_id").agg(best, F.count("*").alias("n_windows")).select(
        "doc_id", "th", "item_id", (-F.col("best.before")).cast("long").alias("start"), "n_windows", F.col("best.similarity").alias("similarity"))


def oracle() -> str:
    """DuckDB SQL of the query's rows: exact similarity of every aligned window, without fingerprints."""
    ws = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    sh = "unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))"
    return rf"""
WITH d0 AS (SELECT doc_id, {ws} AS ws FROM documents), i0 AS (SELECT item_id, {ws} AS ws FROM benchmark),
d AS (SELECT doc_id, unnest(range(0, len(ws) - 4)) AS pos, {sh} AS s FROM d0 WHERE len(ws) >= 5),
i AS (SELECT item_id, len(ws) AS size, unnest(range(0, len(ws) - 4)) AS place, {sh} AS s FROM i0 WHERE len(ws) >= 5),
w AS (SELECT DISTINCT doc_id, pos - place AS start, size FROM d JOIN i USING (s)),
x AS (SELECT w.doc_id, w.start, w.size, d.s, count(*) AS n FROM w JOIN d ON d.doc_id = w.doc_id AND d.pos >= w.start
  AND d.pos <= w.start + w.size - 5 GROUP BY ALL),
xn AS (SELECT doc_id, start, size, sum(n) AS n FROM x GROUP BY ALL),
y AS (SELECT item_id, size, s, count(*) AS n FROM i GROUP BY ALL), yn AS (SELECT item_id, sum(n) AS n FROM y GROUP BY ALL),
o AS (SELECT x.doc_id, x.start, x.size, y.item_id, sum(least(x.n, y.n)) AS b FROM x JOIN y ON x.s = y.s AND x.size = y.size GROUP BY ALL),
v AS (SELECT o.doc_id, o.item_id, o.start, b, xn.n + yn.n - b AS u FROM o JOIN xn USING (doc_id, start, size) JOIN yn USING (item_id)
  WHERE b * 100 >= (xn.n + yn.n - b) * {PERCENT})
SELECT doc_id, item_id, CAST(arg_min(start, start) FILTER (WHERE sim = top) AS BIGINT) AS start, count(*) AS n_windows,
  max(sim) AS similarity FROM (SELECT *, CAST(b AS DOUBLE) / u AS sim, max(CAST(b AS DOUBLE) / u) OVER (PARTITION BY doc_id, item_id) AS top FROM v)
GROUP BY doc_id, item_id"""
