"""Mixing sources to target weights by a low-discrepancy schedule.

1. ``source_targets``: words per source, weights dealt 3, 1, 2, ... over the sources by
   code point (null last), targets capped at ``max_passes`` times the source's words and
   the excess reshared by weight (the level at which nothing is above its cap).
2. ``slots``: slot i of the mix gets the point i * a mod m (a / m is the golden ratio's
   reciprocal), the point falls in one source's stretch of the cumulative targets, and
   slots are numbered per source. Points meet stretches by an equi-join on cells of the
   unit interval, so neither side is broadcast or crossed.
3. ``stream``: each source's documents in the order of a keyed hash, with running word
   positions. Positions are summed in (source, hash bucket) groups, so that a hot source
   is spread over ``BUCKETS`` groups.
4. ``pieces``: streams cut into blocks of equal words; the k-th slot of a source takes
   its k-th block, running through the source's stream ``max_passes`` times at most.

Defined results: null and blank texts have 0 words and are never taken; a null source is
a source of its own, last in order; repeated rows are separate documents that share the
hash order (equal rows are exchangeable); a table without words has targets of 0. Rows
are told apart by (source, bucket, position), so ids may repeat or be null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, text_or_empty, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_PASSES = 2
#: modulus of the point sequence (a prime) and its golden-ratio multiplier
POINTS, STEP = 2147483647, 1327217885
CELLS = 4096
BUCKETS = 4096
SLOT_CHUNK = 65536
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_CLASS + "+")).cast("long")


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str = SEED) -> DataFrame:
    """Written table (doc_id, th: text hash, source, size, h): one small row per document."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"), h.alias("h")), "mix-sizes")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: src (0, 1, ...), source, source_size, weight, target, lo, hi (its
    stretch of the points). Windows here run over one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("src") % len(weights) + 1)
    s = by_source.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * max_passes)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn(
        "total", F.sum("source_size").over(every) * (share_percent / 100))
    fill = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / F.sum("weight").over(rest))
    # the first source, by ratio, that stays under its cap sets the level of all such sources
    s = s.withColumn("lam", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("lam") * F.col("weight"), F.col("cap").cast("double"))))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("all_targets", F.sum("target").over(every))
    s = s.withColumn("hi", F.when(F.col("all_targets") > 0, F.floor(
        F.sum("target").over(upto) / F.col("all_targets") * POINTS)).otherwise(F.lit(0)))
    last = F.col("src") == F.max("src").over(every)
    s = s.withColumn("hi", F.when(last & (F.col("all_targets") > 0), F.lit(POINTS)).otherwise(F.col("hi")).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0)).cast("long"))
    return s.select("src", "source", "source_size", "weight", "target", "lo", "hi")


def block_words(total_target: float) -> int:
    """Words per block: a hundred-thousandth of the mix, 8 at least and 4096 at most."""
    return int(min(4096, max(8, total_target // 100_000)))


def slots(targets: DataFrame, n_slots: int) -> DataFrame:
    """(slot, src, block): the low-discrepancy schedule with slots numbered per source."""
    spark = targets.sparkSession
    cell = lambda x: F.expr(f"({x}) * {CELLS} div {POINTS}")
    stretches = targets.where("hi > lo").select("src", "lo", "hi", F.explode(
        F.sequence(cell("lo"), cell("hi - 1"))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(
        f"pmod(pmod(id, {POINTS}) * {STEP}, {POINTS})").alias("point"))
    points = points.withColumn("cell", cell("point"))
    dealt = points.join(stretches, "cell").where("point >= lo AND point < hi").select(
        "slot", "src", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    before = dealt.groupBy("src", "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")))
    return ranked.join(before, ["src", "chunk"]).select("slot", "src", (F.col("before") + F.col("rn") - 1).alias("block"))


def stream(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents in their source's shuffled order: adds src, bucket, rn, start (first word)."""
    t = targets.select("src", F.col("source").alias("t_source"), "source_size", "target")
    d = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).drop("t_source")
    d = d.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "th")
    d = d.withColumn("rn", F.row_number().over(w)).withColumn("start", F.coalesce(
        F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(sums, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset", "h")


def pieces(streamed: DataFrame, schedule: DataFrame, block: int, max_passes: int = MAX_PASSES) -> DataFrame:
    """Every document per pass, with the words of it that scheduled blocks take:
    (src, bucket, rn, doc_id, source, size, source_size, target, pass, slot, from_word, n_words).
    A document keeps one row without a slot per block that the schedule does not reach."""
    p = streamed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    p = p.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    p = p.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(
        F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).otherwise(F.array(F.lit(-1).cast("long")))))
    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    p = p.withColumn("from_word", first - F.col("at")).withColumn("len", last - first)
    p = p.join(schedule, ["src", "block"], "left")
    return p.withColumn("n_words", F.when(F.col("slot").isNotNull(), F.col("len")).otherwise(F.lit(0)).cast("long")).drop(
        "len", "at", "start", "block")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_passes: int = MAX_PASSES,
        block: int | None = None) -> DataFrame:
    """The pieces of the mix (see ``pieces``). One scalar, the sum of targets, reaches the driver."""
    sizes = sized(docs, id_col, source_col, text_col)
    targets = source_targets(sizes, weights, share_percent, max_passes)
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block = block or block_words(total)
    return pieces(stream(sizes, targets), slots(targets, math.ceil(total / block)), block, max_passes)


def taken(mixed: DataFrame, by_pass: bool = False) -> DataFrame:
    """Words taken per document (and pass)."""
    keys = ["src", "bucket", "rn", "doc_id", "th", "source", "size", "source_size", "target"] + (["pass"] if by_pass else [])
    return mixed.groupBy(*keys).agg(F.sum("n_words").alias("taken"))


def copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: a row of ``docs`` for every pass that takes half of its words
    or more (documents are whole: only a source's last one can be cut by the schedule)."""
    wanted = taken(mixed, by_pass=True).where((F.col("size") > 0) & (F.col("taken") * 2 >= F.col("size")))
    wanted = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").cast("int").alias("_n"))
    own = docs.withColumn("_own", F.xxhash64(F.col(text_col)))
    # equal rows are one here: their copies are counted together
    own = own.dropDuplicates([id_col, "_own"]).join(wanted, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")))
    return own.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL of the query's rows."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][src % 3 + 1] AS weight, source_size * 2 AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ()) * 1.5 AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
lam AS (SELECT lvl FROM s3 WHERE lvl <= ratio ORDER BY ratio, src LIMIT 1),
s4 AS (SELECT src, source, source_size, least(CAST(cap AS DOUBLE), CAST((SELECT lvl FROM lam) AS DOUBLE) * weight) AS target FROM s3),
b AS (SELECT sum(target) AS total, CAST(least(4096, greatest(8, floor(sum(target) / 100000))) AS BIGINT) AS block FROM s4),
s5 AS (SELECT *, CASE WHEN src = (SELECT max(src) FROM s4) THEN {POINTS} ELSE CAST(floor(sum(target) OVER (ORDER BY src)
  / (SELECT total FROM b) * {POINTS}) AS BIGINT) END AS hi FROM s4),
s6 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM s5),
pts AS (SELECT (i * {STEP}) % {POINTS} AS point FROM range((SELECT CAST(ceil(total / block) AS BIGINT) FROM b)) r(i)),
k AS (SELECT src, count(*) AS n FROM pts JOIN s6 ON point >= lo AND point < hi GROUP BY src),
st AS (SELECT d.doc_id, size, s6.src, source_size, target, sum(size) OVER (PARTITION BY s6.src ORDER BY h, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
e AS (SELECT st.*, coalesce(k.n, 0) * (SELECT block FROM b) AS upto FROM st LEFT JOIN k USING (src))
SELECT doc_id, size, source_size, target, CAST(least(size, greatest(0, upto - start))
  + least(size, greatest(0, upto - source_size - start)) AS BIGINT) AS taken FROM e"""
