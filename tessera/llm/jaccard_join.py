"""Jaccard join of n-gram sets by parity sketches.

Two sets of sizes m and n with 100 * intersection >= percent * union differ in at most
(m + n) * (100 - percent) / (100 + percent) shingles, and in at most D(n) = n * (100 - percent)
/ percent, whichever of the two n is.

1. Documents with the same set form one class (128 bits stand for a set).
2. A set's parity sketch flips one bit a shingle; two sketches differ in no more bits than
   the sets do in shingles. A long sketch is kept as one 64-bit number a block of bits (the
   XOR of its shingles' hashes, which tells the block's odd bits); a short one, a few bits a
   shingle, is kept whole.
3. Pigeonhole, by size band (sizes from 2**k to 2**(k + 1)): a differing shingle spoils one
   block, so if more than D(n) of a set's blocks are strong (hold two shingles or more), every
   partner shares one of those. A set emits its strong blocks under one division into blocks
   after another, up to the first in which it has more than D(n); of two linked sets the one
   that stops first meets the other there. Sets near a band's upper end take part in the next
   band, too. So every link is found, and none by blocks that say little.
4. Crowded blocks (of a passage that many documents share, say) are left out exactly: of s
   strong blocks partners share s - D(n), so each set may leave out the (s - D(n) - 1) / 2
   fullest of its last division, and one that both keep remains.
5. In each block one pivot, the set with most mates, is compared with the others: sizes, then the
   short sketches, then the full sets. Components follow from the confirmed links. The sets
   outside a block's largest component then meet another member of it, a different one in
   each block, as long as that takes many of them in.
6. Linked sets share a block and so a pivot. What is outside the largest component of a pivot's
   sets is compared with those of them that are in another component: sizes, distances from
   the pivot (the triangle inequality of sketches) and a sketch of ``WORDS`` words are looked at
   within the join, so that only pairs come out that these allow; then the short sketches and
   the full sets decide. A group of thousands of near copies so costs a few comparisons a
   set; only sets that stay outside are looked at with every other set of their pivot.

Defined results: null and wordless texts have an empty set, are linked with nothing and are
their own component; repeated rows share their class; a null id takes part, but a component's
id is its smallest non-null id (null if none); an empty table gives an empty table; only the id
and text columns are read, whatever else the table holds; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_table, written
from .near_dedup import class_sets, components, enough, mixed, overlaps, set_key, shingle_set

#: shingles a strong block holds at least
STRONG = 2
#: strong blocks are to be more than D(n) by this factor on average
SURPLUS = 1.15
#: 64-bit words of the sketch that joins look at
WORDS = 8
#: sets a task remembers to have emitted
REMEMBERED = 1 << 16
_SALT = 0x9E3779B97F4A7C15


def _salt(*x: int) -> np.uint64:
    out = 0
    for v in x:
        out = ((out ^ v) + 1) * _SALT & 0xFFFFFFFFFFFFFFFF
    return np.uint64(out)


def differing(n: int, percent: int) -> int:
    """D(n): shingles in which a set of n differs from a linked one at most."""
    return n * (100 - percent) // percent


def fullest(percent: int) -> float:
    """The most shingles a block may hold on average, such that a set has more than SURPLUS * D(n)
    strong blocks: their share follows from Poisson's law."""
    strong = lambda x: (1 - math.exp(-x) * (1 + x)) / x
    x = 1.8  # where strong blocks are most
    if strong(x) < SURPLUS * (100 - percent) / percent:
        raise ValueError("percent is too small for this method (about 78 at least)")
    while strong(x + 0.01) >= SURPLUS * (100 - percent) / percent:
        x += 0.01
    return x


def band_of(n: int) -> int:
    return n.bit_length() - 1


def blocks(items: np.ndarray, band: int, division: int, per_block: float) -> np.ndarray:
    """Keys of the strong blocks of a sorted set under a division of a band."""
    h = items if division == 0 else np.sort(mixed(items ^ _salt(7, division)))
    n_blocks = np.uint64(math.ceil((2 << band) / per_block))
    at = ((h >> np.uint64(32)) * n_blocks) >> np.uint64(32)  # ascending, as h is
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    strong = np.diff(np.append(first, len(h))) >= STRONG
    parity = np.bitwise_xor.reduceat(h, first)
    return mixed(mixed(parity ^ _salt(band, division)) + at[first])[strong]


def emitted(items: np.ndarray, percent: int, per_block: float) -> list[tuple[list[np.ndarray], int]]:
    """For the set's own band and, if a larger partner can be there, the next one: the keys of each
    division gone through, and how many of the last division's may be left out."""
    n = len(items)
    out: list[tuple[list[np.ndarray], int]] = []
    if 100 * n // percent == n and percent * n // 100 + (percent * n % 100 > 0) == n:
        return out  # too small to be linked with anything but an equal set
    for band in (band_of(n), band_of(n) + 1):
        if band > band_of(n) and 100 * n // percent < 1 << band:
            break
        keys: list[np.ndarray] = []
        while not keys or len(keys[-1]) <= differing(n, percent):
            keys.append(blocks(items, band, len(keys), per_block))
        out.append((keys, (len(keys[-1]) - differing(n, percent) - 1) // 2))
    return out


def parity_sketch(items: np.ndarray, bits: int | None = None) -> bytes:
    """``bits`` parities; by default two to four a shingle, a power of two of them (64 at least)."""
    bits = bits or max(64, 4 << band_of(len(items)))
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> tuple[int, int]:
    """(differing bits, bits compared): the longer sketch is folded to the shorter one's length,
    which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum()), 8 * len(x)


#: lanes of keys: the last division in a set's own band and in the next one, and all others
OWN, NEXT, OTHERS = range(3)
LANES = 3


def sketched(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Written table, one row a document: rid (its number), doc_id, th (text hash), n_shingles,
    key (of the set) and, for the first document of a set in a task, sketch, words, keys by lane and
    what may be left out of lanes 0 and 1."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    per_block = fullest(percent)

    def one(items: np.ndarray) -> tuple:
        lanes: list[list] = [[], [], []]
        spare = [0, 0]
        for lane, (keys, may_go) in enumerate(emitted(items, percent, per_block)):
            lanes[lane] = [keys[-1]]
            lanes[OTHERS] += keys[:-1]
            spare[lane] = may_go
        words = np.frombuffer(parity_sketch(items, 64 * WORDS), "<i8")
        return parity_sketch(items), words, *(np.concatenate(x).view(np.int64) if x else None for x in lanes), *spare

    def run(batches):
        worker_table("none", dict)  # frees another operator's table
        rid, seen = TaskContext.get().partitionId() << 36, set()
        for batch in batches:
            out = []
            for text in batch.column(2):
                items = shingle_set(text.as_py(), width)
                key = set_key(items) if len(items) else None
                new = key is not None and key not in seen
                if new:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                out.append((rid, len(items), key, *(one(items) if new else (None,) * 7)))
                rid += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 10
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "th", "rid", "n_shingles", "key", "sketch", "words", "keys0", "keys1", "keys2", "spare0", "spare1"])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4, pa.int32(), pa.int32()]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(
        run, f"doc_id {kind}, th long, rid long, n_shingles long, key binary, sketch binary, words array<long>, "
             "keys0 array<long>, keys1 array<long>, keys2 array<long>, spare0 int, spare1 int"), "parity")


def with_mates(m: DataFrame) -> DataFrame:
    """Rows of blocks that hold two or more, with their number. Counted where the rows meet: one
    shuffle, so keys stand on disk once."""
    return m.withColumn("mates", F.count("*").over(Window.partitionBy("block"))).where("mates > 1")


def shared_blocks(rows: DataFrame) -> DataFrame:
    """Written table (block, key, n, mates): the sets of every block that holds two or more,
    without the crowded blocks that a set may leave out."""
    lanes = [rows.select(F.explode(f"keys{i}").alias("block"), (F.col("rid") * 4 + i).alias("of")) for i in range(LANES)]
    spread = lanes[OWN].union(lanes[NEXT]).union(lanes[OTHERS])
    found = with_mates(spread).drop("mates")
    of = rows.where(F.col("sketch").isNotNull()).select("rid", "key", F.col("n_shingles").alias("n"), "spare0", "spare1")
    found = found.withColumn("rid", F.shiftright("of", 2)).withColumn("lane", F.col("of").bitwiseAND(3).cast("int")).join(of.hint("merge"), "rid")
    may_go = F.when(F.col("lane") == OWN, F.col("spare0")).when(F.col("lane") == NEXT, F.col("spare1")).otherwise(0)
    found = written(found.select("block", "key", "n", "lane", may_go.alias("may_go")).distinct(), "blocks")

    crowded = F.row_number().over(Window.partitionBy("key", "lane").orderBy(F.desc("mates"), "block"))
    kept = with_mates(found).withColumn("place", crowded).where("place > may_go").select("block", "key", "n")
    return written(with_mates(kept), "mates")


def sketches_of(rows: DataFrame, member: DataFrame) -> DataFrame:
    """Written table (key, sketch, words) of the sets in ``member``."""
    have = rows.where(F.col("sketch").isNotNull()).select("key", "sketch", "words")
    return written(have.join(member.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "short")


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, na, nb) with far (differing bits), bits (compared) and near (whether sizes and sketches
    allow a link)."""
    a, b = (sketches.select(F.col("key").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            d = [distance(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64())],
                                             names=["a", "b", "na", "nb", "far", "bits"])

    out = joined.mapInArrow(run, "a binary, b binary, na long, nb long, far long, bits long")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return out.withColumn("near", fits & ((100 + percent) * F.col("far") <= (100 - percent) * (F.col("na") + F.col("nb"))))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (a, b, na, nb), by the full sets."""
    return overlaps(pairs, sets).where(enough(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def placed(member: DataFrame, comp: DataFrame) -> DataFrame:
    """``member`` with comp and out: whether the set is outside its block's largest component."""
    m = member.join(comp.select("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    sizes = m.groupBy("block", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("block").agg(F.max(F.struct("size", "comp")).alias("m")).select("block", F.col("m.comp").alias("main"))
    return m.join(main, "block").withColumn("out", F.col("comp") != F.col("main")).drop("main")


def taken_in(m: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of the sets outside and, from each block, another member of its largest component."""
    other = m.where("not out").groupBy("block").agg(F.max(F.struct(F.xxhash64("block", "key", F.lit(turn)).alias("h"), "key", "n")).alias("o"))
    met = m.where("out").join(other, "block").select(F.col("key").alias("a"), F.col("o.key").alias("b"), F.col("n").alias("na"), F.col("o.n").alias("nb"))
    return met.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).distinct()


def outsiders(member: DataFrame, star: DataFrame, comp: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of sets with a common pivot in different components, a outside the largest one, that
    sizes, distances from the pivot and sketch words allow; one row a pair."""
    m = placed(member.select(F.col("p").alias("block"), "key", "n").distinct(), comp).withColumnRenamed("block", "p")
    m = m.where("key <> p").join(m.where("out").select("p").distinct(), "p", "left_semi")
    m = m.join(star.select(F.col("a").alias("key"), F.col("b").alias("p"), "far", "bits"), ["key", "p"]).join(words, "key")
    m = written(m.select("p", "key", "n", "comp", "out", "far", "bits", "words"), "outside")
    x = m.where("out").select("p", *(F.col(c).alias(f"{c}_x") for c in ("key", "n", "comp", "far", "bits", "words")))
    y = m.select("p", *(F.col(c).alias(f"{c}_y") for c in ("key", "n", "comp", "out", "far", "bits", "words")))
    size = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    apart = (F.col("comp_x") != F.col("comp_y")) & (~F.col("out_y") | (F.col("key_x") < F.col("key_y")))
    close = lambda d: (100 + percent) * d <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    gap = (F.col("bits_x") != F.col("bits_y")) | close(F.abs(F.col("far_x") - F.col("far_y")))
    differ = sum((F.bit_count(F.col("words_x")[i].bitwiseXOR(F.col("words_y")[i])) for i in range(1, WORDS)),
                 F.bit_count(F.col("words_x")[0].bitwiseXOR(F.col("words_y")[0])))
    return x.join(y.hint("merge"), "p").where(size & apart & gap & close(differ)).select(
        F.col("key_x").alias("a"), F.col("key_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb")).distinct()


def linked(docs: DataFrame, rows: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """(key, comp) of the sets that share a block; None without any."""
    member = shared_blocks(rows)
    wanted = member.groupBy("key").agg(F.sum("mates").alias("degree"))
    if wanted.isEmpty():
        return None
    ids = rows.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    sets = class_sets(docs, ids.join(wanted.select("key"), "key"), width, id_col, text_col)
    sketches = sketches_of(rows, member)
    words = sketches.select("key", "words")
    member = member.drop("mates").join(wanted, "key")
    pivots = member.groupBy("block").agg(F.max(F.struct("degree", "key", "n")).alias("p"))
    member = written(member.join(pivots, "block").select("block", "key", "n", F.col("p.key").alias("p"), F.col("p.n").alias("np")), "members")
    star = member.where("key <> p").select(F.col("key").alias("a"), F.col("p").alias("b"), F.col("n").alias("na"), F.col("np").alias("nb")).distinct()
    star = written(near(star, sketches, percent), "stars")
    links = written(verified(star.where("near").select("a", "b", "na", "nb"), sets, percent), "links")
    comp, turn, outside = components(links), 0, None
    while True:
        m = written(placed(member, comp), "placed")
        was, outside = outside, m.where("out").count()
        if not outside or (was is not None and 5 * outside > 4 * was):
            break
        found = near(taken_in(m, turn, percent), sketches, percent).where("near").select("a", "b", "na", "nb")
        links = written(links.union(verified(found, sets, percent)), "links")
        comp, turn = components(links), turn + 1
    rest = near(outsiders(member, star, comp, words, percent), sketches, percent).where("near").select("a", "b", "na", "nb")
    found = written(verified(rest, sets, percent), "links")
    return comp if found.isEmpty() else components(links.union(found))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id), one row per input row."""
    rows = sketched(docs, width, percent, id_col, text_col)
    comp = linked(docs, rows, width, percent, id_col, text_col)
    ids = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    if comp is not None:
        ids = ids.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        ids = ids.join(ids.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("key", "component_id")
    else:
        ids = ids.select("key", F.col("low").alias("component_id"))
    out = rows.select("doc_id", "th", "n_shingles", "key").join(ids, "key", "left")
    return out.select("doc_id", "th", "n_shingles",
                      F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
