"""Removal of repeated byte strings: every byte of a string of ``LENGTH`` bytes that starts
anywhere else too, in the same document or another.

The work of a suffix order is done blockwise with a difference cover. For any two
positions some shift below ``PERIOD`` puts both in the cover, so two equal strings of
LENGTH bytes contain, at one shift, two cover positions whose next
LENGTH - PERIOD + 1 = ``INNER`` bytes are equal.

1. Cover samples: the INNER bytes at every cover position are hashed and dealt into
   buckets, each sorted on its own: a position's class is "repeated" or not. (A class is
   told by the bucket and 32 bits; a false "repeated" only costs work in step 2.)
2. Suffixes: the positions whose next PERIOD positions hold a repeated sample are the only
   ones that can start a repeated string. Their LENGTH-byte prefixes, as 64-bit rolling
   hashes, are dealt into buckets and sorted one bucket at a time: neighbours that are
   equal are repeated.
3. Marked strings are cut out.

Equal documents are merged before anything is dealt (120 bits of MD5 stand for a text), and
each bucket returns, per document, which of its positions are repeated; so texts are
shuffled once and positions never leave the documents. A string that stands in many
documents goes to its bucket once a slice (the documents dealt together by a task): a
slice tells by itself what it has more than once. The number of buckets follows the
input's bytes. Two different strings are taken for equal with a chance of 2**-64 a pair.

Defined results: null and empty texts have 0 bytes and the hash of the empty string; a
text shorter than LENGTH is never touched; repeated rows of LENGTH bytes or more are
removed whole; ids may repeat or be null; only the id and text columns are read; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

LENGTH = 400


def difference_cover(r: int) -> tuple[int, list[int]]:
    """(period, 6r + 4 residues) such that every difference modulo the period occurs
    (the construction of Colbourn and Ling)."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *accumulate(gaps)]


PERIOD, COVER = difference_cover(2)
INNER = LENGTH - PERIOD + 1
#: bytes of input per bucket of cover samples and of suffixes
SAMPLE_BUCKET, SUFFIX_BUCKET = 32 << 20, 8 << 20
#: at least so many buckets
SAMPLE_BUCKETS, SUFFIX_BUCKETS = 16, 64
#: hashes that a task deals together, and that are sorted at a time: they, not the size of
#: a bucket or of a task's input, set what a worker holds beside the hashes themselves
SLICE_BYTES, SORTED = 1 << 20, 1 << 20
#: rows of an Arrow batch that are answered together
ROWS = 500

_ROOT = 0x9E3779B97F4A7C15
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(root: int, n: int) -> np.ndarray:
    """root ** 0 ... root ** (n - 1) modulo 2 ** 64, kept by the worker."""
    have = _POWERS.get(root, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(root, len(have), 1 << 64))])
    _POWERS[root] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Rolling hashes of the strings in a buffer."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * _powers(_ROOT, len(b)), out=self.sums[1:])
        self.back = _powers(pow(_ROOT, -1, 1 << 64), len(b) + 1)

    def at(self, pos: np.ndarray, n: int) -> np.ndarray:
        return _mix((self.sums[pos + n] - self.sums[pos]) * self.back[pos])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def samples(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cover positions, hashes, buckets) of a text."""
    n = len(text) - INNER + 1
    pos = np.flatnonzero(np.resize(_IN_COVER, max(n, 0)))
    h = Hashes(text).at(pos, INNER) if len(pos) else np.zeros(0, np.uint64)
    return pos, h, bucket_of(h, buckets)


def marked(pos: np.ndarray, bucket: np.ndarray, flags: list[dict] | None) -> np.ndarray:
    """Positions that buckets returned as repeated: in each bucket, numbers in text order."""
    out = [pos[bucket == f["bucket"]][np.frombuffer(f["places"], np.uint32)] for f in flags or ()]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def covered(starts: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Mask of n positions within [start - before, start + after)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts - before, 0, n), 1)
    np.add.at(edge, np.clip(starts + after, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def _twins(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that stand more than once, and of all but one of each of them.
    Some SORTED keys are sorted at a time."""
    twin, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    parts = len(key) // SORTED + 1
    part = (key % key.dtype.type(parts)).astype(np.uint32) if parts > 1 else None
    for i in range(parts):
        k = key if part is None else key[part == i]
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        del k
        if not same.any():
            continue
        if part is not None:
            order = np.flatnonzero(part == i)[order]
        twin[order[1:][same]] = later[order[1:][same]] = True
        twin[order[:-1][same]] = True
    return twin, later


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each run of so many."""
    return np.arange(counts.sum(), dtype=np.uint32) - np.repeat((np.cumsum(counts) - counts).astype(np.uint32), counts)


def _deal(keys, parts, dtype) -> Iterator[pa.RecordBatch]:
    """Rows by bucket of the different documents ``parts`` = [(hashes, buckets)]: each
    document's hashes in text order, as runs. A hash that stands here more than once is
    repeated: one of its places goes to its bucket, for the other slices, and a row of
    bucket -1 has all of them, as flags. So a bucket gets a hash once a slice at most,
    in however many documents it stands."""
    size = np.array([len(h) for h, _ in parts])
    if not size.sum():
        return
    h = np.concatenate([x.astype(dtype, copy=False) for x, _ in parts])
    b = np.concatenate([x for _, x in parts]).astype(np.int32, copy=False)
    order = np.argsort(b, kind="stable")
    h, b = h[order], b[order]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), size)[order]
    del order
    k1, k2 = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    start = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])))
    place = _places(np.diff(np.append(start, len(b))))
    # 64 bits of a hash tell its bucket; 32 bits of it do not
    twin, later = _twins(h if h.itemsize == 8 else b.astype(np.uint64) << np.uint64(32) | h)
    if twin.any():
        tb, td, tp = b[twin], doc[twin], place[twin]
        cut = np.flatnonzero(np.append(True, (tb[1:] != tb[:-1]) | (td[1:] != td[:-1])))
        own, n = td[cut], np.diff(np.append(cut, len(tb))).astype(np.int32)
        yield _dealt([(-1, keys[0][0], k1[own], k2[own], n, None, tp.tobytes(), tb[cut].astype(np.int32))])
        h, b, doc, place = h[~later], b[~later], doc[~later], place[~later]
    cut = np.append(True, (b[1:] != b[:-1]) | (doc[1:] != doc[:-1]))
    last = np.append(cut[1:], True)
    n = np.diff(np.append(np.flatnonzero(cut), len(b))).astype(np.int32)
    part = np.repeat(place[last] >= n, n)  # runs with gaps carry their places
    rows = []
    for gaps in (False, True):
        mh, mb, md, mp = (x[part == gaps] for x in (h, b, doc, place))
        if not len(mb):
            continue
        edge = np.flatnonzero(np.diff(mb, prepend=-1))
        for i, j in zip(edge, np.append(edge[1:], len(mb)), strict=True):
            first = np.flatnonzero(np.diff(md[i:j], prepend=-1))
            own = md[i:j][first]
            rows.append((int(mb[i]), 0, k1[own], k2[own], np.diff(np.append(first, j - i)).astype(np.int32), mh[i:j].tobytes(),
                         mp[i:j].tobytes() if gaps else None, None))
    yield _dealt(rows)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in DEALT.split(", ")])


DEALT = "bucket int, slice long, k1 array<long>, k2 array<long>, counts array<int>, hashes binary, places binary, buckets array<int>"
FLAGS = "k1 long, k2 long, bucket int, places binary"


def _flags(k1, k2, bucket, counts, places) -> pd.DataFrame:
    end = np.cumsum(counts)
    return pd.DataFrame({"k1": k1, "k2": k2, "bucket": np.asarray(bucket, np.int32),
                         "places": [places[i:j].tobytes() for i, j in zip(end - counts, end, strict=True)]})


def sort_bucket(pdf: pd.DataFrame, dtype) -> pd.DataFrame:
    """FLAGS of the rows of a bucket, or of what a slice has found by itself."""
    counts, k1, k2 = (np.concatenate(pdf[k].to_list()).astype(np.int64) for k in ("counts", "k1", "k2"))
    if pdf["bucket"].iloc[0] < 0:
        places = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["places"]])
        return _flags(k1, k2, np.concatenate(pdf["buckets"].to_list()), counts, places)
    place = _places(counts)
    end = np.cumsum([len(x) // np.dtype(dtype).itemsize for x in pdf["hashes"]])
    for x, j in zip(pdf["places"], end, strict=True):
        if x is not None:
            place[j - len(x) // 4:j] = np.frombuffer(x, np.uint32)
    twin, _ = _twins(np.concatenate([np.frombuffer(x, dtype) for x in pdf["hashes"]]))
    n = np.add.reduceat(twin, np.cumsum(counts) - counts, dtype=np.int64)
    own = n > 0
    return _flags(k1[own], k2[own], np.full(own.sum(), pdf["bucket"].iloc[0]), n[own], place[twin])


def repeated(dealt: DataFrame, dtype) -> DataFrame:
    """Sort each bucket: per document the places (numbers in its run) that are repeated.
    What a slice has found repeated by itself (bucket -1) passes by, a group a slice."""

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = sort_bucket(pdf, dtype)
        give_back()
        return flags

    flags = dealt.groupBy("bucket", "slice").applyInPandas(sort, FLAGS)
    return flags.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "places")).alias("flags"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("md5", F.md5("text"))
    half = lambda i: F.conv(F.substring("md5", i, 15), 16, 10).cast("long")
    return d.select("doc_id", half(1).alias("k1"), half(16).alias("k2"), "text")


def _by_slice(batches, one):
    """Deal the documents of Arrow batches (k1, k2, text, ...) in slices of SLICE_BYTES hashes."""
    keys, parts, n = [], [], 0
    for batch in batches:
        for row in _rows(batch):
            keys.append((row["k1"].as_py(), row["k2"].as_py()))
            parts.append(one(row))
            n += len(parts[-1][0])
            if n >= SLICE_BYTES:
                yield keys, parts
                keys, parts, n = [], [], 0
    if keys:
        yield keys, parts
    del keys, parts
    give_back()


def _rows(batch: pa.RecordBatch):
    names = batch.schema.names
    for cells in zip(*batch.columns, strict=True):
        yield dict(zip(names, cells, strict=True))


def _pieces(batches):
    """Arrow batches in pieces of ROWS rows, so that no answer holds a whole batch again."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)
    give_back()


def summary(text: bytes, gone: np.ndarray) -> tuple[int, int, int, str]:
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
    return len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


RESULT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 5 + (pa.string(),)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in RESULT.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    d = keyed(docs, id_col, text_col)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n1, n2 = max(SAMPLE_BUCKETS, total // SAMPLE_BUCKET), max(SUFFIX_BUCKETS, total // SUFFIX_BUCKET)

    def deal_samples(batches):
        def one(r):
            _, h, bucket = samples(r["text"].as_py(), n1)
            return h.astype(np.uint32), bucket

        for keys, parts in _by_slice(batches, one):
            yield from _deal(keys, parts, np.uint32)

    # copies are merged before anything is dealt; all columns go on, so that both uses share the shuffle
    texts = d.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    classes = repeated(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(deal_samples, DEALT), np.uint32)
    texts = texts.join(classes, ["k1", "k2"], "left")

    def candidates(text: bytes, flags) -> np.ndarray:
        """Positions that may start a repeated string."""
        n = len(text) - LENGTH + 1
        if n < 1 or not flags:
            return np.zeros(0, np.int64)
        pos, _, bucket = samples(text, n1)
        return np.flatnonzero(covered(marked(pos, bucket, flags), PERIOD - 1, 1, n))

    def first(batches):
        """Texts that go on to step 2 with their candidates' flags, and results of the others."""
        for batch in _pieces(batches):
            rows, open_rows = [], []
            for r in _rows(batch):
                text, copies, flags = r["text"].as_py(), r["copies"].as_py(), r["flags"].as_py()
                key = (r["k1"].as_py(), r["k2"].as_py())
                some = len(candidates(text, flags)) > 0
                gone = np.full(len(text), copies > 1 and len(text) >= LENGTH)
                # the copies of a text are gone whole, but its strings still count for others
                rows.append((*key, *(summary(text, gone) if gone.any() or not some else (None,) * 4)))
                open_rows.append((text, flags) if some else (None, None))
            base = _result(rows)
            yield pa.RecordBatch.from_arrays(
                [*base.columns, pa.array([x[0] for x in open_rows], pa.binary()),
                 pa.array([x[1] for x in open_rows], pa.list_(pa.struct([("bucket", pa.int32()), ("places", pa.binary())])))],
                names=[*base.schema.names, "text", "flags"])

    done = written(texts.mapInArrow(first, RESULT + ", text binary, flags array<struct<bucket:int,places:binary>>"), "repeats")
    open_texts = done.where(F.col("text").isNotNull())

    def suffixes(text: bytes, flags):
        pos = candidates(text, flags)
        h = Hashes(text).at(pos, LENGTH)
        return pos, h, bucket_of(h, n2)

    def deal_suffixes(batches):
        for keys, parts in _by_slice(batches, lambda r: suffixes(r["text"].as_py(), r["flags"].as_py())[1:]):
            yield from _deal(keys, parts, np.uint64)

    again = repeated(open_texts.select("k1", "k2", "text", "flags").mapInArrow(deal_suffixes, DEALT), np.uint64)
    cut = open_texts.where(F.col("n_bytes").isNull()).select("k1", "k2", "text", "flags").join(
        again.withColumnRenamed("flags", "found"), ["k1", "k2"], "left")

    def second(batches):
        for batch in _pieces(batches):
            rows = []
            for r in _rows(batch):
                text = r["text"].as_py()
                pos, _, bucket = suffixes(text, r["flags"].as_py())
                gone = covered(marked(pos, bucket, r["found"].as_py()), 0, LENGTH, len(text))
                rows.append((r["k1"].as_py(), r["k2"].as_py(), *summary(text, gone)))
            yield _result(rows)

    names = [x.split()[0] for x in RESULT.split(", ")]
    result = done.where(F.col("n_bytes").isNotNull()).select(*names).union(cut.mapInArrow(second, RESULT))
    return d.select("doc_id", "k1", "k2").join(result, ["k1", "k2"]).drop("k1", "k2")
