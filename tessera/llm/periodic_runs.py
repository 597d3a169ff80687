"""Periodic runs of words: maximal stretches that repeat a stretch of ``q`` words.

A run has a smallest period q (words q apart are identical), at least ``MIN_LENGTH`` words and
two periods, and no neighbouring word extends it. All runs are found by a dictionary of basic
factors, in O(n log n) for n words:

1. For every power of two L, a factor of L words gets a name from the pair of names of its
   halves; factors that occur once need no name, and nor does what holds them.
2. Occurrences of one factor at most L / 2 apart form an arithmetic progression, whose step
   is the factor's period. A run of period q, L <= q < 2 L, starts with a factor that stands
   again q words on, in a later progression. Either the word after the first progression's
   stretch is within the run's first copy, and the last terms of both progressions are q
   apart; or the run's first period is itself periodic, and the second progression begins just
   q words after the run does. So the distances from any term to the first terms of the next
   progressions, and from last terms to last terms, propose every period; at most three later
   progressions begin within 2 L words.
3. Proposals are extended to both sides by the dictionary (powers of two, the largest first).
   Multiples of a run's period give the same stretch, of which the smallest period stays.

Documents are worked on together, some ``SLICE_WORDS`` words at a time; names are made for each
document, and a word of its own stands between two, so no run crosses.

Defined results: null, empty and blank texts have no word and no run; ids may repeat or be
null and rows may repeat, each row is worked on for itself; only the id and text columns are
read, whatever other columns are called; a text longer than a slice is worked on alone, whole;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_table

MIN_LENGTH = 12
SLICE_WORDS = 1 << 16
#: later progressions that can begin within twice a factor's length
AHEAD = 3

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of all n positions, positions whose key repeats, by key and position, their names).
    A position whose key occurs once, or has none, gets a negative name of its own."""
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], pos[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] = same
    again[:-1] |= same
    p, new = p[again], np.append(True, ~same)[again]
    name = np.cumsum(new) - 1
    names = -1 - np.arange(n)
    names[p] = name
    return names.astype(np.int32 if n < 1 << 31 else np.int64), p, name


def _proposed(pos: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs with period in [size, 2 * size), from the occurrences by name."""
    if len(pos) < 2:
        return pos[:0], pos[:0]
    new = np.append(True, (name[1:] != name[:-1]) | (2 * (pos[1:] - pos[:-1]) > size))
    of = np.cumsum(new) - 1  # the progression of each occurrence
    begin = np.flatnonzero(new)
    first, last, group = pos[begin], pos[np.append(begin[1:], len(pos)) - 1], name[begin]
    at, period = [], []
    for ahead in range(1, AHEAD + 1):
        if len(first) <= ahead:
            break
        later = np.minimum(of + ahead, len(first) - 1)
        for place, to, ok in ((pos, first[later], (of + ahead < len(first)) & (group[later] == name)),
                              (last[:-ahead], last[ahead:], group[ahead:] == group[:-ahead])):
            d = to - place
            ok = ok & (d >= size) & (d < 2 * size)
            at.append(place[ok])
            period.append(d[ok])
    return (np.concatenate(at), np.concatenate(period)) if at else (pos[:0], pos[:0])


def runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of a sequence of integers, by start, then period."""
    n = len(words)
    levels, at, period = [], [], []
    names, pos, name = _named(words, np.arange(n), n)
    size = 1
    while len(pos):
        levels.append(names)
        a, q = _proposed(pos, name, size)
        at.append(a)
        period.append(q)
        if 2 * size > n:
            break
        pos = np.sort(pos[pos + size < n])
        left, right = names[pos].astype(np.int64), names[np.minimum(pos + size, n - 1)].astype(np.int64)
        ok = right >= 0
        names, pos, name = _named(left[ok] * (n + 1) + right[ok], pos[ok], n)
        size *= 2
    if not at or not sum(map(len, at)):
        return np.zeros((0, 3), np.int64)
    at, period = np.concatenate(at), np.concatenate(period)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # neighbouring places with one period lie in one run
    alone = np.append(True, (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 1))
    at, period = at[alone], period[alone]
    right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i = at + right
        fits = i + period + (1 << k) <= n
        i = np.where(fits, i, 0)
        right += (fits & (levels[k][i] == levels[k][np.where(fits, i + period, 0)])) << k
        i = at - left - (1 << k)
        fits = i >= 0
        i = np.where(fits, i, 0)
        left += (fits & (levels[k][i] == levels[k][np.where(fits, i + period, 0)])) << k
    start, length = at - left, left + period + right
    ok = length >= np.maximum(min_length, 2 * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    out = np.stack([start, length, period], 1)[smallest]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _of_documents(parts: list[list[bytes]], min_length: int) -> list[np.ndarray]:
    """The runs of each document's words."""
    number = defaultdict(count().__next__)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1  # one place after each document
    keys = np.empty(int((size + 1).sum()), np.int64)
    for d, (p, b) in enumerate(zip(parts, begin, strict=True)):
        keys[b:b + len(p)] = np.fromiter(map(number.__getitem__, p), np.int64, len(p))
    doc = np.repeat(np.arange(len(parts)), size + 1)
    keys = keys + doc * (len(number) + 1)
    ends = begin + size
    keys[ends] = -1 - np.arange(len(parts))
    found = runs(keys, min_length)
    cut = np.searchsorted(found[:, 0], np.append(begin, len(keys)))
    return [found[i:j] - (b, 0, 0) for i, j, b in zip(cut[:-1], cut[1:], begin, strict=True)]


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """Words without those that a run contains after its first period."""
    if len(found):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, rewrite: Callable[[str | None, list], list] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, text), one row per input row: the runs by start and period, and
    the words that are left when every run keeps its first period, joined by one space.
    ``rewrite(id as text, words)`` may replace the words of a document first."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"),
                    F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def one(ids: list[pa.Scalar], parts: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
        found = _of_documents(parts, min_length)
        flat = np.concatenate(found)
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
        texts = pa.array([_collapsed(p, f) for p, f in zip(parts, found, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([i.as_py() for i in ids], id_type), pa.array([len(p) for p in parts], pa.int64()), lists, texts],
            names=["doc_id", "n_words", "runs", "text"])

    def work(batches):
        worker_table("none", dict)  # frees another operator's table
        for batch in batches:
            ids, parts, n = [], [], 0
            for doc_id, key, text in zip(*batch.columns, strict=True):
                words = text.as_py().split()  # bytes: the six ASCII white-space characters
                if rewrite is not None:
                    words = rewrite(key.as_py(), words)
                ids.append(doc_id)
                parts.append(words)
                n += len(words)
                if n >= SLICE_WORDS:
                    yield one(ids, parts, batch.schema.field(0).type)
                    ids, parts, n = [], [], 0
            if ids:
                yield one(ids, parts, batch.schema.field(0).type)

    out = d.mapInArrow(work, f"doc_id {kind}, n_words long, runs {RUNS}, text binary")
    return out.withColumn("text", F.col("text").cast("string"))
