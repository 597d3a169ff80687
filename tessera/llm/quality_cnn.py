"""Quality score of a text by a byte-level convolutional network in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes run over every byte of the document, in chunks
of ``CHUNK`` positions that overlap by a filter's width; each chunk keeps every filter's
largest output, and the mean and the largest of the chunk vectors, through one hidden
layer, give one probability. A filter's output is a sum of table entries per byte pair,
so scoring is three table look-ups per byte.

Training: ``TRAIN_ROWS`` labelled documents per label, the smallest by hash of the id among
the rows not held out, and of each ``TRAIN_CHUNKS`` chunks spread over the text: a sample
bounded by those parameters, cut in the tasks and fitted by Adam, seeded. Scoring reads
every chunk of every document in one map; the model is a few hundred kilobytes.

Defined results: null and empty texts are scored as one chunk of padding; a null id is
not held out; documents without labels are scored like the others; of several labels of
an id the largest counts; with no labels at all every score is 0.5; an empty table gives
an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_per_group, held_out

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 16, 16, 512
TRAIN_ROWS, TRAIN_CHUNKS = 1200, 8
EPOCHS, BATCH, RATE = 10, 48, 0.01
#: a document counts as good from this score on
GOOD = 0.3
#: bytes scored at a time
SLICE_BYTES = 1 << 19


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    w1: np.ndarray  # (2 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray  # (HIDDEN,)
    b2: np.ndarray  # (1,)
    pairs: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.w1, self.b1, self.w2, self.b2]

    def pair_tables(self) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): filter outputs by byte pair, made once per worker."""
        if self.pairs is None:
            self.pairs = np.stack([(self.table[j][:, None] + self.table[j + 1][None]).reshape(65536, FILTERS)
                                   for j in range(0, WIDTH, 2)]).astype(np.float32)
        return self.pairs

    def combine(self, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([mean, top], axis=1)
        h = np.tanh(x @ self.w1 + self.b1)
        return x, h, 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts."""
        parts, sizes, held, n = [], [], [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= SLICE_BYTES:
                parts.append(self._pooled(held, sizes))
                held, n = [], 0
        if held:
            parts.append(self._pooled(held, sizes))
        if not parts:
            return np.zeros(0)
        chunks, sizes = np.concatenate(parts), np.array(sizes)
        first = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(chunks, first, axis=0) / sizes[:, None]
        return self.combine(mean, np.maximum.reduceat(chunks, first, axis=0))[2]

    def _pooled(self, texts: list[bytes], sizes: list[int]) -> np.ndarray:
        """Chunk vectors of texts; appends each text's number of chunks."""
        pad = bytes(WIDTH + 1)
        out = []
        step = SLICE_BYTES // CHUNK * CHUNK
        data, starts, ends, n = [], [], [], 0
        for text in texts:
            count = max(1, -(-len(text) // CHUNK))
            sizes.append(count)
            for i in range(0, max(len(text), 1), step):  # a very long text in several slices
                part = text[i:i + step + WIDTH - 1]
                own = min(len(text) - i, step) if text else 1
                starts += range(n, n + own, CHUNK)
                data.append(part + pad[:own + WIDTH - len(part)])
                ends.append(n + own)
                n += own + WIDTH
                if n >= SLICE_BYTES:
                    out.append(self._convolve(b"".join(data), starts, ends))
                    data, starts, ends, n = [], [], [], 0
        if data:
            out.append(self._convolve(b"".join(data), starts, ends))
        return np.concatenate(out)

    def _convolve(self, data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
        """Largest outputs from each start on; the WIDTH bytes from each end on are padding."""
        b = np.frombuffer(data + bytes(WIDTH), np.uint8).astype(np.int64)
        pair = b[:-1] * 256 + b[1:]
        tables, n = self.pair_tables(), len(data)
        out = tables[0][pair[:n]]
        for j in range(1, WIDTH // 2):
            out += tables[j][pair[2 * j:2 * j + n]]
        out[np.array(ends)[:, None] + np.arange(WIDTH)] = -np.inf
        return np.maximum(np.maximum.reduceat(out, starts, axis=0) + self.shift, 0)


def spread_chunks(text: bytes) -> list[bytes]:
    """At most TRAIN_CHUNKS chunks, evenly over the text."""
    n = max(1, -(-len(text) // CHUNK))
    at = np.unique(np.linspace(0, n - 1, min(n, TRAIN_CHUNKS)).astype(int))
    return [text[i * CHUNK:(i + 1) * CHUNK + WIDTH - 1] for i in at]


def train(docs: list[list[bytes]], labels: list[int], seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS))
    table[:, 0] = 0
    net = Network(table, np.zeros(FILTERS), rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1))
    y = np.array(labels, float)
    weight = np.where(y > 0, 0.7 / max(y.mean(), 1e-9), 0.3 / max(1 - y.mean(), 1e-9))  # in total 7 : 3, to keep good texts
    sizes = np.array([len(d) for d in docs])
    first = np.cumsum(sizes) - sizes
    data = np.zeros((int(sizes.sum()), CHUNK + WIDTH - 1), np.uint8)
    real = np.ones(len(data), np.int64)
    for i, chunk in enumerate(c for d in docs for c in d):
        data[i, :len(chunk)] = np.frombuffer(chunk, np.uint8)
        real[i] = min(max(len(chunk), 1), CHUNK)
    m1, m2, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            size = sizes[own]
            rows = np.concatenate([np.arange(first[d], first[d] + sizes[d]) for d in own])
            begin = np.cumsum(size) - size
            x = data[rows].astype(np.int64)
            tables = net.table.astype(np.float32)
            out = tables[0][x[:, :CHUNK]]
            for j in range(1, WIDTH):
                out += tables[j][x[:, j:j + CHUNK]]
            out[np.arange(CHUNK)[None] >= real[rows][:, None]] = -np.inf
            where = out.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(out, where[:, None], axis=1)[:, 0] + net.shift, 0)
            mean = np.add.reduceat(pooled, begin, axis=0) / size[:, None]
            top = np.maximum.reduceat(pooled, begin, axis=0)
            feats, h, p = net.combine(mean, top)
            d_out = (p - y[own]) * weight[own] / len(own)
            d_h = d_out[:, None] * net.w2 * (1 - h * h)
            d_x = d_h @ net.w1.T
            of = np.repeat(np.arange(len(own)), size)
            ties = (pooled == top[of])
            d_top = ties * (d_x[:, FILTERS:] / np.maximum(np.add.reduceat(ties.astype(float), begin, axis=0), 1))[of]
            d_pool = (d_x[:, :FILTERS] / size[:, None])[of] + d_top
            d_pool *= pooled > 0
            g_table = np.zeros_like(net.table)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                byte = np.take_along_axis(x, where + j, axis=1)
                np.add.at(g_table[j], (byte, f), d_pool)
            g_table[:, 0] = 0
            grads = [g_table, d_pool.sum(axis=0), feats.T @ d_h, d_h.sum(axis=0), h.T @ d_out, np.array([d_out.sum()])]
            t += 1
            for q, g, a, b in zip(net.params(), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 5, held_fold: int = 0) -> Network | None:
    """Choose the sample among the labels, then fetch chunks of its texts."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col(id_col), folds, lambda r: r == held_fold))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = first_per_group(known, "y", ["h", "doc_id"], TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("h", "y", "text")

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [spread_chunks(t.as_py()) for t in batch.column(2)], pa.list_(pa.binary()))], names=["h", "y", "chunks"])

    got = rows.mapInArrow(cut, "h long, y int, chunks array<binary>").dropDuplicates(["h"]).collect()
    got = sorted(got, key=lambda r: r["h"])
    return train([[bytes(c) for c in r["chunks"]] for r in got], [r["y"] for r in got]) if got else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of whole texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            got = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array((got >= GOOD).astype(np.int32), pa.int32())],
                                             names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    out = score(docs, fit(docs, labels, folds=folds, held_fold=held_fold))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, lambda r: r == held_fold).alias("held_out"), "score", "predicted")
