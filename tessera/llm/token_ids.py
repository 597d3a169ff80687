"""Token ids of whole documents, written Simple-8b coded in ascending id order.

Format: a Parquet folder of chunk rows. A chunk holds whole documents, as many as reach
``CHUNK_IDS`` ids (or one longer document): shard and seq (its place in the order), first
(ids of the shard before it), n_ids, doc_ids and doc_lens (its documents in order),
block_offsets and payload (Simple-8b words, little-endian; see ``simple8b``). Blocks of
1024 ids can be found by their offsets and decoded alone. Shards are ranges of
(id, text hash), so one repeated id can fill several shards.

Words are encoded by the tokenizers library; the tokenizer's pre-tokens never span ASCII
white space, so a document's ids are its words' ids in order, and each worker keeps the
ids of words it has met (a bounded table). Texts that contain "<|", in which the
library looks for special tokens, are encoded whole.

Defined results: a null, empty or blank text has the end id alone; a null id sorts first;
equal ids are ordered by text hash (equal texts are exchangeable); only the id and text
columns are read; an empty table writes no chunk and reads back as no document; very long
texts make a chunk of their own.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import scratch, worker_table

END_ID = 2
CHUNK_IDS = 1 << 18
#: words a worker keeps the ids of; its table is emptied above that
CACHE_WORDS = 1_000_000
#: runs of marks kept likewise
MARKS = 10_000
#: bytes of text encoded at a time
BATCH_BYTES = 1 << 22

CHUNKS = ("shard int, seq int, first long, n_ids long, doc_ids array<long>, doc_lens array<int>, "
          "block_offsets array<int>, payload binary")


class WordIds(dict):
    """By word its row of the arrays ``start`` and ``size``, which point into ``flat``."""

    #: plain words: one pre-token each, so that many can be encoded in one call
    PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
    #: letters and a run of ASCII marks without the apostrophe: two pre-tokens
    MARKED = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]+)").fullmatch

    def __init__(self, tokenizer, most: int = CACHE_WORDS):
        self.tokenizer, self.most = tokenizer, most
        # a pre-token's last piece ends with the word-end mark
        self.ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.reset()

    def reset(self):
        self.clear()
        self.marks: dict[str, array] = {}
        self.flat, self.start, self.size, self.new = array("I"), array("I"), array("I"), []

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        """A row whose ids follow when ``learn`` is called."""
        row = self[word] = len(self.start)
        self.start.append(0)
        self.size.append(0)
        self.new.append(word)
        return row

    def fill(self, row: int, ids) -> None:
        self.start[row], self.size[row] = len(self.flat), len(ids)
        self.flat.extend(ids)

    def learn(self) -> None:
        """Encode the new words."""
        plain, marked, other = [], [], []
        for word in self.new:  # grows by stems
            text = word.decode()
            if self.PLAIN(text):
                plain.append(text)
            elif two := self.MARKED(text):
                marked.append((self[word], self[two[1].encode()], two[2]))
            else:
                other.append(text)
        for i in range(0, len(plain), 4096):
            part = plain[i:i + 4096]
            ids = np.array(self.encode(" ".join(part)), np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):  # not one pre-token each after all
                other += part
                continue
            rows = np.array([self[w.encode()] for w in part])
            begin = np.append(0, last[:-1] + 1)
            np.frombuffer(self.start, np.uint32)[rows] = begin + len(self.flat)
            np.frombuffer(self.size, np.uint32)[rows] = last + 1 - begin
            self.flat.frombytes(ids.tobytes())
        for text in other:
            self.fill(self[text.encode()], self.encode(text))
        flat, start, size = self.flat, self.start, self.size
        for row, stem, mark in marked:
            self.fill(row, flat[start[stem]:start[stem] + size[stem]] + self.mark(mark))
        self.new = []

    def mark(self, text: str) -> array:
        """Ids of a run of marks."""
        ids = self.marks.get(text)
        if ids is None:
            ids = array("I", self.encode(text))
            if len(self.marks) < MARKS:
                self.marks[text] = ids
        return ids

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text), without end ids."""
        if len(self) > self.most:
            self.reset()
        rows, n_words = array("I"), []
        for text in texts:
            if b"<|" in text:
                self.start.append(0)
                self.size.append(0)
                self.fill(len(self.start) - 1, self.encode(text.decode()))
                rows.append(len(self.start) - 1)
                n_words.append(1)
            else:
                words = text.lower().split()  # bytes: A-Z only, which the tokenizer lowers too
                rows.extend(map(self.__getitem__, words))
                n_words.append(len(words))
        self.learn()
        row = np.frombuffer(rows, np.uint32) if rows else np.zeros(0, np.uint32)
        size = np.frombuffer(self.size, np.uint32)[row].astype(np.int64) if rows else np.zeros(0, np.int64)
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begin = np.frombuffer(self.start, np.uint32)[row].astype(np.int64)
        upto = np.cumsum(size)
        out = np.frombuffer(self.flat, np.uint32)[np.arange(total) + np.repeat(begin - upto + size, size)]
        ends = np.append(0, upto)[np.cumsum(n_words)]
        return out, np.diff(np.append(0, ends))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """``end_id`` put after every document."""
    out = np.empty(len(ids) + len(sizes), np.uint32)
    last = np.cumsum(sizes + 1) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[last], out[keep] = end_id, ids
    return out


def by_bytes(batch: pa.RecordBatch):
    """(ids, texts) in slices of about BATCH_BYTES, whole documents."""
    ids, texts, n = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or b"")
        n += len(texts[-1])
        if n >= BATCH_BYTES:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _load(path: str, most: int = CACHE_WORDS) -> WordIds:
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), most)


def _chunk(shard, seq, first, ids, doc_ids, doc_lens) -> pa.RecordBatch:
    words, offsets = simple8b.encode(ids)
    cells = ([shard], [seq], [first], [len(ids)], [doc_ids], [doc_lens], [offsets], [words.astype("<u8").tobytes()])
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                    id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> str:
    """Encode and write; one shuffle, of the texts by ranges of the id. A worker keeps the ids of
    ``cache_words`` words at most, some 200 bytes each."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encode(batches):
        words, shard = worker_table((tokenizer, cache_words), lambda: _load(tokenizer, cache_words)), TaskContext.get().partitionId()
        seq, first, held, doc_ids, doc_lens, n_held = 0, 0, [], [], [], 0
        for batch in batches:
            for ids, texts in by_bytes(batch):
                got, sizes = words.documents(texts)
                held.append(with_end(got, sizes, end_id))
                doc_ids += ids
                doc_lens += (sizes + 1).tolist()
                n_held += len(held[-1])
                if n_held >= CHUNK_IDS:
                    yield _chunk(shard, seq, first, np.concatenate(held), doc_ids, doc_lens)
                    seq, first, held, doc_ids, doc_lens, n_held = seq + 1, first + n_held, [], [], [], 0
        if doc_ids:
            yield _chunk(shard, seq, first, np.concatenate(held), doc_ids, doc_lens)

    d.mapInArrow(encode, CHUNKS).write.parquet(path)
    return path


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows with ``start``, the ids of all documents before each chunk: ids per
    shard are summed over one row per shard."""
    c = spark.read.schema(CHUNKS).parquet(path)
    shards = c.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return c.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first"))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["payload"], "<u8"), row["block_offsets"], row["n_ids"])
                ids = ids.astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                starts = ends - row["doc_lens"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()),
                     pa.array(row["doc_lens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = chunks(spark, path).select("start", "n_ids", "doc_ids", "doc_lens", "block_offsets", "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None, **cols) -> DataFrame:
    """Write to ``path`` (or a new folder beside the checkpoints) and read back."""
    spark = docs.sparkSession
    return read_token_ids(spark, write_token_ids(docs, path or scratch(spark, "token-ids"), tokenizer, **cols))
