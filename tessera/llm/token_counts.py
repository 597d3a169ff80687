"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node has a failure link and the number of pieces
that greedy longest matching pops on the way along it, so a word's token count needs one
step per byte plus one per link, and no piece is ever built. Words are ASCII-white-space
separated and matched with a leading space (the vocabulary marks word starts so); a word
that the vocabulary cannot spell counts as one unknown token.

The automaton is as large as the vocabulary, never as the data, and is broadcast once.

Defined results: null, empty and blank texts have 0 words and 0 tokens; repeated rows and
repeated ids give one row each; only the id and text columns are read; an empty table
gives an empty table; a text of one very long word takes time linear in it.
"""

from __future__ import annotations

import json
import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_table

#: entries of a worker's table of word lengths, and the longest word kept in it
CACHE_WORDS, CACHE_BYTES = 500_000, 48


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes. Printable bytes stand for
    themselves there, the others for the code points from 256 on, in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return [bytes(byte_of[c] for c in piece) for piece in model["vocab"] if all(c in byte_of for c in piece)]


class Automaton:
    """Trie with failure links; ``step`` maps node * 256 + byte to the child node."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                key = node << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(ends)
                    ends.append(False)
                node = nxt
            ends[node] = ends[node] or bool(piece)
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, child in step.items():
            children[key >> 8].append((key & 255, child))
        #: -1: no way on, the word is unknown
        fail, popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in children[node]:
                if ends[child]:
                    fail[child], popped[child] = 0, 1
                else:
                    at, n = fail[node], popped[node]
                    while at >= 0 and (at << 8 | b) not in step:
                        n += popped[at]
                        at = fail[at]
                    if at >= 0:
                        fail[child], popped[child] = step[at << 8 | b], n
                queue.append(child)
        self.step, self.fail, self.popped = step, fail, popped
        self.name = uuid.uuid4().hex

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest matching; 1 if some part cannot be matched."""
        step, fail, popped, node, n = self.step.get, self.fail, self.popped, 0, 0
        for b in word:
            nxt = step(node << 8 | b)
            while nxt is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
                nxt = step(node << 8 | b)
            node = nxt
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


class WordLengths(dict):
    """Token counts by word, counted on first use; emptied when full."""

    def of(self, automaton: Automaton, words: list[bytes]) -> int:
        """Sum over the words of a text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        total, get = 0, self.get
        for word in words:
            n = get(word)
            if n is None:
                n = automaton.count(b" " + word)
                if len(word) <= CACHE_BYTES:
                    self[word] = n
            total += n
        return total


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def count(batches):
        automaton = shared.value
        lengths = worker_table(automaton.name, WordLengths)
        for batch in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for text in batch.column(1):
                text = text.as_py() or b""
                words = text.split()
                n_bytes.append(len(text))
                n_words.append(len(words))
                n_tokens.append(lengths.of(automaton, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))],
                                             names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")
