"""Language identification of (code-switched) text by a linear-chain conditional random field.

Every word gets a score per language from features of the word: byte n-grams of the
lower-cased word between boundary marks (those with a mark are its affixes) and its entry
in a lexicon of training words; learned transitions score neighbouring labels; forward-
backward gives each word's label probabilities. A document's language is the one with
the largest sum of them, its score that sum's share.

Training: ``TRAIN_DOCS`` labelled documents per language, the smallest by hash of the id
among the rows not held out (a bounded sample, as is what it takes of a very long text:
``TRAIN_WORDS`` words in whole sequences spread over it). Sequences for training are
spliced from pieces of documents of several languages, so that the transitions learn
switches; the fit is full-batch gradient ascent on the log-likelihood, seeded.

Prediction covers the whole text: all its words that have a letter, in chains of
``CHAIN`` words. It is one map over the documents; the model (a fixed hash space and the
sample's lexicon) is broadcast.

Defined results: a null text or one without a letter is ``und`` with score 0; a null id is
never held out; ties go to the first language in code-point order; repeated rows get the
same result each; without any labelled row every document is ``und``; only the id, text
and (for training) language columns are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_per_group, held_out, worker_table

UND = "und"
TRAIN_DOCS, TRAIN_WORDS = 250, 384
CHAIN = 64
HASH_BITS = 18
NGRAMS = (2, 3, 4, 5)
ROUNDS, RATE, DECAY = 40, 0.3, 1e-4
#: words a worker keeps scores of; its table is emptied above that
CACHE_WORDS = 200_000
BATCH_BYTES = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def core(word: str) -> bytes:
    """Lower-cased word without what is not a letter at its ends."""
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j].lower().encode()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of all words, first of each word, 64-bit word hashes)."""
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(text))  # bytes from here to the word's end
    grams, owner = [], []
    word_of = np.repeat(np.arange(len(words)), size)
    for n in NGRAMS:
        h = np.full(len(text), np.uint64(n), np.uint64)
        for k in range(n):
            h = (h ^ np.append(text[k:], np.zeros(k, np.uint64))) * _MIX
            h ^= h >> np.uint64(29)
        ok = left >= n
        grams.append((h[ok] >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        owner.append(word_of[ok])
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    place = (np.arange(len(text)) - np.repeat(end - size, size)).astype(np.uint64)
    mixed = (text + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed * (place + _MIX), end - size)
    return grams[order], np.searchsorted(owner[order], np.arange(len(words))), whole


def forward_backward(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, transition sums) of chains: emit (n, T, K), mask (n, T) with
    each chain's words first."""
    n, length, k = emit.shape
    psi = np.exp(emit - emit.max(axis=2, keepdims=True))
    step = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * psi[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (psi[:, t + 1] * beta[:, t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], b, beta[:, t])
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(length - 1):
        x = alpha[:, t, :, None] * step[None] * (psi[:, t + 1] * beta[:, t + 1])[:, None, :]
        x *= (mask[:, t + 1] / x.sum(axis=(1, 2)))[:, None, None]
        pair += x.sum(axis=0)
    return post, pair


def posteriors(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """As ``forward_backward`` without the transition sums."""
    length = emit.shape[1]
    psi = np.exp(emit - emit.max(axis=2, keepdims=True))
    step = np.exp(trans - trans.max()).astype(emit.dtype)
    alpha = np.empty_like(psi)
    alpha[:, 0] = psi[:, 0]
    for t in range(1, length):
        alpha[:, t] = ((alpha[:, t - 1] / alpha[:, t - 1].sum(axis=1, keepdims=True)) @ step) * psi[:, t]
    beta = np.ones_like(psi[:, 0])
    for t in range(length - 2, -1, -1):
        b = (psi[:, t + 1] * beta) @ step.T
        beta = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), beta)
        alpha[:, t] *= beta
    return alpha / alpha.sum(axis=2, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    ngram: np.ndarray  # (2 ** HASH_BITS, K)
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # (len(lexicon) + 1, K); the last row, of unknown words, is 0
    trans: np.ndarray  # (K, K)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def entry(self, whole: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, whole)
        known = at < len(self.lexicon)
        known[known] = self.lexicon[at[known]] == whole[known]
        return np.where(known, at, len(self.lexicon))

    def scores(self, words: list[bytes]) -> np.ndarray:
        grams, first, whole = features(words)
        return np.add.reduceat(self.ngram[grams], first, axis=0) + self.lexical[self.entry(whole)]


class Words(dict):
    """By word its row of ``scores``; row 0 stands for words without a letter."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        self.new, self.n = [], 1
        self.table = np.zeros((1024, len(self.model.languages)), np.float32)

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        if has_letter(text):
            row = self[word] = self.n
            self.n += 1
            self.new.append(core(text))
        else:
            row = self[word] = 0
        return row

    def scores(self) -> np.ndarray:
        """The table, with the new words' rows."""
        if len(self.table) < self.n:
            grown = np.zeros((max(self.n, 2 * len(self.table)), self.table.shape[1]), np.float32)
            grown[:len(self.table)] = self.table
            self.table = grown
        for i in range(0, len(self.new), 1 << 15):
            part = self.new[i:i + (1 << 15)]
            at = self.n - len(self.new) + i
            self.table[at:at + len(part)] = self.model.scores(part)
        self.new = []
        return self.table


def chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``sizes`` words in a row: (word index by chain and place, mask)."""
    n = -(-sizes // CHAIN)
    begin = np.cumsum(sizes) - sizes
    chain = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n)[:, None] + chain[:, None] * CHAIN + np.arange(CHAIN)
    mask = at < np.repeat(begin + sizes, n)[:, None]
    return np.where(mask, at, 0), mask


def label_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Sums of label probabilities over each text's words: (texts, K)."""
    words = worker_table(model.name, lambda: Words(model))
    if len(words) > CACHE_WORDS:
        words.reset()
    k = len(model.languages)
    rows = [np.fromiter(map(words.__getitem__, text.lower().split()), np.int64) for text in texts]
    table = words.scores()
    rows = [r[r > 0] for r in rows]
    sizes = np.array([len(r) for r in rows], np.int64)
    total = int(sizes.sum())
    out = np.zeros((len(texts), k))
    if not total:
        return out
    at, mask = chains(sizes)
    row, post = np.concatenate(rows), np.empty((total, k))
    for i in range(0, len(at), 1024):
        a, m = at[i:i + 1024], mask[i:i + 1024]
        post[a[m]] = posteriors(table[row[a]], model.trans, m)[m]
    some = np.flatnonzero(sizes)
    out[some] = np.add.reduceat(post, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def spliced(docs: list[list[bytes]], labels: np.ndarray, rng) -> tuple[list[list[bytes]], list[list[int]]]:
    """Training chains: documents cut to pieces of random length and dealt anew."""
    parts = []
    for words, y in zip(docs, labels, strict=True):
        i = 0
        while i < len(words):
            n = int(rng.geometric(1 / 24)) + 3
            parts.append((words[i:i + n], int(y)))
            i += n
    rng.shuffle(parts)
    xs, ys, x, y = [], [], [], []
    for words, label in parts:
        x, y = x + words, y + [label] * len(words)
        while len(x) >= CHAIN:
            xs.append(x[:CHAIN])
            ys.append(y[:CHAIN])
            x, y = x[CHAIN:], y[CHAIN:]
    if x:
        xs.append(x)
        ys.append(y)
    return xs, ys


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model | None:
    """Fit on labelled texts; None without a language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    docs, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in text.lower().split() if has_letter(w.decode())]
        if len(words) > TRAIN_WORDS:  # whole chains spread over the text
            n = TRAIN_WORDS // CHAIN
            at = np.linspace(0, len(words) - CHAIN, n).astype(int)
            words = [w for i in at for w in words[i:i + CHAIN]]
        if words:
            docs.append([core(w.decode()) for w in words])
            labels.append(names.index(lang))
    if not docs:
        return None
    k = len(names)
    xs, ys = spliced(docs, np.array(labels), rng)
    types: dict[bytes, int] = {}
    mask = np.zeros((len(xs), CHAIN), bool)
    x, y = np.zeros(mask.shape, np.int64), np.zeros(mask.shape, np.int64)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[i, :len(a)] = [types.setdefault(w, len(types)) for w in a]
        y[i, :len(a)], mask[i, :len(a)] = b, True
    grams, first, whole = features(list(types))
    count = np.bincount(x[mask], minlength=len(types))
    lexicon = np.unique(whole[count >= 3])  # rarer words are told by their n-grams alone
    m = Model(names, np.zeros((1 << HASH_BITS, k), np.float32), lexicon, np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k)))
    entry = m.entry(whole)
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(first, len(grams))))
    gold = np.zeros((*mask.shape, k))
    np.put_along_axis(gold, y[..., None], 1, axis=2)
    gold *= mask[..., None]
    both = mask[:, 1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    n_words = mask.sum()
    slow = [np.full(w.shape, 1e-8) for w in (m.ngram, m.lexical, m.trans)]
    for _ in range(ROUNDS):
        emit = np.add.reduceat(m.ngram[grams], first, axis=0) + m.lexical[entry]
        post, pair = forward_backward(emit[x].astype(np.float64), m.trans, mask)
        miss = (gold - post * mask[..., None])[mask]
        by_type = np.stack([np.bincount(x[mask], miss[:, j], len(types)) for j in range(k)], axis=1)
        by_gram = np.stack([np.bincount(grams, by_type[owner, j], 1 << HASH_BITS) for j in range(k)], axis=1)
        by_entry = np.stack([np.bincount(entry, by_type[:, j], len(lexicon) + 1) for j in range(k)], axis=1)
        for w, g, s in zip((m.ngram, m.lexical, m.trans), (by_gram, by_entry, seen - pair), slow, strict=True):
            g = g / n_words - DECAY / 100 * w
            s += g * g
            w += (RATE * g / np.sqrt(s)).astype(w.dtype)
        m.lexical[-1] = 0
    return m


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        folds: int = 3, held_fold: int = 1) -> Model | None:
    """Choose the sample by ids alone, then fetch its texts: TRAIN_DOCS rows per language
    reach the driver."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds, lambda r: r == held_fold))
    d = d.withColumn("h", F.xxhash64("doc_id"))
    # an id's rows come together, so the rank is over ids
    chosen = first_per_group(d.select("lang", "h").distinct(), "lang", ["h"], TRAIN_DOCS)
    rows = d.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("h", "lang", "text").collect()
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["lang"], r["h"]))
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, shares) and the columns named in ``keep``;
    shares has the probability mass per language, in the order of the model's languages."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = ["doc_id", *keep]

    def label(batches):
        m = shared.value
        for batch in batches:
            at = 0
            for part in slices(batch.column("_text")):
                lang, score, n_words, shares = [], [], [], []
                sums = label_texts(m, part) if m else np.zeros((len(part), 1))
                total = np.rint(sums.sum(axis=1)).astype(int)
                best = sums.argmax(axis=1)
                for i, n in enumerate(total.tolist()):
                    lang.append(m.languages[best[i]] if n else UND)
                    share = np.clip(sums[i] / max(sums[i].sum(), 1e-12), 0, 1) if n else np.zeros(sums.shape[1])
                    score.append(float(share[best[i]]))
                    n_words.append(n)
                    shares.append(share.tolist())
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in passed), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(n_words, pa.int64()), pa.array(shares, pa.list_(pa.float64()))],
                    names=[*passed, "lang_pred", "score", "n_words", "shares"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed)
    return rows.mapInArrow(label, f"{kinds}, lang_pred string, score double, n_words long, shares array<double>")


def slices(texts):
    """Lists of whole texts of about BATCH_BYTES together."""
    part, n = [], 0
    for text in texts:
        part.append(text.as_py())
        n += len(part[-1])
        if n >= BATCH_BYTES:
            yield part
            part, n = [], 0
    if part:
        yield part


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1, **cols) -> DataFrame:
    """Fit on the rows not held out and label every document."""
    model = fit(docs, folds=folds, held_fold=held_fold, **cols)
    out = predict(docs, model, **{k: v for k, v in cols.items() if k != "lang_col"})
    return out.select("doc_id", held_out(F.col("doc_id"), folds, lambda r: r == held_fold).alias("held_out"),
                      "lang_pred", "score", "n_words", "shares")
