"""Simple-8b: word-aligned coding of unsigned 64-bit integers, vectorised with numpy.

A 64-bit word has a 4-bit selector (top bits) and 60 bits of values, lowest first.
Selector k > 0 packs ``COUNTS[k]`` values of ``BITS[k]`` bits; the last word of a block may
hold fewer. Selector 0 is the escape: the next word is one raw value of 61 to 64 bits
(its top four bits are never zero, so it cannot be taken for another escape). Blocks of
``BLOCK`` values are coded on their own; offsets give each block's first word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    if len(v) and v.max() < len(_SHORT):
        return _SHORT[v.astype(np.uint16)]
    low = np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = np.frexp((v >> np.uint64(32)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets has the first word of each block and, last, their number."""
    v = np.ascontiguousarray(values, np.uint64)
    n_blocks = -(-len(v) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    wide = BLOCK + int(COUNTS.max())
    own = np.zeros((n_blocks, wide), np.uint64)  # zeros past a block's end fit anything
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[:len(v)] = v
    own[:, :BLOCK] = padded.reshape(n_blocks, BLOCK)
    bits = np.zeros(own.shape, np.uint8)
    bits[:, :BLOCK] = _bit_lengths(padded).reshape(n_blocks, BLOCK)
    # most[n][i]: bits of the largest of n values from i on, from two shorter windows
    most, select, done = {1: bits}, np.zeros((n_blocks, BLOCK), np.uint8), 1
    for k in range(len(COUNTS) - 1, 0, -1):
        n = int(COUNTS[k])
        while done < n:
            step = min(done, n - done)
            shifted = np.zeros_like(bits)
            shifted[:, :wide - done] = most[step][:, done:] if step in most else _window(bits, step)[:, done:]
            most[done + step] = np.maximum(most[done], shifted)
            done += step
        select[most[n][:, :BLOCK] <= BITS[k]] = k
        most = {m: x for m, x in most.items() if m in (1, done) or m * 2 >= done}
    size = np.full(n_blocks, BLOCK, np.int64)
    size[-1] = len(v) - (n_blocks - 1) * BLOCK
    at, live, begins = np.zeros(n_blocks, np.int64), np.arange(n_blocks), np.zeros((n_blocks, BLOCK), bool)
    while len(live):  # all blocks step at once
        here = at[live]
        begins[live, here] = True
        here += COUNTS[select[live, here]]
        at[live] = here
        live = live[here < size[live]]
    block, start = np.nonzero(begins)
    sel = select[block, start].astype(np.int64)
    width = np.where(sel == 0, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for k in np.unique(sel):
        here = np.flatnonzero(sel == k)
        if k == 0:
            words[place[here] + 1] = own[block[here], start[here]]
            continue
        n, b = int(COUNTS[k]), int(BITS[k])
        word = np.full(len(here), np.uint64(k) << np.uint64(60), np.uint64)
        if b:
            got = own[block[here][:, None], start[here][:, None] + np.arange(n)]
            word |= np.bitwise_or.reduce(got << (np.arange(n, dtype=np.uint64) * np.uint64(b)), axis=1)
        words[place[here]] = word
    first = np.searchsorted(block, np.arange(n_blocks))
    return words, np.append(place[first], len(words))


def _window(bits: np.ndarray, n: int) -> np.ndarray:
    out = bits.copy()
    for j in range(1, n):
        out[:, :-j] = np.maximum(out[:, :-j], bits[:, j:])
    return out


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of consecutive blocks, all of BLOCK values but the last."""
    words, offsets = np.asarray(words, np.uint64), np.asarray(offsets, np.int64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = sel[:-1] == 0
    head = np.flatnonzero(~raw)
    sel = sel[head]
    n_blocks = len(offsets) - 1
    block = np.searchsorted(offsets, head, side="right") - 1
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(n_blocks))
    start = before - before[first][block]
    size = np.full(n_blocks, BLOCK, np.int64)
    size[-1] = n - (n_blocks - 1) * BLOCK
    out = np.zeros(n_blocks * BLOCK, np.uint64)
    for k in np.unique(sel):
        here = np.flatnonzero(sel == k)
        to = block[here] * BLOCK + start[here]
        if k == 0:
            out[to] = words[head[here] + 1]
            continue
        c, b = int(COUNTS[k]), int(BITS[k])
        if not b:
            continue
        shifts = np.arange(c, dtype=np.uint64) * np.uint64(b)
        got = (words[head[here]][:, None] >> shifts) & np.uint64((1 << b) - 1)
        ok = start[here][:, None] + np.arange(c) < size[block[here]][:, None]
        out[(to[:, None] + np.arange(c))[ok]] = got[ok]
    return out[:n]


def find_block(words: np.ndarray, offsets: np.ndarray, i: int, n: int) -> np.ndarray:
    """Values of block ``i`` alone, of ``n`` values in all: random access by the offsets."""
    part = words[offsets[i]:offsets[i + 1]]
    return decode(part, np.array([0, len(part)]), min(BLOCK, n - i * BLOCK))
