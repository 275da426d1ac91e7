"""Simple-8b coding of token ids in 64-bit words, with escapes and block offsets for vectorised decoding.

A word's top four bits select how many ids its low sixty bits hold, and how wide each is; an id beyond sixty bits, or
any negative one, takes an escape word and a raw word. Ids are coded in blocks of BLOCK, each at a word of its own, so
that all blocks are coded and decoded side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
MAGIC = b"SPS8"
ESCAPE = 0
#: Fixed values of the coding: (ids, bits) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([1, *(n for n, _ in SELECTORS), 0], np.int64)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (one more, near powers of two, for some beyond 2^53), 64 for a negative one."""
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    bits[ids < 0] = 64
    return bits


def encode(ids: np.ndarray) -> bytes:
    """Header (magic, ids, blocks, words: four 32-bit numbers), the first word of each block, the words."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros((blocks, BLOCK), np.int64)
    v.reshape(-1)[:n] = ids
    length = np.full(blocks, BLOCK, np.int64)
    if n % BLOCK:
        length[-1] = n % BLOCK
    need = _widths(v)
    choice = np.zeros((blocks, BLOCK), np.uint8)
    most, have = need.copy(), 1
    for s in range(len(SELECTORS), 0, -1):  # from one id to many; the most ids that fit win
        count, bits = SELECTORS[s - 1]
        for have in range(have, count):  # greatest need of the next ids; past the block all is zero
            np.maximum(most[:, : BLOCK - have], need[:, have:], out=most[:, : BLOCK - have])
        have = max(have, count)
        fits = most <= bits
        if not fits.any():
            break  # more ids in fewer bits fit nowhere either
        choice[fits] = s
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    heads = np.zeros((blocks, BLOCK), bool)
    while len(rows):
        here = at[rows]
        heads[rows, here] = True
        at[rows] = here = here + _COUNT[choice[rows, here]]
        rows = rows[here < length[rows]]
    flat = np.flatnonzero(heads)
    if not len(flat):
        return MAGIC + np.zeros(3, "<u4").tobytes()
    block, place, chosen = flat // BLOCK, flat % BLOCK, choice.reshape(-1)[flat].astype(np.int64)
    size = 1 + (chosen == ESCAPE)
    word = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    wide = np.zeros((blocks, BLOCK + 60), np.uint64)
    wide[:, :BLOCK] = v.view(np.uint64)
    for s in np.unique(chosen).tolist():
        i = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[word[i] + 1] = wide[block[i], place[i]]
            continue
        count, bits = SELECTORS[s - 1]
        packed = np.full(len(i), s << 60, np.uint64)
        for k in range(count):
            packed |= wide[block[i], place[i] + k] << np.uint64(k * bits)
        out[word[i]] = packed
    offsets = word[np.searchsorted(block, np.arange(blocks))]
    return MAGIC + np.array([n, blocks, len(out)], "<u4").tobytes() + offsets.astype("<u4").tobytes() + out.astype("<u8").tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, blocks, size = np.frombuffer(data, "<u4", 3, 4).tolist()
    offsets = np.frombuffer(data, "<u4", blocks, 16).astype(np.int64)
    words = np.frombuffer(data, "<u8", size, 16 + 4 * blocks)
    if not n:
        return np.zeros(0, np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(size, bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():  # few: escapes, and raw words that look like them
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    s = selector[heads]
    block = np.searchsorted(offsets, heads, side="right") - 1
    count = _COUNT[s]
    before = np.cumsum(count) - count
    place = before - before[np.searchsorted(heads, offsets)][block]  # in the block
    out = np.zeros((blocks, BLOCK + 60), np.uint64)
    for k in np.unique(s).tolist():
        i = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[block[i], place[i]] = words[heads[i] + 1]
            continue
        many, bits = SELECTORS[k - 1]
        low = words[heads[i]]
        for j in range(many):
            # what a block's last word holds beyond the block lands in the margin, or is zero
            out[block[i], place[i] + j] = low >> np.uint64(j * bits) & np.uint64((1 << bits) - 1)
    return out[:, :BLOCK].reshape(-1)[:n].astype(np.int64)
