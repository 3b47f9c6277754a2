"""Simple-8b: unsigned integers packed into 64-bit words, in blocks that decode on their own.

The top four bits of a word select how many integers of how many bits its other 60 bits hold. Selector 0 is the escape: the
next word is one integer of more than 60 bits, as it is. A word never crosses a block; the last word of a block may have room for more integers than
are left. Packing takes as many integers into each word as fit, all blocks of a call side by side.
"""

from __future__ import annotations

import numpy as np

#: Integers per word and bits of each, by selector; selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 1024
#: More than the integers of any word.
ROOM = 128

_COUNT = np.array(COUNTS, np.int64)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() >= 1 << 53:
        return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, "right").astype(np.uint8)
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # exact, as a double holds 53 bits


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the first word of each block (and the number of words, last)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # zeros behind each block, as many as a word can reach
    n_blocks, width = -(-n // block), block + ROOM
    padded = np.zeros((n_blocks, width), np.uint64)
    whole = n // block
    padded[:whole, :block] = values[: whole * block].reshape(whole, block)
    padded[whole:, : n - whole * block] = values[whole * block :]
    padded = padded.ravel()
    choice = _selectors(bit_lengths(padded))
    at = np.arange(n_blocks) * width
    begins, ends = at, at + np.minimum(block, n - np.arange(n_blocks) * block)
    begun = np.zeros(len(padded), bool)
    while len(at):
        begun[at] = True
        at = at + _COUNT[choice[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    starts = np.flatnonzero(begun)
    picked = choice[starts]
    place = np.cumsum(1 + (picked == 0)) - 1 - (picked == 0)
    words = np.zeros(int(place[-1]) + 1 + int(picked[-1] == 0), np.uint64)
    for s in range(16):
        mine = np.flatnonzero(picked == s)
        if not len(mine):
            continue
        first = starts[mine]
        if s == 0:
            words[place[mine] + 1] = padded[first]
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(COUNTS[s] if BITS[s] else 0):
            word |= padded[first + k] << np.uint64(k * BITS[s])
        words[place[mine]] = word
    return words, np.append(place[np.searchsorted(starts, begins)], len(words))


def _selectors(need: np.ndarray) -> np.ndarray:
    """The selector of a word that begins at each position: that of the most integers which all fit."""
    choice = np.where(need > BITS[15], 0, 15).astype(np.uint8)
    most = {1: need}  # by count, the bits that so many integers from a position on need
    for s in range(14, 0, -1):
        count = COUNTS[s]
        one = max(c for c in most if count - c in most)
        rest = most[count - one]
        most[count] = most[one].copy()
        np.maximum(most[one][: len(need) - one], rest[one:], out=most[count][: len(need) - one])
        choice[most[count] <= BITS[s]] = s
    return choice


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` integers of these whole blocks; ``offsets`` as from ``encode``."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    picked = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[picked]
    raw: list[int] = []
    for i in np.flatnonzero(picked == 0):
        if not raw or raw[-1] != i:
            raw.append(i + 1)
    raw_at = np.array(raw, np.int64)
    count[raw_at] = 0
    picked[raw_at] = -1
    at = np.cumsum(count) - count
    of = np.searchsorted(offsets[1:], np.arange(len(words)), "right")  # each word's block
    inside = at - at[offsets[:-1]][of]
    left = np.minimum(block, n - of * block) - inside  # integers of the block from this word on
    out = np.zeros(n, np.uint64)
    to = of * block + inside
    out[to[raw_at - 1]] = words[raw_at]
    for s in range(2, 16):
        mine = np.flatnonzero(picked == s)
        if not len(mine):
            continue
        w, t, l = words[mine], to[mine], left[mine]
        mask = np.uint64((1 << BITS[s]) - 1)
        short = l.min() < COUNTS[s]
        for k in range(COUNTS[s]):
            v = (w >> np.uint64(k * BITS[s])) & mask
            if short:
                there = k < l
                out[t[there] + k] = v[there]
            else:
                out[t + k] = v
    return out
