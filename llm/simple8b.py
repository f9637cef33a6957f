"""Simple-8b: non-negative integers packed into 64-bit words.

The top four bits of a word are its selector, the other 60 hold that many values of so many
bits. Selector 0 is an escape: the word stands for one value that is kept whole in a side
array, and holds its place there. Values are coded in blocks of a fixed number of values
with the first word of every block on record, so blocks are coded and decoded side by side
in vectors; only the last word of a block may hold fewer values than its selector says.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# By selector: (values in a word, bits of each). Fixed values of the format.
ESCAPE = 0
LAYOUT = ((1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
          (3, 20), (2, 30), (1, 60), (240, 0))
BLOCK = 1024
_COUNTS = np.array([1] + [n for n, _ in LAYOUT[1:]])
_DENSEST_FIRST = sorted(range(1, 16), key=lambda s: -LAYOUT[s][0])
_PAYLOAD = np.uint64((1 << 60) - 1)


@dataclass(frozen=True)
class Packed:
    n: int
    words: np.ndarray      # uint64
    blocks: np.ndarray     # int64: first word of each block, and the number of words
    escapes: np.ndarray    # uint64: values that no word holds


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for zero."""
    if values.max() < 1 << 53:   # exact as doubles, whose exponent is the answer
        return np.frexp(values.astype(np.float64))[1].astype(np.int8)
    out = np.zeros(len(values), np.int8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        out[big] += step
        rest[big] >>= np.uint64(step)
    return out + (values > 0)


def pack(values: np.ndarray, escape: np.ndarray | None = None) -> Packed:
    """Greedy: each word takes the densest selector that the next values fit.

    ``escape`` marks values to keep whole; those of more than 60 bits always are.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return Packed(0, values, np.zeros(1, np.int64), values)
    width = _bits(values)
    width[width > 60] = 99
    if escape is not None:
        width[escape] = 99
    place = np.arange(n, dtype=np.int32)
    end = np.minimum((place // BLOCK + 1) * BLOCK, n).astype(np.int32)
    selector = np.zeros(n, np.int8)
    taken = np.ones(n, np.int32)
    undecided = width <= 60
    for s in _DENSEST_FIRST:
        count, bits = LAYOUT[s]
        # first place at or after each one where a value is too wide
        stop = np.minimum.accumulate(np.where(width > bits, place, np.int32(n))[::-1])[::-1]
        want = np.minimum(count, end - place)
        fits = undecided & (np.minimum(stop, end) - place >= want)
        selector[fits], taken[fits] = s, want[fits]
        undecided &= ~fits
        if not undecided.any():
            break
    at, starts = np.arange(0, n, BLOCK), []
    limit = end[at]
    while len(at):   # one word of every block at a time
        starts.append(at)
        at = at + taken[at]
        alive = at < limit
        at, limit = at[alive], limit[alive]
    first = np.sort(np.concatenate(starts))
    words = np.zeros(len(first), np.uint64)
    chosen = selector[first]
    padded = np.concatenate([np.where(width > 60, np.uint64(0), values), np.zeros(240, np.uint64)])
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        count, bits = LAYOUT[s]
        if s == ESCAPE:
            words[mine] = np.arange(len(mine), dtype=np.uint64)
            continue
        word = np.zeros(len(mine), np.uint64)
        for k in range(count if bits else 0):
            here = padded[first[mine] + k]
            here[k >= taken[first[mine]]] = 0
            word |= here << np.uint64(k * bits)
        words[mine] = word | np.uint64(s) << np.uint64(60)
    blocks = np.append(np.searchsorted(first, np.arange(0, n, BLOCK)), len(first)).astype(np.int64)
    return Packed(n, words, blocks, values[first[chosen == ESCAPE]])


def unpack(packed: Packed) -> np.ndarray:
    out = np.zeros(packed.n, np.uint64)
    if not packed.n:
        return out
    words, blocks = packed.words, packed.blocks
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNTS[selector]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks))
    start = block * BLOCK + before - before[blocks[:-1]][block]
    end = np.minimum((block + 1) * BLOCK, packed.n)
    payload = words & _PAYLOAD
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        n, bits = LAYOUT[s]
        if s == ESCAPE:
            out[start[mine]] = packed.escapes[payload[mine].astype(np.int64)]
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(n if bits else 0):
            inside = mine[start[mine] + k < end[mine]]
            out[start[inside] + k] = payload[inside] >> np.uint64(k * bits) & mask
    return out
