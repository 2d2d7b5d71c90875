"""Simple-8b word-aligned coding of token ids, vectorised with numpy.

A 64-bit word holds a 4-bit selector (top) and 60 payload bits: as many of the next values as fit at one width.
Selector 15 is an escape: the word stands for one value of 60 bits or more, kept raw in the block's escape area.
Values are coded in blocks; a block's words, its escapes and its value count are found by offset, so blocks decode
independently and each selector's words decode in one vector operation.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: payload width in bits of selectors 0..13; the counts follow from 60 bits.
WIDTHS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = 15
BLOCK = 1 << 15
_POWERS = np.array([1 << b for b in range(64)], dtype=np.uint64)
_SMALL = np.searchsorted(_POWERS[:17], np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
_COUNT_OF = np.array([*COUNTS, 0, 1], dtype=np.int64)


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    if values.dtype.itemsize <= 2 or (len(values) and int(values.max()) < 1 << 16):
        return _SMALL[values]
    return np.searchsorted(_POWERS, values.astype(np.uint64), side="right").astype(np.uint8)


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of one block: greedy, each word takes the most values that fit."""
    n, pad = len(values), COUNTS[-1]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = np.zeros(n + pad, np.uint8)
    width[:n] = bit_widths(values)
    padded = np.zeros(n + pad, np.uint64)
    padded[:n] = values
    escaped = width[:n] > 60
    # tallest[k]: largest width over 2^k values from each place; feasibility falls as the count grows, so it is counted
    tallest, size, fits = {1: width}, 1, np.zeros(n, np.uint8)
    while size * 2 <= pad:
        m = tallest[size]
        tallest[size * 2] = np.maximum(m[: len(m) - size], m[size:])
        size *= 2
    for bits, count in zip(WIDTHS, COUNTS, strict=True):
        half = 1 << (count.bit_length() - 1)
        m = tallest[half]
        fits += np.maximum(m[:n], m[count - half : count - half + n]) <= bits
    selector = np.where(escaped, ESCAPE, fits.astype(np.int64) - 1)
    step = _COUNT_OF[selector].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s != ESCAPE:
            rows = np.flatnonzero(chosen == s)
            block = padded[starts[rows][:, None] + np.arange(COUNTS[s])] << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]))
            words[rows] |= np.bitwise_or.reduce(block, axis=1)
    return words, padded[:n][escaped]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT_OF[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        first = ends[rows] - counts[rows]
        if s == ESCAPE:
            out[first] = escapes
            continue
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
        out[first[:, None] + np.arange(COUNTS[s])] = (words[rows][:, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
    return out[:n]
