"""Vectorised words: 64-bit hashes of all words of a batch of texts, without a Python object per word."""

from __future__ import annotations

import numpy as np

from ._common import mix64

_B, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes for words that white space separates.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes for words of letters and digits; bytes of characters beyond ASCII count as letters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

BLOCK = 1 << 20


def _power(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        one = np.full(max(n, BLOCK + 4096), base, np.uint64)
        one[0] = 1
        _powers[name] = have = np.multiply.accumulate(one)
    return have[:n]


def words(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets by text into them. Hashes are of the bytes with A-Z lower-cased, a
    tabulated polynomial of 64 bits; equal words of any length have equal hashes, others differ but for a chance of
    about 2**-64 a pair on texts not made to collide."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    before[:-1] = inside[1:]
    before[-1] = False
    ends = np.flatnonzero(inside & (~before | edge[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        last = int(ends[to - 1])
        part = np.empty(last - first + 1, np.uint64)
        part[0] = 0
        np.cumsum(_VALUE[LOWER[raw[first:last]]] * _power(last - first, _B, "b"), out=part[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        h = (part[e] - part[s]) * _power(last - first, _INVERSE, "i")[s]
        out[at:to] = mix64(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def grams(hashes: np.ndarray, offs: tuple[int, ...]) -> np.ndarray:
    """For each place, a hash of the words at these distances after it; the last places, where words are missing, are left out."""
    n = len(hashes) - offs[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for o in offs:
        h *= np.uint64(_B)
        h += hashes[o : o + n]
    return mix64(h)
