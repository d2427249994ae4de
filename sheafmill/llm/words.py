"""Vectorised words, lines and shingles over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. These six never occur inside a multi-byte character, so byte runs and
character runs are the same words.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, random64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = random64(256, 11)
_BYTE_LOWER = _BYTE[_LOWER]
_BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:  # doubling: out[have:2*have] = out[:have] * base**have
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


_POWER = _powers(_BASE, _BLOCK)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


class Words:
    """Words of a batch: byte `starts` and `ends`, and `bounds` with the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z as a-z if `lower`."""
        return span_hashes(self.data, self.starts, self.ends, _BYTE_LOWER if lower else _BYTE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial hashes of disjoint ascending spans, by prefix sums over blocks of whole spans."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        upto = int(np.searchsorted(ends, lo + _BLOCK, side="right"))
        if upto <= at:
            upto = at + 1
            power = _powers(_BASE, int(ends[at] - lo))
        else:
            power = _POWER
        part = values[data[lo : ends[upto - 1]]]
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        first, last = starts[at:upto] - lo, ends[at:upto] - lo
        inverse = _INVERSE[np.minimum(first, _BLOCK - 1)]  # a span over a block long starts at 0
        out[at:upto] = (sums[last] - sums[first]) * inverse
        at = upto
    return mix64(out)


def trigrams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three-word shingles in text order and n + 1 bounds by text; a text of one or two
    words has one shingle of them all, a text without words none."""
    n = len(hashes)
    tri = np.zeros(n, np.uint64)
    if n > 2:
        tri[:-2] = mix64(hashes[:-2] * _A + hashes[1:-1] * _B + hashes[2:] * _C)
    lo, count = words.bounds[:-1], words.counts
    one, two = lo[count == 1], lo[count == 2]
    tri[one] = mix64(hashes[one] * _A + _D)
    tri[two] = mix64(hashes[two] * _A + hashes[two + 1] * _B + _D)
    size = np.where(count >= 3, count - 2, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(count)), size)
    return tri[lo[text] + (np.arange(bounds[-1]) - bounds[text])], bounds


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of one to three words in text order, and n + 1 bounds by text; the same as those of
    `trigrams` for as many words."""
    parts = [hashes[k : len(hashes) - size + 1 + k] * factor for k, factor in zip(range(size), (_A, _B, _C))]
    made = mix64(sum(parts) + (_D if size < 3 else np.uint64(0))) if len(hashes) >= size else np.zeros(0, np.uint64)
    count = np.maximum(words.counts - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(count)), count)
    return made[words.bounds[:-1][text] + (np.arange(bounds[-1]) - bounds[text])], bounds
