"""Words and word shingles of whole texts as 64-bit hashes, in NumPy over the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased first.  A word's hash is the sum of one
random value for each (place in the word, byte); a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

SEED = 0x5EED
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64
_TABLE = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
_ORDER = mix(np.arange(101, 101 + 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """The words of the rows whose bytes are ``raw[at[i]:at[i+1]]``: ``hashes``, ``first`` byte and ``length`` of each
    (places within ``raw[at[0]:]``) and the rows' word offsets ``rows``."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK):
        base = int(at[0])
        data = raw[base : int(at[-1])]
        cut = (at - base).astype(np.int64)
        n = len(data)
        solid = ~blank[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        edge = cut[(cut > 0) & (cut < n)]
        start[edge] = solid[edge]
        self.first = start.nonzero()[0]
        self.rows = np.searchsorted(self.first, cut)
        body = solid.nonzero()[0]
        rank = np.cumsum(start)[body] - 1
        place = body - self.first[rank]
        code = place * 256 + LOWER[data[body]]
        value = _TABLE[np.minimum(code, len(_TABLE) - 1)]
        far = place >= _PLACES
        if far.any():
            value[far] = mix((code[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
        self._begin = np.searchsorted(body, self.first)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        self.length = np.diff(np.append(self._begin, len(body)))
        self.hashes = self.prefix(None)

    def prefix(self, k: int | None) -> np.ndarray:
        """The hash of each word's first k bytes; None: of the word."""
        end = self._begin + (self.length if k is None else np.minimum(self.length, k))
        return self._sums[end] - self._sums[self._begin]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value for each word, by row."""
        sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
        return sums[self.rows[1:]] - sums[self.rows[:-1]]


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes: ``width`` words each, or the whole sequence of a row with fewer."""
    found = Words(raw, at)
    hashes, begin, n = found.hashes, found.rows, len(found.hashes)
    if n >= width:
        wide = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            wide += hashes[k : n - width + 1 + k] * _ORDER[k]
        wide = mix(wide)
    out = []
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if hi - lo >= width:
            s = np.sort(wide[lo : hi - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            few = hashes[lo:hi] * _ORDER[: hi - lo]
            out.append(mix(np.array([few.sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
