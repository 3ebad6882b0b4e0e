"""Word hashes for the operators that read texts in Arrow batches."""

from __future__ import annotations

import sys

import numpy as np
import xxhash

_CACHE_WORDS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHash(dict):
    """Word (bytes) -> 64-bit hash as eight bytes, which join faster than numbers convert; forgets everything when full, which changes no result."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word).to_bytes(8, sys.byteorder)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def parts(batches, rows: int = 2000):
    """Arrow batches cut to that many rows at most, which bounds what a task holds of their words."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which near values part (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = mixed(h[:n] + np.uint64(k))
    for i in range(1, k):
        g = mixed(g * _M1 + h[i : i + n])
    return g
