"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


class WordHashes(dict):
    """Hash of each word, kept for as many words as most."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.uint64, len(some))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> _MIX[2])
    x *= _MIX[0]
    x ^= x >> _MIX[2]
    x *= _MIX[1]
    return x ^ (x >> _MIX[2])


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes, sorted, of a word sequence's shingles; the whole sequence if it has fewer words; none if none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, width)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MULTIPLIER + hashes[i : n - k + 1 + i]
    return np.unique(mixed(h))
