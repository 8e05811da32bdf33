"""Word shingles as 64-bit hashes, computed with numpy inside tasks."""
from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


class WordHashes(dict):
    """Word -> 64-bit hash, filled on demand; `trim()` bounds its memory."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits, so that order by value is order at random."""
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words in order; of the whole sequence if it is shorter; none if it is empty."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _MUL + hashes[j : n - size + 1 + j]
    return mix(out)


def shingle_set(text: bytes, cache: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() touches A-Z only and bytes.split() cuts at [\x20\x09-\x0D]."""
    return np.unique(windows(cache.of(text.lower().split()), k))
