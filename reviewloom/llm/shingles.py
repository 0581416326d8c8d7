"""Word shingles of texts as 64-bit hashes."""

import numpy as np
from xxhash import xxh3_64_intdigest

#: Word hashes that a worker remembers at most.
CACHE_WORDS = 250_000


class WordHash(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` word hashes, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_set(words: list[bytes], size: int, cache: WordHash) -> np.ndarray:
    """The distinct shingles, sorted; fewer than ``size`` words are one shingle, none are none."""
    return np.unique(shingle_hashes(cache.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)
