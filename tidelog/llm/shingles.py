"""Word shingles as 64-bit hashes, shared by the operators on near copies."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Words kept, and the longest of them: some 25 MB.
CACHE_WORDS, CACHE_CHARS = 120_000, 64
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash. The first words met stay; a full table is begun anew once most words miss it."""

    missed = 0

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.missed += 1
            if self.missed > 8 * CACHE_WORDS:
                self.clear()
                self.missed = 0
        elif len(word) <= CACHE_CHARS:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: list[str], table: Words) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of ``width`` words; a shorter text is one shingle of all its words."""
    n = len(h)
    if not n:
        return h
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = (total + h[j : n - width + 1 + j]) * PRIMES[j % len(PRIMES)]
    return mix(total + np.uint64(width))


def bag(text: str, table: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct shingles and their counts; words are split at white space, without case."""
    return np.unique(shingles(hashes(text.lower().split(), table)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: shared counts over joint counts."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)
