"""Word shingles as 64-bit hashes, for operators that work on arrays inside a task."""
from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64; fixed values)."""
    x = x + MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    BOUND = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


def hashed(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash per window of ``size`` word hashes; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    size_here = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size_here + 1, size_here, np.uint64)
        for j in range(size_here):
            out = mix(out) + words[j : n - size_here + 1 + j] * MULTIPLIER
        return mix(out)


def unit_cells(shingles: np.ndarray) -> np.ndarray:
    """Distinct 64-bit ids, one for each unit of weight: the j-th repeat of a shingle is a cell of its own.

    The set Jaccard similarity of cells is the weighted (multiset) Jaccard similarity of shingles.
    """
    values, counts = np.unique(shingles, return_counts=True)
    if len(values) == len(shingles):
        return values
    which = np.repeat(np.arange(len(values)), counts)
    nth = np.arange(len(shingles)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        again = mix(values[which] + nth.astype(np.uint64) * MULTIPLIER)
    return np.unique(np.where(nth == 0, values[which], again))
