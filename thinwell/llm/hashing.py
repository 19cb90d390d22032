"""Vectorised hashing of words, shingles and keys."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Words whose hashes a worker remembers before it starts afresh.
REMEMBERED = 400_000


class WordHashes(dict):
    """64-bit hash of each word, computed once; call `trim` between batches."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fixed_words(n: int, seed: int) -> np.ndarray:
    """`n` uint64 constants that depend on `seed` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingles(fields: Iterable[list[int]], width: int) -> np.ndarray:
    """Hashes of every `width` consecutive words inside single fields, repeats kept."""
    flat: list[int] = []
    ends: list[int] = []
    for words in fields:
        flat += words
        ends.append(len(flat))
    return shingles_of(np.array(flat, np.uint64), np.array(ends, np.int64), width)[0]


def shingles_of(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of fields laid end to end, and the position of each shingle's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    salts = fixed_words(width, 7)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += mix(words[i : i + n] ^ salts[i])
    inside = np.ones(n, bool)
    for back in range(1, width):
        crossing = ends[:-1] - back
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    at = np.nonzero(inside)[0]
    return mix(total[at]), at


def take_batches(parts: Iterable, size: int) -> Iterator[list]:
    """Consecutive items in lists of at most `size`."""
    held: list = []
    for part in parts:
        held.append(part)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
