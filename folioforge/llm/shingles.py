"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures of such sets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

WORDS = 5
#: Words whose hashes a worker keeps.
CACHE = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_words = WordHashes()
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text, A-Z lower-cased, words between [\\x20\\x09-\\x0D]+.

    Fewer words than ``size``: the whole sequence as one shingle; none: an empty set.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed, wide = _words.of(words), min(size, len(words))
    joined = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        joined = mix(joined * _FACTOR + hashed[i : len(words) - wide + 1 + i])
    return np.unique(joined)


class MinHash:
    """``count`` functions x -> (x xor b) * a modulo 2^64; a signature has the upper halves of their least values."""

    def __init__(self, count: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**63 - 1, (count, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**64 - 1, (count, 1), np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        least = [(((part ^ self.b) * self.a)).min(axis=1) for part in _parts(values, 2048)]
        return (np.minimum.reduce(least) >> np.uint64(32)).astype(np.uint32)


def _parts(values: np.ndarray, most: int) -> Iterable[np.ndarray]:
    return (values[i : i + most] for i in range(0, len(values), most))
