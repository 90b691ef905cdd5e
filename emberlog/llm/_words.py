"""Words and hashed word shingles of whole texts, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
#: Odd multipliers from a fixed seed: one for each place in a shingle of up to 16 words.
_PLACES = np.random.default_rng(20240229).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a task remembers, at some 160 bytes each.
_MOST = 150_000


class WordHashes(dict):
    """64-bit hashes of words; when there are too many, it begins anew."""

    def __missing__(self, word) -> int:
        if len(self) >= _MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, newline, \\v, \\f and \\r, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased: punctuation does not count."""
    return _WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """``of(text)``: sorted distinct hashes of its ``k``-word shingles; with fewer words, one for all of them.

    Each task makes its own, so that the hashes remembered go when it ends.
    """

    def __init__(self, k: int, words: Callable[[str | None], list] = ascii_words):
        self.k, self.words, self.hashes = k, words, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        return self.of_words(self.words(text))

    def of_words(self, words: list) -> np.ndarray:
        n, k = len(words), self.k
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        if n < k:
            return mixed(np.array([(h * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        total = h[: n - k + 1] * _PLACES[0]
        for i in range(1, k):
            total += h[i : n - k + 1 + i] * _PLACES[i]
        return np.unique(mixed(total))
