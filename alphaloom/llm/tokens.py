"""Hashed words of a batch of texts as flat numpy arrays, for code inside tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash

U = np.uint64
CACHE = 200_000  # distinct words remembered before a start anew


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash of its normal form, computed once per distinct word."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        self[word] = h
        return h

    def flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words (A-Z lower-cased, cut at ASCII white space) and the offset of
        each text's first word, with the total at the end."""
        if len(self) > CACHE:
            self.clear()
        out: list[int] = []
        starts = [0]
        find = self.__getitem__
        for t in texts:
            if t:
                out.extend(map(find, t.encode("utf-8", "surrogatepass").lower().split()))
            starts.append(len(out))
        return np.array(out, dtype=U), np.array(starts, dtype=np.int64)


def windows(flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window and the number of the text it lies in, in order."""
    count = max(0, len(flat) - n + 1)
    if not count:
        return np.empty(0, U), np.empty(0, np.int64)
    h = flat[:count].copy()
    for k in range(1, n):
        h = h * U(0x9E3779B97F4A7C15) + flat[k : k + count]
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:count] == owner[n - 1 : n - 1 + count]
    return mix(h[inside]), owner[:count][inside]
