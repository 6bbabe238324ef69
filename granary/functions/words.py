"""Words, word shingles and their hashes, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters or digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters or digits of ``text``; none of a null."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered; it forgets all at ``limit`` words, so its size is bounded."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * _ODD[5]
    h = h ^ (h >> np.uint64(29))
    h = h * _ODD[6]
    return h ^ (h >> np.uint64(32))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words from each position; none of fewer words."""
    if len(hashes) < n:
        return np.array([], dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out ^ hashes[i : len(hashes) - n + 1 + i]) + _ODD[i % 5]
    return out
