"""Hashed word shingles of whole texts, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT = 1 << 19


class WordHasher:
    """64-bit hashes of words; remembers up to 2**19 words, which recur in most texts."""

    def __init__(self) -> None:
        self._place: dict[bytes, int] = {}
        self._hashes = np.empty(1 << 12, np.uint64)

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        place = self._place
        if len(place) > _KEPT:
            place.clear()
        for word in set(words).difference(place):
            at = place[word] = len(place)
            if at == len(self._hashes):
                self._hashes = np.concatenate([self._hashes, np.empty_like(self._hashes)])
            self._hashes[at] = xxhash.xxh64_intdigest(word)
        return self._hashes[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]


def shingle_set(text: bytes | None, size: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words, A-Z lower-cased, split at ASCII white space.

    With fewer words the whole sequence is one shingle; without words or text the set is empty.
    """
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = hasher(words)
    if len(words) < size:
        size = len(words)
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * _MIX + hashes[k : len(words) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))
