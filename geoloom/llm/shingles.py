"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from geoloom.llm.wordhash import LOWER, mix, word_groups

_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of the whole sequence if it is shorter."""
    k = min(k, len(words))
    if not k:
        return words
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _FACTORS[j]
    return mix(total)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text, A-Z in lower case; empty without words."""
    data = [(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts]
    for _, words, bounds in word_groups(data):
        for i in range(len(bounds) - 1):
            s = shingle_hashes(words[bounds[i] : bounds[i + 1]], k)
            s.sort()
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
