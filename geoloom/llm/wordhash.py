"""64-bit hashes of the words of whole texts, many texts at a time, in numpy.

A byte stands for a fixed random number; a word is the polynomial in an odd base
of its bytes' numbers, found from running sums, then mixed. Work is linear in the
bytes and memory is a group's: GROUP_BYTES, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Bytes that part words: space and 09 to 0D; or all ASCII but letters and digits.
SPACES = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTES = np.random.default_rng(20240531).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, GROUP_BYTES + (1 << 16))
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def hash_words(data: bytes, parting: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``, in order."""
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~parting[x]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    powers, inverse = _grown(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[x] * powers[: len(x)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def word_groups(texts: list[bytes], parting: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes of a group of texts, offsets of its texts in them)."""
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k + len(group) < len(texts) and (not group or size + len(texts[k + len(group)]) <= GROUP_BYTES):
            group.append(texts[k + len(group)])
            size += len(group[-1]) + 1
        words, starts = hash_words(b"\n".join(group), parting)
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        yield k, words, np.searchsorted(starts, begins)
        k += len(group)
