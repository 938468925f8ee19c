"""Hashes of substrings, for whole texts at once with NumPy.

A text's bytes get random 64-bit values that are weighted by powers of an odd base and summed up (mod 2^64). The hash of any substring
is then a difference of two sums, shifted back to its start. Values are constants drawn from a fixed seed, so all workers agree.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: Two independent hashes: values of the bytes and bases.
VALUES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)
BASES = [int(x) * 8 + 3 for x in _RNG.integers(1 << 40, 1 << 60, 2)]
MASK = (1 << 64) - 1
#: Powers that a worker keeps (16 MB for each hash).
KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64."""
    out = np.full(n, U(base & MASK))
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out) if n else out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits (the finaliser of a published 64-bit mixer, fixed values)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Substring hashes of one byte string. ``kind``: which of the two hashes."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, down = self._powers(kind, len(data) + 1)
        self.down = down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[kind][data] * up[:len(data)], out=self.sums[1:])

    @classmethod
    def _powers(cls, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, kept for the longest text so far of up to ``KEPT`` bytes."""
        known = cls._tables.get(kind)
        if known is None or len(known[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            known = powers(BASES[kind], size), powers(pow(BASES[kind], -1, 1 << 64), size)
            if size <= KEPT:
                cls._tables[kind] = known
        return known

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


#: Words whose hashes a worker remembers (some 25 MB).
KNOWN = 200_000


class WordHashes(dict):
    """A published 64-bit hash of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SEPARATOR[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, one without words none.
    ASCII letters are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split knows the same six separators
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    width = min(size, len(words))
    number = len(words) - width + 1
    out = words[:number] + U(width)
    for k in range(1, width):  # the words' hashes have no structure, so few terms need no mixing in between
        out *= U(0x9E3779B97F4A7C15)
        out += words[k:k + number]
    out = mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
