"""Vectorised 64-bit hashes of byte strings for use inside tasks (numpy only).

All of them depend on nothing but the bytes and fixed seeds, so that every executor and
every later run agrees.  Sums wrap at 2**64.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Spans:
    """Hashes of any spans of one byte buffer, from prefix sums of a polynomial."""

    #: Powers for buffers up to so many bytes are kept; longer ones would stay with idle workers.
    KEPT = 1 << 21

    _powers = _negative = np.ones(1, dtype=np.uint64)

    def __init__(self, buffer: bytes | np.ndarray):
        data = np.frombuffer(buffer, dtype=np.uint8) if isinstance(buffer, (bytes, bytearray)) else buffer
        powers, self.negative = self.reserve(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers[: len(data)], out=self.sums[1:])

    @classmethod
    def reserve(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least ``n`` powers of the base and of its inverse."""
        if len(cls._powers) >= n:
            return cls._powers, cls._negative
        size = min(max(n, 2 * len(cls._powers)), cls.KEPT) if n <= cls.KEPT else n
        step, back = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        step[0] = back[0] = 1
        found = np.cumprod(step), np.cumprod(back)
        if n <= cls.KEPT:
            cls._powers, cls._negative = found
        return found

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of buffer[start:end] for arrays of bounds; spans of other lengths differ."""
        raw = (self.sums[end] - self.sums[start]) * self.negative[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def as_long(x: np.ndarray) -> np.ndarray:
    """The same bits as a signed number, which is what Spark stores."""
    return x.view(np.int64)
