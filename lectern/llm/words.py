"""Vectorised hashes of the words of a text.

A byte's random 64-bit value is weighted by a power of an odd number, and prefix sums turn any
stretch of bytes into one subtraction and one multiplication (mod 2**64), wherever it stands.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240501)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
#: Values of bytes: A-Z like a-z, white space (0x20, 0x09-0x0D) none.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n or more of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(14, n.bit_length())
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _BACK)]
    return _powers


class Words:
    """Where the words of a text start and end (in UTF-8 bytes), and their hashes."""

    def __init__(self, text: str | None, outside: np.ndarray = _SPACE):
        data = np.frombuffer((text or "").encode(), np.uint8)
        out = np.ones(len(data) + 2, bool)
        out[1:-1] = outside[data]
        edge = np.flatnonzero(out[1:] != out[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        up, self._down = _tables(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self._sum[1:])

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of the stretches from start to end."""
        start, end = self.start if start is None else start, self.end if end is None else end
        return (self._sum[end] - self._sum[start]) * self._down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
