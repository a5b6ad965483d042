"""Shingle sets and circulant MinHash signatures of texts (the numpy part of near-dedup).

Words: A-Z lower-cased, split at ASCII white space.  A text's set holds its distinct runs of
``WIDTH`` words, each as a 64-bit hash; a text of fewer words has its whole sequence as the one
member, a text without words the empty set.

Signatures follow the circulant scheme: one permutation (``mix``) of the hashed universe of 2**32
places is applied once; a second one gives every coordinate, its input shifted by the coordinate's
number around the circle.  Two sets agree in a coordinate with their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lectern.llm.words import Words, mix

WIDTH = 5
ROWS, BANDS = 5, 50
COORDINATES = ROWS * BANDS

_EMPTY = np.empty(0, np.uint64)
_CHUNK = 256
_odd = np.random.default_rng(7).integers(0, 2**63, WIDTH + BANDS + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _BAND, _ROW = _odd[:WIDTH], _odd[WIDTH : WIDTH + BANDS], _odd[WIDTH + BANDS :]
_SHIFT = np.arange(COORDINATES, dtype=np.uint32)[:, None]
_z, _t = np.empty((COORDINATES, _CHUNK), np.uint32), np.empty((COORDINATES, _CHUNK), np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    h = Words(text).hashes()
    if not len(h):
        return _EMPTY
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for i in range(width):
        s += h[i : n + i] * _PLACE[i]
    s = mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def signature(members: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set, 16 bits of each."""
    at = (mix(members) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), _CHUNK):
        part = at[i : i + _CHUNK]
        z, t = _z[:, : len(part)], _t[:, : len(part)]
        np.subtract(part[None, :], _SHIFT, out=z)  # around the circle
        np.multiply(z, np.uint32(0x7FEB352D), out=z)  # the second permutation
        np.right_shift(z, np.uint32(15), out=t)
        np.bitwise_xor(z, t, out=z)
        np.multiply(z, np.uint32(0x846CA68B), out=z)
        np.minimum(least, z.min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def bands(signatures: np.ndarray) -> np.ndarray:
    """For each signature (a row), one 64-bit key (int64) for each band of ``ROWS`` coordinates."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = (rows * _ROW[:ROWS]).sum(axis=2, dtype=np.uint64)
    return mix(key + _BAND).view(np.int64)


def names(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for the set together."""
    high, low = np.frombuffer(xxhash.xxh3_128_digest(members.tobytes()), ">i8").tolist()
    return high, low


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct members; empty sets are like nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
