"""Hashes of any stretch of a byte array, from one running sum (numpy)."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2 ** 64, up to n at least."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """data: uint8. hashes(i, j) are those of data[i:j], the same wherever the bytes stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every stretch of size bytes, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))
