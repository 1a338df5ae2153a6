"""Words of many texts at once, as arrays over one byte string (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .rolling import Rolling, mixed

#: Texts are taken together up to about so many bytes, and hashed so many words at a time.
GROUP_BYTES, STEP = 2 << 20, 1 << 20
#: Words whose bytes are hashed together: the powers that this takes stay in memory.
CODED = 1 << 16


def grouped(texts: Iterator[tuple], size: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """The tuples, whose last item is bytes, in lists of about size bytes; a longer text is a list of its own."""
    held: list[tuple] = []
    n = 0
    for t in texts:
        if held and n + len(t[-1]) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t[-1])
    if held:
        yield held


def table_of(separators: bytes) -> np.ndarray:
    """By byte, whether it is one of these."""
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


def words(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no separators (a table of 256)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number of each word, the same wherever it stands."""
    out = np.empty(len(start), dtype=np.uint64)
    for lo in range(0, len(start), CODED):
        s, e = start[lo : lo + CODED], end[lo : lo + CODED]
        out[lo : lo + CODED] = Rolling(data[s[0] : e[-1]]).hashes(s - s[0], e - s[0])
    return out


class Stretches:
    """Rabin-Karp hashes of any stretch of a row of numbers: sums of number times a power of the base, modulo 2 ** 64."""

    def __init__(self, numbers: np.ndarray, base: int):
        n = len(numbers)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(numbers * _powers(base, n), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _KNOWN.get(base)
    if have is None or len(have) < n:
        p = np.full(max(1 << 16, 1 << max(0, n - 1).bit_length()), base & ((1 << 64) - 1), dtype=np.uint64)
        p[0] = 1
        have = _KNOWN[base] = np.cumprod(p)
    return have[:n]
