"""Words of many texts at once in numpy: where they are and 64-bit hashes of them or of their beginnings."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.Philox(20240607))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Hash of data[a:b] for any a and b from prefix sums: a polynomial in an odd base over random byte values."""

    def __init__(self):
        self._up = self._down = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            self._up = _powers(_BASE, len(data) + len(data) // 8 + 1)
            self._down = _powers(pow(_BASE, -1, 1 << 64), len(data) + len(data) // 8 + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self._down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, a newline after each, and where each begins (one more: the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.cumsum([0, *(len(t) + 1 for t in texts)])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    return edge[::2], edge[1::2]
