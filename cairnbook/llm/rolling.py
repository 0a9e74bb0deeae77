"""Hashes of all windows of a sequence, and the windows' anchors (numpy)."""

from __future__ import annotations

import numpy as np

_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20)
#: A random odd 64-bit number for each byte value.
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """``part(a, b)``: hash of items ``a`` to ``b`` (exclusive), whatever stands before them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _powers(_BACK, n + 1)

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window that begins at each position, the last ``size - 1`` left out."""
        many = len(self.sums) - size
        if many <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:many]) * self.back[:many])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (one to one)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_AT = np.uint64((1 << 24) - 1)


def anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """Of each ``reach`` consecutive grams the place of the least hash, the last of equals.

    Equal stretches choose the same place, wherever they stand; at most 2^24 grams at a time.
    """
    n = len(grams)
    many = n - reach + 1
    if many <= 0:
        return np.empty(0, np.int64)
    key = (grams & ~_AT) | (_AT - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // reach) * reach, np.uint64(2**64 - 1))
    padded[:n] = key
    rows = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:many], ahead[reach - 1:reach - 1 + many])
    return (_AT - (least & _AT)).astype(np.int64)
