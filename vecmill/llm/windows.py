"""Rolling hashes over bytes and content-defined anchors, in numpy, for repeated-window search."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix_int(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


VALUES = [np.array([_mix_int(1 + b + 256 * i + 0x1234567) for b in range(256)], np.uint64) for i in range(2)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as texts ask for them."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up = np.cumprod(np.concatenate([self.up[:1], np.full(size - 1, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([self.up[:1], np.full(size - 1, self.inverse, np.uint64)]))
        return self.up, self.down


POWERS = [Powers(b) for b in BASES]


class Rolling:
    """Polynomial hash, modulo 2^64, of any range of a byte string, or of 64-bit symbols, in constant time."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = POWERS[which].upto(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        values = VALUES[which][data] if data.dtype == np.uint8 else mixed(data + np.uint64(which))
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of `width` neighbours."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _M, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


_PLACE_BITS = 21
SEGMENT = (1 << _PLACE_BITS) - 4096


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of `width` neighbouring gram hashes: (place of the least gram, first and last window it is least in).

    Which gram is least (the rightmost of equals) depends on the window's own bytes alone, so equal windows anywhere
    have their anchor at the same distance.
    """
    place, first, last = [], [], []
    windows = len(grams) - width + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, windows, SEGMENT - width):
        part = grams[at : min(at + SEGMENT - width, windows) + width - 1]
        keys = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        m = (low - (sliding_least(keys, width) & low)).astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        place.append(m[begin] + at)
        first.append(begin + at)
        last.append(np.append(begin[1:], len(m)) - 1 + at)
    place, first, last = (np.concatenate(x) for x in (place, first, last))
    new = np.append(True, place[1:] != place[:-1])  # an anchor at a segment's border has windows in both segments
    return place[new], first[new], last[np.append(new[1:], True)]
