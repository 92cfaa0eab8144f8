"""64-bit hashes of many byte spans at once."""

from __future__ import annotations

import numpy as np

#: the smallest table of powers made; larger inputs make larger ones
_LEAST = 1 << 20


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, n: int):
        base = 0x9E3779B97F4A7C15
        self.up, self.down = (np.cumprod(np.array([1] + [b] * n, np.uint64))
                              for b in (base, pow(base, -1, 1 << 64)))
        self.sign = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_made: list[_Powers] = []


def _powers(n: int) -> _Powers:
    """The worker's one table of powers, made anew when a larger one is needed."""
    if not _made or len(_made[0].up) <= n:
        _made[:] = [_Powers(n)]
    return _made[0]


class Spans:
    """Hashes of spans of ``data``: equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.p = _powers(max(_LEAST, 1 << len(data).bit_length()))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.p.sign[data] * self.p.up[:len(data)], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.p.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))

    def of_length(self, n: int) -> np.ndarray:
        """For the span of length ``n`` at every place where one fits."""
        k = max(0, len(self.total) - n)
        return mixed((self.total[n:] - self.total[:k]) * self.p.down[:k] + np.uint64(n))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` for each span, equal for equal bytes."""
    return Spans(data).hashes(starts, ends)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
