"""Vectorised rolling hashes over the characters of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so each has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(m, U(b & _MASK))
                steps[0] = U(1)
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in _BASES]


class Rolling:
    """Hashes of any slice of a code point array, after one prefix sum; *which* picks the base."""

    def __init__(self, points: np.ndarray, which: int) -> None:
        n = len(points)
        up, self.down = _POWERS[which].upto(n + 1)
        values = mix(points.astype(U) + U(0x51ED270B * (which + 1)))
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hash of the slice of *width* at every place."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(rows: Iterator[tuple], text_at: int, most: int = 400_000) -> Iterator[list[tuple]]:
    """Rows in lists of at most *most* characters of text, a longer text alone: arrays stay in cache."""
    held, size = [], 0
    for r in rows:
        n = len(r[text_at])
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held
