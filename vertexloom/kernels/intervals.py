"""Arithmetic on arrays of closed intervals that surely hold the true values: every result is rounded one step outward."""

from __future__ import annotations

import numpy as np


def _down(x):
    return np.nextafter(x, -np.inf)


def _up(x):
    return np.nextafter(x, np.inf)


class Interval:
    """Elementwise lo <= value <= hi. Numbers and arrays of doubles are taken as exact."""

    __slots__ = ("hi", "lo")
    __array_ufunc__ = None  # so that an array on the left leaves the operation to this class

    def __init__(self, lo, hi=None):
        self.lo = np.asarray(lo, np.float64)
        self.hi = self.lo if hi is None else np.asarray(hi, np.float64)

    @staticmethod
    def of(x) -> Interval:
        return x if isinstance(x, Interval) else Interval(x)

    def __neg__(self) -> Interval:
        return Interval(-self.hi, -self.lo)

    def __add__(self, other) -> Interval:
        o = Interval.of(other)
        return Interval(_down(self.lo + o.lo), _up(self.hi + o.hi))

    __radd__ = __add__

    def __sub__(self, other) -> Interval:
        return self + -Interval.of(other)

    def __rsub__(self, other) -> Interval:
        return Interval.of(other) + -self

    def __mul__(self, other) -> Interval:
        o = Interval.of(other)
        ends = np.stack(np.broadcast_arrays(self.lo * o.lo, self.lo * o.hi, self.hi * o.lo, self.hi * o.hi))
        return Interval(_down(ends.min(axis=0)), _up(ends.max(axis=0)))

    __rmul__ = __mul__

    def square(self) -> Interval:
        low = np.maximum(0.0, np.maximum(self.lo, -self.hi))
        high = np.maximum(np.abs(self.lo), np.abs(self.hi))
        return Interval(np.maximum(0.0, _down(low * low)), _up(high * high))

    def sqrt(self) -> Interval:
        """Of the part that isn't negative."""
        return Interval(np.maximum(0.0, _down(np.sqrt(np.maximum(self.lo, 0.0)))), _up(np.sqrt(np.maximum(self.hi, 0.0))))

    def over(self, other) -> Interval:
        """Quotient by an interval above 0."""
        o = Interval.of(other)
        ends = np.stack(np.broadcast_arrays(self.lo / o.lo, self.lo / o.hi, self.hi / o.lo, self.hi / o.hi))
        return Interval(_down(ends.min(axis=0)), _up(ends.max(axis=0)))

    def sum(self) -> Interval:
        """Over the last axis, one value after another."""
        total = Interval(self.lo[..., 0], self.hi[..., 0])
        for i in range(1, self.lo.shape[-1]):
            total = total + Interval(self.lo[..., i], self.hi[..., i])
        return total

    def holds(self, x: float) -> np.ndarray:
        return (self.lo <= x) & (x <= self.hi)

    def middle(self) -> np.ndarray:
        return self.lo / 2 + self.hi / 2

    def radius(self) -> np.ndarray:
        """No less than the distance of middle from either end."""
        m = self.middle()
        return _up(np.maximum(_up(self.hi - m), _up(m - self.lo)))
