"""Closed comparisons decided in floating point where that is safe, in rationals where it isn't."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

_UNIT = 2.0**-53
_TINY = 2.0**-1070


class Ambiguous(Exception):
    """A decision that the chosen policy leaves open."""


#: Closeness decisions of this process so far: all, and those that needed rationals.
TALLY = {"points": 0, "exact": 0}


def near_rows(ref: np.ndarray, points: np.ndarray, delta: float, policy: str = "certified") -> np.ndarray:
    """near[j, i]: whether ref[i] lies within delta of points[j]."""
    d2 = np.zeros((len(points), len(ref)))
    for x, y in zip(ref.T, points.T, strict=True):
        d2 += (x[None, :] - y[:, None]) ** 2
    limit = delta * delta
    near = d2 <= limit
    TALLY["points"] += near.size
    if policy != "fast":
        dim = ref.shape[1]
        slack = 8.0 * (dim + 4) * _UNIT * (d2 + limit) + dim * 8 * _TINY
        for j, i in zip(*np.nonzero(~(np.abs(d2 - limit) > slack)), strict=True):
            near[j, i] = within(ref[i], points[j], delta)
            TALLY["exact"] += 1
    return near


def closeness(ref: np.ndarray, point: np.ndarray, delta: float, policy: str = "certified") -> np.ndarray:
    """Which rows of ref lie within delta of point."""
    return near_rows(ref, np.asarray(point)[None, :], delta, policy)[0]


def within(p, q, delta: float) -> bool:
    """Exactly |p - q| <= delta."""
    return sum((Fraction(float(a)) - Fraction(float(b))) ** 2 for a, b in zip(p, q, strict=True)) <= Fraction(delta) ** 2


def sign_of(x: Fraction, s: int, y: Fraction) -> int:
    """Sign of x + s * sqrt(y), y >= 0."""
    if s == 0 or y == 0:
        return (x > 0) - (x < 0)
    if x == 0:
        return s
    if (x > 0) == (s > 0):
        return s
    side = x * x - y
    return 0 if side == 0 else (1 if (side > 0) == (x > 0) else -1)


class Root:
    """A number x + s * sqrt(y)."""

    __slots__ = ("x", "s", "y")

    def __init__(self, x, s=0, y=0):
        self.x, self.s, self.y = Fraction(x), s if y else 0, Fraction(y)

    def compare(self, other: Root) -> int:
        x = self.x - other.x
        if not other.s:
            return sign_of(x, self.s, self.y)
        if not self.s:
            return sign_of(x, -other.s, other.y)
        # The sign of x + a where a = s1 sqrt(y1) - s2 sqrt(y2): that of a is known, and a*a has one root.
        if self.s != other.s:
            a = self.s
        else:
            a = self.s * ((self.y > other.y) - (self.y < other.y))
        if a == 0 or x == 0:
            return a if x == 0 else (x > 0) - (x < 0)
        if (x > 0) == (a > 0):
            return a
        gap = sign_of(x * x - self.y - other.y, self.s * other.s, 4 * self.y * other.y)
        return gap if x > 0 else -gap
