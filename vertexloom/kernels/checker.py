"""Independent decision of the continuous measure, for checking results; shares no code with the solvers."""

from __future__ import annotations

from fractions import Fraction as Q


class _Cut:
    """A limit m + s*sqrt(d), compared exactly with others by narrowing rational bounds."""

    def __init__(self, m: Q, s: int, d: Q):
        self.m, self.s, self.d = m, s, d

    def bounds(self, bits: int) -> tuple[Q, Q]:
        from math import isqrt

        scale = 1 << (2 * bits)
        root = isqrt(self.d.numerator * self.d.denominator * scale)
        lo, hi = Q(root, self.d.denominator << bits), Q(root + 1, self.d.denominator << bits)
        return (self.m + lo, self.m + hi) if self.s > 0 else (self.m - hi, self.m - lo)


def _le(a, b) -> bool:
    if isinstance(a, Q) and isinstance(b, Q):
        return a <= b
    if isinstance(a, _Cut) and isinstance(b, _Cut) and a.d and (a.m, a.d) == (b.m, b.d):
        return a.s <= b.s
    for bits in (64, 256, 1024):
        (a0, a1), (b0, b1) = (x.bounds(bits) if isinstance(x, _Cut) else (x, x) for x in (a, b))
        if a1 <= b0:
            return True
        if a0 > b1:
            return False
    return _difference_sign(a, b) <= 0


def _difference_sign(a, b) -> int:
    """Exact sign of a - b: of x + u*sqrt(p) + v*sqrt(q) with u, v of -1, 0, 1.

    With A = x + u*sqrt(p) and B = -v*sqrt(q) it is that of A - B; where both have one sign, that of A*A - B*B, which holds
    one root, decides, and that again by squares.
    """
    root = lambda z: (z.m, z.s, z.d) if isinstance(z, _Cut) else (z, 0, Q(0))
    (m, u, p), (n, v, q) = root(a), root(b)

    def one(x: Q, c: Q, y: Q) -> int:  # sign of x + c*sqrt(y)
        c = c if y else Q(0)
        if c == 0 or x == 0 or (x > 0) == (c > 0):
            lead = x if x else c
            return (lead > 0) - (lead < 0)
        gap = x * x - c * c * y
        return ((gap > 0) - (gap < 0)) * (1 if x > 0 else -1)

    x = m - n
    left, right = one(x, Q(u), p), (v if q else 0)
    if left != right or left == 0:
        return (left > right) - (left < right)
    return left * one(x * x + u * u * p - v * v * q, 2 * x * u, p)


def _free(p, q, c, r2):
    u, w = [b - a for a, b in zip(p, q, strict=True)], [a - b for a, b in zip(p, c, strict=True)]
    a, b, k = sum(x * x for x in u), sum(x * y for x, y in zip(u, w, strict=True)), sum(x * x for x in w) - r2
    if a == 0:
        return (Q(0), Q(1)) if k <= 0 else None
    d = (b * b - a * k) / (a * a)
    if d < 0:
        return None
    if d == 0:
        t = -b / a
        return (t, t) if 0 <= t <= 1 else None
    lo, hi = _Cut(-b / a, -1, d), _Cut(-b / a, 1, d)
    if not _le(lo, Q(1)) or not _le(Q(0), hi):
        return None
    return (Q(0) if _le(lo, Q(0)) else lo), (Q(1) if _le(Q(1), hi) else hi)


def continuous_within(a, b, delta: float) -> bool:
    """Whether the continuous distance of curves a and b is at most delta."""
    a, b = ([[Q(float(x)) for x in p] for p in c] for c in (a, b))
    r2 = Q(delta) ** 2
    close = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) <= r2
    if len(a) == 1 or len(b) == 1:
        return all(close(p, q) for p in a for q in b)
    if not close(a[0], b[0]) or not close(a[-1], b[-1]):
        return False
    m, n = len(a) - 1, len(b) - 1
    bottom: list = [None] * m  # reachable part of segment i of a at vertex j of b
    for i in range(m):
        if i and (bottom[i - 1] is None or bottom[i - 1][1] != Q(1)):
            break
        f = _free(a[i], a[i + 1], b[0], r2)
        bottom[i] = f if f is not None and f[0] == Q(0) else None
    left0 = True
    for j in range(n):
        f = _free(b[j], b[j + 1], a[0], r2) if left0 else None
        left = f if left0 and f is not None and f[0] == Q(0) else None
        left0 = left is not None and left[1] == Q(1)
        top: list = [None] * m
        for i in range(m):
            if left is None and bottom[i] is None:
                continue  # nothing enters this cell
            ft, fr = _free(a[i], a[i + 1], b[j + 1], r2), _free(b[j], b[j + 1], a[i + 1], r2)
            new_top = new_right = None
            if ft is not None:
                if left is not None:
                    new_top = ft
                elif bottom[i] is not None and _le(bottom[i][0], ft[1]):
                    new_top = (bottom[i][0] if _le(ft[0], bottom[i][0]) else ft[0], ft[1])
            if fr is not None:
                if bottom[i] is not None:
                    new_right = fr
                elif left is not None and _le(left[0], fr[1]):
                    new_right = (left[0] if _le(fr[0], left[0]) else fr[0], fr[1])
            top[i], left = new_top, new_right
        bottom = top
    return (bottom[-1] is not None and bottom[-1][1] == Q(1)) or (left is not None and left[1] == Q(1))
