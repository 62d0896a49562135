"""Exact smallest enclosing balls of small point sets in any dimension."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np

from vertexloom.kernels.exact import Ambiguous, within

#: Blocks of more points than this are left undecided in two or more dimensions if no quick certificate holds.
MOST_POINTS = 48


def _dot(a, b) -> Fraction:
    return sum((x * y for x, y in zip(a, b, strict=True)), Fraction(0))


def _through(points: list[list[Fraction]]) -> tuple[list[Fraction], Fraction] | None:
    """Smallest ball with all points on its surface; None if they are affinely dependent.

    The centre starts at the first point and takes in one point after another: it moves at right angles to all directions
    so far, which keeps it equally far from the points it has, until the new one is as far.
    """
    start, centre = points[0], points[0]
    axes: list[list[Fraction]] = []
    for p in points[1:]:
        axis = [x - y for x, y in zip(p, start, strict=True)]
        for u in axes:
            share = _dot(axis, u) / _dot(u, u)
            axis = [x - share * y for x, y in zip(axis, u, strict=True)]
        square = _dot(axis, axis)
        if not square:
            return None
        step = (_gap(p, centre) - _gap(start, centre)) / (2 * square)
        centre = [x + step * y for x, y in zip(centre, axis, strict=True)]
        axes.append(axis)
    return centre, _gap(start, centre)


def _gap(p, centre) -> Fraction:
    return sum(((x - y) ** 2 for x, y in zip(p, centre, strict=True)), Fraction(0))


def enclosing(points: np.ndarray) -> tuple[list[Fraction], Fraction]:
    """(centre, squared radius), exact.

    Grows a basis: as long as a point lies outside, the ball of the basis with the farthest such
    point is found among the balls through its subsets. The radius grows each time, so this ends.
    """
    exact = [[Fraction(float(x)) for x in p] for p in np.unique(points, axis=0)]
    dim = points.shape[1]
    if dim == 1:
        lo, hi = exact[0][0], exact[-1][0]
        return [(lo + hi) / 2], ((hi - lo) / 2) ** 2
    basis, centre, radius = [exact[0]], exact[0], Fraction(0)
    while True:
        far = max(exact, key=lambda p: _gap(p, centre))
        if _gap(far, centre) <= radius:
            return centre, radius
        pool, best = [*basis, far], None
        for size in range(2, min(len(pool), dim + 1) + 1):
            for others in combinations(pool[:-1], size - 1):
                got = _through([far, *others])
                if got and (best is None or got[1] < best[1]) and all(_gap(p, got[0]) <= got[1] for p in pool):
                    best = (got[0], got[1], [far, *others])
        centre, radius, basis = best


def _float_ball(points: np.ndarray) -> np.ndarray:
    """Centre of the smallest ball in floating point, by the same growth of a basis as in rationals. A proposal, never a decision."""
    dim = points.shape[1]
    basis, c, r2 = [points[0]], points[0], 0.0
    for _ in range(64):
        d2 = ((points - c) ** 2).sum(axis=1)
        far = points[int(np.argmax(d2))]
        if d2.max() <= r2 * (1 + 1e-12) + 1e-300:
            break
        pool, best = [*basis, far], None
        for size in range(2, min(len(pool), dim + 1) + 1):
            for others in combinations(pool[:-1], size - 1):
                v = np.array(others) - far
                shift = np.linalg.lstsq(v, (v * v).sum(axis=1) / 2, rcond=None)[0]
                rr = float(shift @ shift)
                if (best is None or rr < best[1]) and all(((p - far - shift) ** 2).sum() <= rr * (1 + 1e-9) for p in pool):
                    best = (far + shift, rr, [far, *others])
        if best is None or best[1] <= r2:
            break
        c, r2, basis = best
    return c


def _apart(points: np.ndarray, c: np.ndarray, delta: float) -> bool:
    """Certificate that no ball of radius delta holds the points: the exact ball of the few that are farthest from c."""
    few = points[np.argsort(-((points - c) ** 2).sum(axis=1))[: points.shape[1] + 1]]
    return enclosing(few)[1] > Fraction(delta) ** 2


def fits(points: np.ndarray, delta: float, policy: str = "certified") -> bool:
    """Whether one ball of radius delta holds all points."""
    if len(points) == 1:
        return True
    spread = points.max(axis=0) - points.min(axis=0)
    if points.shape[1] == 1:
        if policy == "fast":
            return bool(spread[0] <= 2 * delta)
        return Fraction(float(points.max())) - Fraction(float(points.min())) <= 2 * Fraction(delta)
    if (spread > 2 * delta * (1 + 1e-9)).any():
        return False
    mid = points.mean(axis=0)
    far = float(np.sqrt(((points - mid) ** 2).sum(axis=1).max()))
    if far <= delta * (1 - 1e-9):
        return True
    # No point of a ball's set lies farther from the mean than the diameter allows.
    if far > 2 * delta * (1 + 1e-9):
        return False
    c = _float_ball(points)
    far = float(np.sqrt(((points - c) ** 2).sum(axis=1).max()))
    if far <= delta * (1 - 1e-9):
        return True
    if far > delta * (1 + 1e-6) and _apart(points, c, delta):
        return False
    if len(points) > MOST_POINTS and policy != "fast":
        raise Ambiguous(f"the ball of {len(points)} points is too near to the limit")
    return enclosing(points)[1] <= Fraction(delta) ** 2


def reach(ref: np.ndarray, delta: float, policy: str = "certified") -> list[int]:
    """For each i the first t such that ref[t..i] fits one ball; never decreases."""
    out, t = [], 0
    for i in range(len(ref)):
        while not fits(ref[t : i + 1], delta, policy):
            t += 1
        out.append(t)
    return out


def centre(points: np.ndarray, delta: float) -> list[float] | None:
    """A floating-point centre from which every point is exactly within delta, or None if none is found near the exact one."""
    c = [float(x) for x in enclosing(points)[0]]
    steps = [[x, float(np.nextafter(x, -np.inf)), float(np.nextafter(x, np.inf))] for x in c]
    todo = [c] + [c[:i] + [v] + c[i + 1 :] for i in range(len(c)) for v in steps[i][1:]]
    if len(c) == 2:
        todo += [[x, y] for x in steps[0] for y in steps[1]]
    return next((x for x in todo if all(within(p, x, delta) for p in points)), None)
