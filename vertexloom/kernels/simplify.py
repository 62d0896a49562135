"""Polyline simplification by farthest points, with limits on what it keeps and on the work it does."""

from __future__ import annotations

import heapq

import numpy as np

#: Vertex-to-chord distances one simplification may evaluate.
WORK = 40_000_000
#: The tolerance is halved up to six times.
TRIES = 7


def chord_distances(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = b - a
    size = float(v @ v)
    t = np.clip((points - a) @ v / size, 0.0, 1.0) if size > 0 else np.zeros(len(points))
    return np.linalg.norm(points - (a + t[:, None] * v), axis=1)


def significances(points: np.ndarray, floor: float, most: int, work: int = WORK) -> tuple[list[tuple[float, int]], float]:
    """([(significance, vertex)] in falling order, depth).

    A vertex is as significant as its distance from the chord of the span it splits, but no more than the vertices whose
    splits made that span, so those above a tolerance are the ones a split by farthest points keeps at that tolerance. The most significant
    span is split next, until none exceeds floor, there are over `most` vertices, or the work is used up; all
    vertices above depth are in the list.
    """
    found: list[tuple[float, int]] = []
    queue: list[tuple[float, int, int, int]] = []

    def measure(lo: int, hi: int, limit: float) -> None:
        nonlocal work
        work -= max(0, hi - lo - 1)
        if hi - lo > 1:
            far = chord_distances(points[lo + 1 : hi], points[lo], points[hi])
            k = int(far.argmax())
            heapq.heappush(queue, (-min(limit, float(far[k])), lo, lo + 1 + k, hi))

    measure(0, len(points) - 1, np.inf)
    while queue and -queue[0][0] > floor:
        if len(found) > most or work < 0:
            return found, -queue[0][0]
        value, lo, at, hi = heapq.heappop(queue)
        found.append((-value, at))
        measure(lo, at, -value)
        measure(at, hi, -value)
    return found, floor


def simplify_to(points: np.ndarray, most: int, tolerance: float, work: int = WORK) -> tuple[np.ndarray, float]:
    """(kept indices, tolerance used): at most `most` vertices at the least of tolerance, tolerance/2, ... that fits; 0 for short curves."""
    if len(points) <= most:
        return np.arange(len(points)), 0.0
    steps = [tolerance / 2**k for k in range(TRIES)]
    found, depth = significances(points, steps[-1], most, work)
    fitting = [t for t in steps if t >= depth and sum(s > t for s, _ in found) + 2 <= most]
    if not fitting:
        why = f"moves more than {tolerance:.1f}" if len(found) > most else "work budget used up"
        raise ValueError(f"a course of {len(points)} vertices can't be cut to {most}: {why}")
    least = min(fitting)
    return np.array(sorted([0, len(points) - 1, *(i for s, i in found if s > least)])), least


def line_distances(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to a polyline, which may be a single vertex."""
    if len(line) == 1:
        return np.linalg.norm(points - line[0], axis=1)
    least = np.full(len(points), np.inf)
    for a, b in zip(line[:-1], line[1:], strict=True):
        np.minimum(least, chord_distances(points, a, b), out=least)
    return least
