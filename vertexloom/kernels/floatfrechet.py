"""The continuous distance in floating point: decision over all cells at once per reference column, and bisection."""

from __future__ import annotations

import numpy as np


def _free(p: np.ndarray, q: np.ndarray, centres: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi)[segment, centre] of the part of each segment p-q within eps of each centre; empty: lo > hi."""
    u = q - p
    w = p[:, None, :] - centres[None, :, :]
    a = (u * u).sum(1)[:, None]
    b = (w * u[:, None, :]).sum(2)
    k = (w * w).sum(2) - eps * eps
    safe = np.where(a > 0, a, 1.0)
    d = b * b - a * k
    root = np.sqrt(np.maximum(d, 0))
    lo, hi = np.maximum((-b - root) / safe, 0.0), np.minimum((-b + root) / safe, 1.0)
    # An end that is itself close belongs to the interval whatever rounding says.
    end = ((q[:, None, :] - centres[None, :, :]) ** 2).sum(2) <= eps * eps
    lo, hi = np.where(k <= 0, 0.0, lo), np.where(end, 1.0, hi)
    none = ((d < 0) & (k > 0) & ~end) | (lo > hi)
    still = a == 0
    none = np.where(still, k > 0, none)
    return np.where(none, np.inf, np.where(still, 0.0, lo)), np.where(none, -np.inf, np.where(still, 1.0, hi))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the continuous distance is at most eps, up to rounding."""
    close = lambda p, q: float(((p - q) ** 2).sum()) <= eps * eps
    if len(a) == 1 or len(b) == 1:
        return bool((((a[:, None, :] - b[None, :, :]) ** 2).sum(2) <= eps * eps).all())
    if not close(a[0], b[0]) or not close(a[-1], b[-1]):
        return False
    m, n = len(a) - 1, len(b) - 1
    (blo, bhi), (llo, lhi) = (x for x in (_free(a[:-1], a[1:], b, eps), _free(b[:-1], b[1:], a, eps)))
    blo, bhi, llo, lhi = blo.tolist(), bhi.tolist(), llo.tolist(), lhi.tolist()
    far = float("inf")
    bottom, ok = [far] * m, True
    for i in range(m):
        ok = ok and blo[i][0] == 0
        bottom[i] = 0.0 if ok else far
        ok = ok and bhi[i][0] == 1
    side_ok = True
    right = far
    for j in range(n):
        side_ok = side_ok and llo[j][0] == 0
        left = 0.0 if side_ok else far
        side_ok = side_ok and lhi[j][0] == 1
        for i in range(m):
            below = bottom[i]
            if left < far:
                bottom[i] = blo[i][j + 1]
            elif below < far:
                x = max(below, blo[i][j + 1])
                bottom[i] = x if x <= bhi[i][j + 1] else far
            if below < far:
                left = llo[j][i + 1]
            elif left < far:
                x = max(left, llo[j][i + 1])
                left = x if x <= lhi[j][i + 1] else far
        right = left
    return (bottom[-1] < far and bhi[-1][n] == 1) or (right < far and lhi[-1][m] == 1)


def discrete(a: np.ndarray, b: np.ndarray) -> float:
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)).tolist()
    row = []
    for i, line in enumerate(d):
        new = []
        for j, x in enumerate(line):
            if i == 0:
                came = new[j - 1] if j else x
            else:
                came = min(row[j], row[j - 1], new[j - 1]) if j else row[0]
            new.append(max(x, came))
        row = new
    return row[-1]


def distance(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> float:
    """The continuous distance, from above to within tol: never over the discrete one, which bounds it."""
    lo = max(float(np.linalg.norm(a[0] - b[0])), float(np.linalg.norm(a[-1] - b[-1])))
    hi = discrete(a, b)
    if lo >= hi or within(a, b, lo):
        return min(lo, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        if hi - lo <= tol or mid in (lo, hi):
            break
        lo, hi = (lo, mid) if within(a, b, mid) else (mid, hi)
    return hi
