"""Fewest deletions under the continuous measure.

The plane of (reference, observation) is cut at vertices; an edge of the edited curve may skip
observed vertices and costs as many as it skips. Limits of free intervals are compared by ranks
that are exact: floats sort them, and those too close to tell are sorted as algebraic numbers.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cmp_to_key

import numpy as np

from vertexloom.kernels.exact import Root, closeness
from vertexloom.kernels.floatfrechet import _free
from vertexloom.kernels.floatfrechet import within as about_within
from vertexloom.kernels.intervals import Interval
from vertexloom.kernels.simplify import line_distances

_NONE = np.iinfo(np.int64).max


def _exact_interval(p, q, c, delta):
    """Free part of segment p-q around c: (lo, hi) as Root, or None."""
    fp, fq, fc = ([Fraction(float(x)) for x in y] for y in (p, q, c))
    u = [b - a for a, b in zip(fp, fq, strict=True)]
    w = [a - b for a, b in zip(fp, fc, strict=True)]
    a, b, k = sum(x * x for x in u), sum(x * y for x, y in zip(u, w, strict=True)), sum(x * x for x in w) - Fraction(delta) ** 2
    if a == 0:
        return (Root(0), Root(1)) if k <= 0 else None
    d = b * b - a * k
    if d < 0:
        return None
    lo, hi = Root(-b / a, -1, d / a**2), Root(-b / a, 1, d / a**2)
    zero, one = Root(0), Root(1)
    if lo.compare(one) > 0 or hi.compare(zero) < 0:
        return None
    return (zero if lo.compare(zero) < 0 else lo), (one if hi.compare(one) > 0 else hi)


def ranks(p: np.ndarray, q: np.ndarray, centres: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(lo, hi) ranks of the free intervals of segment p-q around each centre, and the rank of 1; 0 ranks 0. Empty: lo = _NONE, hi = -1."""
    n = len(centres)
    lo, hi = np.full(n, np.nan), np.full(n, np.nan)
    roots: dict[int, tuple[Root, Root] | None] = {}

    def exact(i: int):
        if i not in roots:
            roots[i] = _exact_interval(p, q, centres[i], delta)
        return roots[i]

    u, w = Interval(q) - p, Interval(p) - centres
    a, b = u.square().sum(), (w * u).sum()
    if a.lo > 0:
        d = b.square() - a * (w.square().sum() - Interval(delta).square())
        r = d.sqrt()
        low, high = (-b - r).over(a), (-b + r).over(a)
        unsure = d.holds(0.0) | ((d.lo > 0) & (low.holds(1.0) | high.holds(0.0)))
        empty = (d.hi < 0) | (low.lo > 1) | (high.hi < 0)
        lo, hi, spread = low.middle(), high.middle(), np.maximum(low.radius(), high.radius())
    else:
        unsure, empty, spread = np.ones(n, bool), np.ones(n, bool), np.zeros(n)
    for i in np.flatnonzero(unsure):
        got = exact(int(i))
        empty[i] = got is None
        if got:
            lo[i], hi[i] = (float(x.x) + x.s * float(x.y) ** 0.5 for x in got)
            spread[i] = max(spread[i], 1e-9 * (1 + abs(lo[i]) + abs(hi[i])))
    live = np.flatnonzero(~empty)
    # Ends of the segment are entries themselves.
    value = np.concatenate([[0.0, 1.0], np.clip(lo[live], 0, 1), np.clip(hi[live], 0, 1)])
    wide = np.concatenate([[0.0, 0.0], spread[live], spread[live]])
    owner = [None, None, *((int(i), 0) for i in live), *((int(i), 1) for i in live)]
    order = np.argsort(value, kind="stable")

    def number(e: int) -> Root:
        return Root(e) if owner[e] is None else exact(owner[e][0])[owner[e][1]]

    rank, at, seen = np.zeros(len(value), np.int64), 0, 0
    while at < len(order):
        to, top = at + 1, value[order[at]] + wide[order[at]]
        while to < len(order) and value[order[to]] - wide[order[to]] <= top:
            top = max(top, value[order[to]] + wide[order[to]])
            to += 1
        group = order[at:to].tolist()
        if len(group) > 1:
            group.sort(key=cmp_to_key(lambda x, y: number(x).compare(number(y))))
        for g, e in enumerate(group):
            if g and number(group[g - 1]).compare(number(e)) != 0:
                seen += 1
            rank[e] = seen
        seen += 1
        at = to
    out_lo, out_hi = np.full(n, _NONE), np.full(n, -1)
    out_lo[live], out_hi[live] = rank[2 : 2 + len(live)], rank[2 + len(live) :]
    return out_lo, out_hi, int(rank[1])


#: Bytes of edges' intervals that are kept for the next budget; others are computed again.
KEPT_BYTES = 64 << 20


def table_bytes(m: int, n: int, budget: int) -> int:
    """What within_budget keeps at most: places of the vertices that edges from one vertex reach, by cost, and the way back to each."""
    reach = min(budget, n - 1) + 1
    return 8 * reach * (2 * m + 4 * reach + m * reach + n * m)


def within_budget(ref: np.ndarray, obs: np.ndarray, delta: float, budget: int, segments=None, edges=None):
    """(cost, kept indices) of a cheapest deletion of at most budget vertices, or None."""
    m, n = len(ref), len(obs)
    budget = min(budget, n - 1)
    # The first kept vertex is among the first ones, and near the start; the last likewise.
    if not closeness(obs[: budget + 1], ref[0], delta).any() or not closeness(obs[n - 1 - budget :], ref[-1], delta).any():
        return None
    if m == 1:
        kept = np.flatnonzero(closeness(obs, ref[0], delta))
        return (n - len(kept), kept.tolist()) if len(kept) and n - len(kept) <= budget else None
    seg = segments if segments is not None else [ranks(ref[i], ref[i + 1], obs, delta) for i in range(m - 1)]
    edge = {} if edges is None else edges
    width = budget + 1
    most_kept = KEPT_BYTES // (16 * m)

    def open_edges(j: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Free intervals of the edges from vertex j around the reference's vertices, [step, vertex]."""
        found = [edge.get((j, step)) or ranks(obs[j], obs[j + step], ref, delta) for step in range(1, steps + 1)]
        edge.update({(j, step): f for step, f in enumerate(found, 1) if len(edge) < most_kept})
        return np.array([f[0] for f in found]), np.array([f[1] for f in found])

    # left[j][i, c]: least reachable rank on (vertex j, segment i) at cost c; back_step and back_from[j]: over how many vertices
    # it was reached (0: along vertex j), and from which segment. An edge's plane needs vertex j's places only, so vertices go one by one.
    left: dict[int, np.ndarray] = {}
    back_step: dict[int, np.ndarray] = {}
    back_from: dict[int, np.ndarray] = {}

    def place(j: int) -> None:
        if j not in left:
            left[j] = np.full((m - 1, width), _NONE)
            back_step[j], back_from[j] = np.full((m - 1, width), -1, np.int32), np.zeros((m - 1, width), np.int32)

    best = None
    for j in range(n):
        if j < width and seg[0][0][j] == 0:
            place(j)
            left[j][0, j], back_step[j][0, j] = 0, -1
        if j not in left:
            continue
        mine = left.pop(j)
        for i in range(m - 1):
            live = np.flatnonzero(mine[i] != _NONE)
            if not len(live) or seg[i][1][j] != seg[i][2]:
                continue
            if i < m - 2:
                mine[i + 1, live] = 0
                back_step[j][i + 1, live], back_from[j][i + 1, live] = 0, i
            elif int(live[0]) + n - 1 - j <= budget and (best is None or int(live[0]) + n - 1 - j < best[0]):
                best = (int(live[0]) + n - 1 - j, j, int(live[0]))
        steps = min(width, n - 1 - j)
        alive = (mine != _NONE).any(axis=1)
        if not steps or not alive.any():
            continue
        e_lo, e_hi = open_edges(j, steps)
        low, low_from = np.full((steps, width), _NONE), np.zeros((steps, width), np.int64)
        to = slice(j + 1, j + 1 + steps)
        for i in range(int(np.argmax(alive)), m - 1):
            under = (low != _NONE).any()
            if not alive[i] and not under:
                continue
            lo, hi, live = seg[i][0][to][:, None], seg[i][1][to][:, None], (mine[i] != _NONE)[None, :]
            # Across: all that is free from below, what lies after the entry from the left.
            enter = np.maximum(mine[i][None, :], lo)
            across = np.where(live & (enter <= hi), enter, _NONE)
            via_below = (low != _NONE) & (hi >= 0) & (lo < across)
            across = np.where(via_below, lo, across)
            for s in np.flatnonzero((across != _NONE).any(axis=1)).tolist():
                if s >= width:
                    break
                k = j + 1 + s
                place(k)
                better = np.flatnonzero(across[s, : width - s] < left[k][i, s:])
                left[k][i, better + s] = across[s, better]
                back_step[k][i, better + s], back_from[k][i, better + s] = s + 1, np.where(via_below[s, better], low_from[s, better], i)
            # Up: all that is free from the left, what lies after the entry from below.
            t_lo, t_hi = e_lo[:, i + 1][:, None], e_hi[:, i + 1][:, None]
            up = np.maximum(low, t_lo)
            up = np.where((low != _NONE) & (up <= t_hi), up, _NONE)
            side = np.where(live & (t_hi >= 0), t_lo, _NONE)
            low, low_from = np.minimum(up, side), np.where(side <= up, i, low_from)
    if best is None:
        return None
    total, j, c = best
    kept, i = [j], m - 2
    while back_step[j][i, c] >= 0:
        step, i = int(back_step[j][i, c]), int(back_from[j][i, c])
        if step:
            j, c = j - step, c - step + 1
            kept.append(j)
    return total, kept[::-1]


def surely_far(ref: np.ndarray, obs: np.ndarray, delta: float) -> np.ndarray:
    """Which vertices of obs are farther from ref than delta beyond all rounding: each must go."""
    scale = max(1.0, float(np.abs(ref).max()), float(np.abs(obs).max()))
    return line_distances(obs, ref) > delta * (1 + 1e-9) + 1e-9 * scale


def _margin(ref: np.ndarray, obs: np.ndarray, delta: float) -> float | None:
    """How far delta must be moved for decisions in floats to be sure; None where they can't be.

    Moved by x, the root of an interval's limit changes by about 2 * delta * x, far more than the rounding of squares.
    """
    scale = max(1.0, float(np.abs(ref).max()), float(np.abs(obs).max()))
    return 1e-6 * scale if 1e-5 * scale < delta < 1e100 and scale < 1e100 else None


#: Free intervals of edges that a decision in floats may look at.
MOST_FLOATS = 4_000_000


def surely_none(ref: np.ndarray, obs: np.ndarray, delta: float, most: int) -> bool:
    """Whether certainly no deletion of at most `most` vertices in a row and at either end reaches the tolerance: within_budget's plane in floats, a little wider and without costs."""
    m, n = len(ref), len(obs)
    reach = min(most, n - 1) + 1
    margin = _margin(ref, obs, delta)
    if m == 1 or n == 1 or margin is None or n * reach * m > MOST_FLOATS:
        return False
    wide = delta + margin
    lo, hi = _free(ref[:-1], ref[1:], obs, wide)
    a, s = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(reach), indexing="ij"))
    fits = a + s + 1 < n
    a, s = a[fits], s[fits]
    e_lo, e_hi = np.full((m, n, reach), np.inf), np.full((m, n, reach), -np.inf)
    x, y = _free(obs[a], obs[a + s + 1], ref, wide)
    e_lo[:, a, s], e_hi[:, a, s] = x.T, y.T
    carry = np.full(n, np.inf)
    carry[:reach] = np.where(lo[0, :reach] == 0, 0.0, np.inf)
    low = np.full((n, reach), np.inf)
    for i in range(m - 1):
        left, carry, later = carry, np.full(n, np.inf), np.full((n, reach), np.inf)
        some = (low < np.inf).any(axis=1)
        for j in range(n):
            live = left[j] < np.inf
            if live and hi[i, j] == 1:
                carry[j] = 0.0
                if i == m - 2 and n - 1 - j <= most:
                    return False
            steps = min(reach, n - 1 - j)
            if not steps or not (live or some[j]):
                continue
            below, t_lo, t_hi, to = low[j, :steps], e_lo[i + 1, j, :steps], e_hi[i + 1, j, :steps], slice(j + 1, j + 1 + steps)
            if live:
                later[j, :steps] = np.where(t_hi >= 0, t_lo, np.inf)
                enter = np.maximum(left[j], lo[i, to])
                left[to] = np.minimum(left[to], np.where(enter <= hi[i, to], enter, np.inf))
            if some[j]:
                up = np.maximum(below, t_lo)
                later[j, :steps] = np.minimum(later[j, :steps], np.where(up <= t_hi, up, np.inf))
                left[to] = np.minimum(left[to], np.where((below < np.inf) & (hi[i, to] >= 0), lo[i, to], np.inf))
        low = later
    return True


def fewest_deletions(ref: np.ndarray, obs: np.ndarray, delta: float, most: int | None = None, witness: bool = False, most_bytes: int | None = None) -> dict:
    """status, cost, budgets tried, and with witness the edits and edited curve. Budgets double from the number of vertices that must go, up to the discrete cost. Curves of any size are solved; a caller may state most_bytes, and a budget whose tables would exceed it is refused then."""
    from vertexloom.kernels.discrete import Plane

    n = len(obs)
    cap = n - 1 if most is None else min(most, n - 1)
    upper = Plane(ref, obs, delta, "delete").cost
    ceiling = cap if upper is None else min(cap, upper)
    out = {"status": "optimal", "cost": None, "witness_status": "not_requested", "edits": [], "edited_curve": [], "coupling": [], "budgets_tried": [], "detail": "", "counters": {}}
    edges: dict = {}
    # Budgets below the number of vertices that must go can't succeed.
    far = surely_far(ref, obs, delta)
    budget = int(far.sum())
    full = cap >= n - 1
    if budget > ceiling:
        return out | {"status": "infeasible" if full or budget == n else "budget_exceeded", "detail": f"{budget} vertices are too far from the reference"}
    got = None
    margin = _margin(ref, obs, delta)
    if margin is not None:
        # With that budget those vertices go and no others: floats mostly tell whether that is enough, or nothing is.
        rest = obs[~far]
        if about_within(ref, rest, delta - margin):
            out["budgets_tried"].append(budget)
            got = budget, np.flatnonzero(~far).tolist()
        elif upper is None and surely_none(ref, obs, delta, ceiling):
            return out | {"status": "infeasible" if full else "budget_exceeded", "detail": "no subsequence reaches the tolerance" if full else f"more than {cap} deletions are needed"}
        elif budget < ceiling and not about_within(ref, rest, delta + margin):
            out["budgets_tried"].append(budget)
            budget = max(1, 2 * budget)
    seg = [ranks(ref[i], ref[i + 1], obs, delta) for i in range(len(ref) - 1)] if got is None else []
    while got is None:
        budget = min(budget, ceiling)
        if most_bytes is not None and table_bytes(len(ref), n, budget) > most_bytes:
            return out | {"status": "memory_exceeded", "detail": f"more than {out['budgets_tried'][-1] if out['budgets_tried'] else -1} deletions are needed; tables for {budget} would take more than {most_bytes} bytes"}
        out["budgets_tried"].append(budget)
        got = within_budget(ref, obs, delta, budget, seg, edges)
        if got is not None:
            break
        if budget >= ceiling:
            return out | {"status": "infeasible" if full else "budget_exceeded", "detail": "no subsequence reaches the tolerance" if full else f"more than {cap} deletions are needed"}
        budget = max(1, 2 * budget)
    out["cost"], kept = got
    out["counters"] = {"budgets": len(out["budgets_tried"]), "edges": len(edges)}
    if witness:
        gone = [j for j in range(n) if j not in set(kept)]
        out |= {"witness_status": "certified", "edits": [{"op": "delete", "index": j, "gap": None, "ord": None, "point": None} for j in gone], "edited_curve": obs[kept].tolist()}
    return out
