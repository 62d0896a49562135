"""Measures of many pairs of curves at once.

Pairs are padded to common lengths and their dynamic programs run side by side: one step fills a cell, or a whole
column of cells, of every pair. Arrays are [vertex, pair] so that each step reads and writes neighbouring memory.
"""

from __future__ import annotations

import numpy as np

from vertexloom.kernels.exact import _TINY, _UNIT, within

FAR = np.inf
NEVER = 1 << 29
#: Cells (longest reference by longest observation by pairs) that one group of pairs may pad to.
GROUP_CELLS = 1 << 22


class Pairs:
    """A group of pairs: a [m, pair, dim] and b [n, pair, dim] padded with zeros, and their lengths."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray]):
        self.a, self.la = padded(a)
        self.b, self.lb = padded(b)

    @classmethod
    def against(cls, a: np.ndarray, la: np.ndarray, b: np.ndarray) -> Pairs:
        """Padded curves, each paired with the same b, which isn't copied."""
        p = cls.__new__(cls)
        p.a, p.la = a, la
        p.b, p.lb = np.broadcast_to(b[:, None, :], (len(b), a.shape[1], a.shape[2])), np.full(a.shape[1], len(b))
        return p

    def squares(self, j: int) -> np.ndarray:
        """[m, pair] squared distances of a's vertices to vertex j of b."""
        if self.a.shape[2] == 1:
            d = self.a[:, :, 0] - self.b[j, :, 0][None]
            return np.multiply(d, d, out=d)
        d = self.a - self.b[j][None]
        return (d * d).sum(axis=2)

    def near(self, j: int, delta: float) -> np.ndarray:
        """Which are at most delta, decided exactly where rounding could matter."""
        if self.a.shape[2] == 1:  # one rounding, which can move a difference onto delta but not across it
            d = np.abs(self.a[:, :, 0] - self.b[j, :, 0][None])
            near = d <= delta
            for i, k in zip(*np.nonzero(d == delta), strict=True):
                near[i, k] = within(self.a[i, k], self.b[j, k], delta)
            return near
        d2, limit = self.squares(j), delta * delta
        dim = self.a.shape[2]
        slack = 8.0 * (dim + 4) * _UNIT * (d2 + limit) + dim * 8 * _TINY
        near = d2 <= limit
        for i, k in zip(*np.nonzero(~(np.abs(d2 - limit) > slack)), strict=True):
            near[i, k] = within(self.a[i, k], self.b[j, k], delta)
        return near

    def near_rounded(self, j: int, delta: float) -> np.ndarray:
        """Which are at most delta by their distance as double precision gives it."""
        if self.a.shape[2] == 1:
            return np.abs(self.a[:, :, 0] - self.b[j, :, 0][None]) <= delta
        return np.sqrt(self.squares(j)) <= delta

    def fold(self, first: np.ndarray, step) -> np.ndarray:
        """The last cell of every pair. step(column, j) gives the column after vertex j; a column has a head and a cell per vertex of a."""
        pair = np.arange(len(self.la))
        out, column = first[self.la, pair].copy(), first
        for j in range(len(self.b)):
            column = step(column, j)
            done = self.lb == j + 1
            out[done] = column[self.la[done], pair[done]]
        return out

    def first(self, value, dtype=np.float64) -> np.ndarray:
        """A column of value under a head of 0."""
        column = np.full((len(self.a) + 1, len(self.la)), value, dtype)
        column[0] = 0
        return column


def padded(curves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(c) for c in curves], np.int64)
    out = np.zeros((int(n.max()), len(curves), curves[0].shape[1]))
    for k, c in enumerate(curves):
        out[: len(c), k] = c
    return out, n


def frechet(p: Pairs) -> np.ndarray:
    """Least maximal distance over monotone couplings."""

    def step(column, j):
        d, new = np.sqrt(p.squares(j)), np.empty_like(column)
        new[0] = FAR
        came = np.minimum(column[:-1], column[1:])
        for i in range(len(d)):
            np.maximum(d[i], np.minimum(came[i], new[i]), out=new[i + 1])
        return new

    return p.fold(p.first(FAR), step)


def dtw(p: Pairs) -> np.ndarray:
    """Least sum of distances."""

    def step(column, j):
        d, new = np.sqrt(p.squares(j)), np.empty_like(column)
        new[0] = FAR
        came = np.minimum(column[:-1], column[1:])
        for i in range(len(d)):
            np.add(d[i], np.minimum(came[i], new[i]), out=new[i + 1])
        return new

    return p.fold(p.first(FAR), step)


def dtw_normalized(p: Pairs) -> np.ndarray:
    """dtw by the length of its path; of equal ways the diagonal goes first, then the same vertex of b, then that of a."""
    long: list = [p.first(0)]

    def step(column, j):
        d, new, count = np.sqrt(p.squares(j)), np.empty_like(column), np.zeros_like(column)
        new[0] = FAR
        before = long[0]
        for i in range(len(d)):
            cost = [column[i], new[i], column[i + 1]]
            diagonal = (cost[0] <= cost[1]) & (cost[0] <= cost[2])
            way = np.where(diagonal, 0, np.where(cost[1] <= cost[2], 1, 2))
            new[i + 1] = np.choose(way, cost) + d[i]
            count[i + 1] = np.choose(way, [before[i], count[i], before[i + 1]]) + 1
        long[0] = count
        done = p.lb == j + 1
        steps[done] = count[p.la[done], np.flatnonzero(done)]
        return new

    steps = np.ones(len(p.la))
    return p.fold(p.first(FAR), step) / steps


#: Vertices of a reference that fit a word beside its head.
WORD = 62
_ONE = np.uint64(1)


def _bits(near: np.ndarray) -> np.ndarray:
    """Each column of [vertex, pair] as one word, vertex 0 in its lowest bit."""
    out = np.zeros(near.shape[1], np.uint64)
    for k in range(0, len(near), 24):  # sums of different powers of two that single precision holds exactly
        some = near[k : k + 24].astype(np.float32)
        out |= (2 ** np.arange(len(some), dtype=np.float32) @ some).astype(np.uint64) << np.uint64(k)
    return out


def _edr_words(p: Pairs, eps: float) -> np.ndarray:
    """edr() of references that fit a word: differences of neighbouring cells of a column as bits (Myers, Hyyrö)."""
    last = (p.la - 1).astype(np.uint64)
    score = p.la.astype(np.int64)
    rise, fall = np.full(len(p.la), ~np.uint64(0)), np.zeros(len(p.la), np.uint64)
    done = np.zeros_like(score)
    for j in range(len(p.b)):
        equal = _bits(p.squares(j) <= eps * eps)
        flat = (((equal & rise) + rise) ^ rise) | equal | fall
        up, down = fall | ~(flat | rise), flat & rise
        score = score + ((up >> last) & _ONE).astype(np.int64) - ((down >> last) & _ONE).astype(np.int64)
        up, down = (up << _ONE) | _ONE, down << _ONE
        rise, fall = down | ~(flat | up), up & flat
        done = np.where(p.lb == j + 1, score, done)
    return done


def _delete_words(p: Pairs, near) -> np.ndarray:
    """edit_cost() by deletion for references that fit a word and one observation: at each cost the reachable cells of a column as bits, the head lowest."""
    n = len(p.b)
    reached = np.ones((n + 1, len(p.la)), np.uint64)
    for j in range(n):
        free = (_bits(near(j)) << _ONE)[None]
        seed = reached << _ONE
        seed |= reached
        seed &= free
        # A run of close vertices is kept from its lowest seed on: the sum's carry clears it from there.
        kept = np.invert(free + seed)
        kept |= seed
        kept &= free
        kept[1:] |= reached[:-1]
        reached = kept
    costs = ((reached >> p.la.astype(np.uint64)[None]) & _ONE).sum(axis=0).astype(np.int64)
    return np.where(costs > 0, n + 1 - costs, NEVER)


def edr(p: Pairs, eps: float) -> np.ndarray:
    """Fewest edits with a match within eps costing nothing."""
    if len(p.a) <= WORD:
        return _edr_words(p, eps)
    place = np.arange(len(p.a) + 1)[:, None]

    def step(column, j):
        new = np.empty_like(column)
        new[0] = column[0] + 1
        new[1:] = np.minimum(column[:-1] + (p.squares(j) > eps * eps), column[1:] + 1)
        return np.minimum.accumulate(new - place, axis=0) + place

    return p.fold(np.repeat(place, len(p.la), axis=1).astype(np.int64), step)


def lcss(p: Pairs, eps: float) -> np.ndarray:
    """Most vertices matched in order within eps."""

    def step(column, j):
        new = np.zeros_like(column)
        new[1:] = np.where(p.squares(j) <= eps * eps, column[:-1] + 1, column[1:])
        return np.maximum.accumulate(new, axis=0)

    return p.fold(p.first(0, np.int64), step)


def lcss_distance(p: Pairs, eps: float) -> np.ndarray:
    return 1 - lcss(p, eps) / np.minimum(p.la, p.lb)


def erp(p: Pairs, gap=None) -> np.ndarray:
    """Edit distance with real penalty to a gap point (default: the origin)."""
    g = np.zeros(p.a.shape[2]) if gap is None else np.asarray(gap, np.float64)
    of = lambda x: np.sqrt(((x - g) ** 2).sum(axis=2))
    ga, gb = of(p.a), of(p.b)
    first = np.concatenate([np.zeros((1, len(p.la))), np.cumsum(ga, axis=0)])

    def step(column, j):
        d, new = np.sqrt(p.squares(j)), np.empty_like(column)
        new[0] = column[0] + gb[j]
        came = np.minimum(column[:-1] + d, column[1:] + gb[j])
        for i in range(len(d)):
            np.minimum(came[i], new[i] + ga[i], out=new[i + 1])
        return new

    return p.fold(first, step)


#: Longest window of insertions that is looked through cell by cell.
NARROW = 16


def _steps(reach: np.ndarray) -> list[list[np.ndarray]] | None:
    """Of each place i, what an insertion costs that comes from place i, i - 1, ...: 1 or NEVER; None where windows are long."""
    wide = np.arange(len(reach))[:, None] - reach
    if int(wide.max()) >= NARROW:
        return None
    return [[np.where(w >= d, 1, NEVER) for d in range(int(w.max()) + 1)] for w in wide]


def _insertions(best: np.ndarray, head: np.ndarray, reach: np.ndarray, steps: list[list[np.ndarray]] | None) -> np.ndarray:
    """A column of cells where cell i may also be one more than any of cells reach[i]..i.

    The least of a window of the column itself: only the last place of each value so far can matter to it, and the cheapest
    reachable place is found by going back through those, together for all pairs.
    """
    m, pairs = best.shape
    new = np.empty((m + 1, pairs), best.dtype)
    new[0] = head
    if steps is not None:
        for i, costs in enumerate(steps):
            cell = best[i]
            for d, cost in enumerate(costs):
                cell = np.minimum(cell, new[i - d] + cost)
            new[i + 1] = cell
        return new
    low = np.zeros(pairs, np.int64)  # a place where the least of the window stands
    every = np.arange(pairs)
    for i in range(m):
        # The newest cell takes over where it's no worse; a place that left the window is looked for anew.
        low = np.where(new[i] <= new[low, every], i, low)
        gone = np.flatnonzero(low < reach[i])
        if len(gone):
            back = np.arange(int(reach[i, gone].min()), i + 1)
            part = np.where(back[:, None] >= reach[i, gone][None], new[back[0] : i + 1, gone], NEVER)
            low[gone] = back[0] + len(back) - 1 - np.argmin(part[::-1], axis=0)
        new[i + 1] = np.minimum(best[i], np.minimum(new[low, every] + 1, NEVER))
    return new


def edit_cost(p: Pairs, delta: float, mode: str, reach: list[list[int]] | None = None, rounded: bool = False) -> np.ndarray:
    """Fewest edits of b that bring it within delta of a in the discrete measure; NEVER if none do.

    reach: of each reference, the first vertex that one ball holds together with all up to vertex i; needed for insertion.
    rounded: closeness by rounded distances, not decided exactly.
    """
    delete, insert = mode != "insert", mode != "delete"
    m, pairs = len(p.a), len(p.la)
    close = lambda j: p.near_rounded(j, delta) if rounded else p.near(j, delta)
    if not insert and m <= WORD and len(p.b) <= WORD and (p.lb == len(p.b)).all():
        return _delete_words(p, close)
    back = np.zeros((m, pairs), np.int64)
    if insert:
        for k, r in enumerate(reach):
            back[: len(r), k] = r
            back[len(r) :, k] = np.arange(len(r), m)

    steps = _steps(back) if insert else None

    def column(best, head):
        return _insertions(best, head, back, steps) if insert else np.concatenate([head[None], best])

    def step(first, j):
        near = close(j)
        far = np.cumsum(~near, axis=0) * (4 * NEVER)
        base = np.where(near, np.minimum(first[:-1], first[1:]), NEVER)
        # A running minimum that starts anew after every gap in closeness.
        kept = np.where(near, np.minimum(np.minimum.accumulate(base - far, axis=0) + far, NEVER), NEVER)
        best = np.minimum(kept, first[1:] + 1) if delete else kept
        head = np.minimum(first[0] + 1, NEVER) if delete else np.full(pairs, NEVER)
        return column(np.minimum(best, NEVER), head)

    return p.fold(column(np.full((m, pairs), NEVER, np.int64), np.zeros(pairs, np.int64)), step)


def groups(a: list[np.ndarray], b: list[np.ndarray]):
    """Index arrays of pairs of like lengths and one dimension, each within GROUP_CELLS (a longer pair stays alone)."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    dim = np.array([x.shape[1] for x in a])
    order = np.lexsort((la, lb // 8, dim))
    at = 0
    while at < len(order):
        most_a = most_b = 0
        end = at
        while end < len(order):
            k = order[end]
            ma, mb = max(most_a, la[k]), max(most_b, lb[k])
            if end > at and (dim[k] != dim[order[at]] or ma * mb * (end - at + 1) > GROUP_CELLS or mb > 2 * lb[order[at]] + 8):
                break
            most_a, most_b, end = ma, mb, end + 1
        yield order[at:end]
        at = end
