import itertools
import random
from fractions import Fraction as F

import numpy as np
import pyarrow as pa
import pytest

from vertexloom.kernels import ball, checker, simplify
from vertexloom.kernels.checker import continuous_within
from vertexloom.kernels.continuous import fewest_deletions
from vertexloom.kernels.discrete import solve
from vertexloom.kernels.intervals import Interval


def curve(*points):
    return np.array([p if isinstance(p, tuple) else (p,) for p in points], float)


GOLDEN = [((0, 1, 2), (0, 1, 100, 2), 0.1, "delete", 1), ((0, 1, 2), (0, 1, 100, 2), 0.1, "insert", None), ((0, 2, 4), (0,), 1, "insert", 1), ((0, 1, 0), (0,), 0.4, "insert", 2), ((0, 10), (100, 200), 1, "both", 4), ((0, 5, 10), (0, 99, 10), 0.6, "both", 2)]


@pytest.mark.parametrize("ref,obs,delta,mode,cost", GOLDEN)
def test_discrete_golden(ref, obs, delta, mode, cost):
    assert solve(curve(*ref), curve(*obs), delta, mode)["cost"] == cost


def test_insertion_needs_layers():
    for m in range(2, 10):
        assert solve(curve(*[i % 2 for i in range(m)]), curve(0), 0.4, "insert")["cost"] == m - 1


def test_continuous_against_enumeration():
    rng = random.Random(5)
    for _ in range(60):
        ref, obs = (curve(*[(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.randint(1, n))]) for n in (4, 5))
        delta = rng.choice([0.5, 1, 2**0.5, 2])
        subsets = (c for k in range(len(obs), 0, -1) for c in itertools.combinations(range(len(obs)), k))
        best = next((len(obs) - len(c) for c in subsets if continuous_within(ref, obs[list(c)], delta)), None)
        assert fewest_deletions(ref, obs, delta)["cost"] == best


def test_tangency_is_closed():
    ref, obs = curve((-1, 0), (0, 0), (1, 0)), curve((-1, 1), (1, 1))
    assert fewest_deletions(ref, obs, 1.0)["cost"] == 0
    assert fewest_deletions(ref, obs, float(np.nextafter(1, 0)))["status"] == "infeasible"


def test_balls_against_every_subset():
    rng = random.Random(12)
    for _ in range(40):
        dim = rng.choice([2, 3])
        pts = [[F(rng.randint(-4, 4)) for _ in range(dim)] for _ in range(rng.randint(1, 6))]
        c, r2 = ball.enclosing(np.array(pts, float))
        assert all(sum((x - y) ** 2 for x, y in zip(p, c)) <= r2 for p in pts)
        # No ball through a subset that holds all points is smaller.
        for k in range(1, min(len(pts), dim + 1) + 1):
            for some in itertools.combinations(pts, k):
                got = ball._through([list(p) for p in some])
                if got and all(sum((x - y) ** 2 for x, y in zip(p, got[0])) <= got[1] for p in pts):
                    assert got[1] >= r2
        delta = float(r2) ** 0.5
        assert ball.fits(np.array(pts, float), delta + 1e-6) and (r2 == 0 or not ball.fits(np.array(pts, float), delta - 1e-6))


def test_through_is_equally_far():
    for pts in ([[F(0), F(0)], [F(4), F(0)], [F(1), F(3)]], [[F(0), F(0), F(0)], [F(1), F(0), F(0)], [F(0), F(2), F(0)], [F(0), F(0), F(3)]]):
        c, r2 = ball._through(pts)
        assert all(sum((x - y) ** 2 for x, y in zip(p, c)) == r2 for p in pts)
    assert ball._through([[F(0), F(0)], [F(1), F(1)], [F(2), F(2)]]) is None


def test_intervals_hold_the_truth():
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(size=(3, 200)) * 10.0 ** rng.integers(-8, 8, (3, 200))
    got = ((Interval(x) - y) * Interval(z) + Interval(y).square()).over(Interval(np.abs(z)) + 1)
    for i in range(200):
        a, b, c = F(x[i]), F(y[i]), F(z[i])
        true = ((a - b) * c + b * b) / (abs(c) + 1)
        assert F(float(got.lo[i])) <= true <= F(float(got.hi[i]))
        assert abs(F(float(got.middle()[i])) - true) <= F(float(got.radius()[i]))
    root = Interval(np.abs(x)).sqrt()
    assert all(F(float(lo)) ** 2 <= F(abs(v)) <= F(float(hi)) ** 2 for lo, hi, v in zip(root.lo, root.hi, x))


def test_tables_beyond_the_limit_are_refused():
    ref, obs = curve(*[(i, 0) for i in range(30)]), curve(*[(i, 5 * (i % 2)) for i in range(30)])
    got = fewest_deletions(ref, obs, 1.0, most_bytes=20_000)
    assert got["status"] == "memory_exceeded" and got["cost"] is None
    assert solve(ref, obs, 1.0, "delete")["counters"]["points"] == 900


def test_large_tables_are_solved_unless_a_limit_is_stated():
    ref = curve((0, 0), (1e6, 0))
    obs = curve((0, 0), *[(1000 + i, 1000) for i in range(400)], (1e6, 0))
    got = fewest_deletions(ref, obs, 1.0, witness=True)  # its tables were over half a GB, and the pair was refused
    assert (got["status"], got["cost"], got["edited_curve"]) == ("optimal", 400, ref.tolist())


def test_edges_computed_again_give_the_same(monkeypatch):
    from vertexloom.kernels import continuous

    ref, obs = curve(*[(i, 0) for i in range(8)]), curve(*[(i / 2, 2 * (i % 3)) for i in range(16)])
    want = continuous.fewest_deletions(ref, obs, 1.0, witness=True)
    monkeypatch.setattr(continuous, "KEPT_BYTES", 0)
    got = continuous.fewest_deletions(ref, obs, 1.0, witness=True)
    assert {k: v for k, v in got.items() if k != "counters"} == {k: v for k, v in want.items() if k != "counters"} and want["status"] == "optimal"


def test_checker_decides_close_roots():
    a, b = checker._Cut(F(0), 1, F(2)), checker._Cut(F(1), 1, F(2) ** 1 + 1 - 2 * F(1))
    assert checker._difference_sign(a, a) == 0 and checker._difference_sign(b, a) == 1
    near = checker._Cut(F(0), 1, F(2) + F(1, 10**2000))
    assert checker._difference_sign(near, a) == 1 and not checker._le(near, a) and checker._le(a, near)


def test_simplification_by_significance():
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 2)).cumsum(0)

    def plain(lo, hi, tol):
        if hi - lo < 2:
            return set()
        far = simplify.chord_distances(pts[lo + 1 : hi], pts[lo], pts[hi])
        k = lo + 1 + int(far.argmax())
        return {k} | plain(lo, k, tol) | plain(k, hi, tol) if far.max() > tol else set()

    for tol in (0.3, 1.0, 3.0):
        kept, used = simplify.simplify_to(pts, 30, tol) if len(plain(0, 59, tol)) + 2 <= 30 else (None, None)
        if kept is not None:
            assert set(kept.tolist()) == plain(0, 59, used) | {0, 59} and (used == tol / 64 or len(plain(0, 59, used / 2)) + 2 > 30)


def test_rounded_distances_are_those_of_sql():
    """Values whose difference only rounds to the limit: exactly farther than 100, or not, but 100 as doubles."""
    from fractions import Fraction

    from vertexloom.kernels import batch as B

    rng = np.random.default_rng(2)
    low = np.round(rng.uniform(0, 400, 4000), 2)
    high = np.round(low + 100, 2)
    odd = [(x, y) for x, y in zip(low, high, strict=True) if (y - x <= 100) != (Fraction(float(y)) - Fraction(float(x)) <= 100)]
    assert odd
    p = B.Pairs([np.array([[x]]) for x, _ in odd], [np.array([[y]]) for _, y in odd])
    rounded = B.edit_cost(p, 100.0, "delete", rounded=True) < B.NEVER
    assert rounded.tolist() == [abs(x - y) <= 100.0 for x, y in odd]
    assert (rounded != (B.edit_cost(p, 100.0, "delete") < B.NEVER)).all()


def _no_tables(*args):
    raise AssertionError("the exact tables were built")


def test_clear_cases_of_continuous_deletion_need_no_tables(monkeypatch):
    from vertexloom.kernels import continuous

    course = np.array([[10.0 * i, 5.0 * (i % 3)] for i in range(60)])
    track = np.insert(course, [7, 20, 41], course[[7, 20, 41]] + [0.0, 5000.0], axis=0)
    monkeypatch.setattr(continuous, "ranks", _no_tables)
    got = continuous.fewest_deletions(course, track, 25.0, 15, witness=True)
    assert (got["cost"], [e["index"] for e in got["edits"]]) == (3, [7, 21, 43])
    short = continuous.fewest_deletions(course, track[:40], 25.0, 10)
    assert (short["status"], short["cost"]) == ("budget_exceeded", None)
    jump = continuous.fewest_deletions(np.array([[0.0], [100.0], [0.0]]), np.array([[0.0], [10.0], [0.0]]), 20.0)
    assert (jump["status"], jump["cost"]) == ("infeasible", None)


def test_the_checker_looks_at_entered_cells_only(monkeypatch):
    from vertexloom.kernels import checker

    seen, free = [], checker._free
    monkeypatch.setattr(checker, "_free", lambda *x: seen.append(1) or free(*x))
    line = np.array([[10.0 * i, 0.0] for i in range(40)])
    assert checker.continuous_within(line, line + [0.0, 1.0], 3.0)
    assert len(seen) < 40 * 10


def test_pairs_of_the_same_curves_are_solved_once():
    from vertexloom.operators import edits

    calls = []
    result = {"status": "optimal", "cost": 0, "witness_status": "not_requested", "edited_curve": [], "edits": [], "coupling": [], "detail": "", "counters": {}}
    curve = [[0.0], [1.0]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([curve] * 3), pa.array([curve, curve, [[5.0]]]), pa.array([None] * 3, pa.int32())], ["id", *edits._INPUT])
    got = list(edits._rows(lambda r, o, cap: calls.append(1) or result)([batch]))
    assert got[0].num_rows == 3 and len(calls) == 2


def test_words_give_what_columns_give(monkeypatch):
    """Edit costs by bits equal those by cells, for references up to the word and padded ones."""
    from vertexloom.kernels import batch as B

    rng = np.random.default_rng(5)
    for dim, longest in ((1, 8), (2, 20), (1, B.WORD)):
        a = [rng.integers(0, 6, (int(n), dim)).astype(float) for n in rng.integers(1, longest + 1, 300)] + [rng.integers(0, 6, (longest, dim)).astype(float)]
        padded = B.padded(a)
        for n in (1, 2, 7, 30):
            p = B.Pairs.against(*padded, rng.integers(0, 6, (n, dim)).astype(float))
            mixed = B.Pairs(a, [rng.integers(0, 6, (int(k), dim)).astype(float) for k in rng.integers(1, n + 1, len(a))])
            for delta in (0.5, 1.0, 3.0):
                got = B.edr(p, delta), B.edr(mixed, delta), B.edit_cost(p, delta, "delete"), B.edit_cost(p, delta, "delete", rounded=True)
                with monkeypatch.context() as cells:
                    cells.setattr(B, "WORD", 0)
                    want = B.edr(p, delta), B.edr(mixed, delta), B.edit_cost(p, delta, "delete"), B.edit_cost(p, delta, "delete", rounded=True)
                for x, y in zip(got, want, strict=True):
                    assert x.tolist() == y.tolist()


def test_narrow_windows_of_insertions_give_what_long_ones_give(monkeypatch):
    from vertexloom.kernels import batch as B
    from vertexloom.kernels.ball import reach

    rng = np.random.default_rng(6)
    a = [np.cumsum(rng.integers(-4, 5, (int(n), 1)), axis=0).astype(float) for n in rng.integers(1, 14, 200)]
    b = [np.cumsum(rng.integers(-4, 5, (int(n), 1)), axis=0).astype(float) for n in rng.integers(1, 12, 200)]
    for delta in (1.0, 3.0):
        rows = [reach(x, delta) for x in a]
        for mode in ("insert", "both"):
            got = B.edit_cost(B.Pairs(a, b), delta, mode, rows)
            with monkeypatch.context() as wide:
                wide.setattr(B, "NARROW", 0)
                assert got.tolist() == B.edit_cost(B.Pairs(a, b), delta, mode, rows).tolist()
            assert (got < B.NEVER).any()
