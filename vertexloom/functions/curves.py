"""Curve measures and edit costs as Spark SQL expressions.

A curve is array<array<double>>. The dynamic programs are folds with higher-order functions, so they run in
the JVM; each is one Column of two curve Columns. A fold copies its column at every cell, so they suit short curves and
places where only a Column fits; operators.measures computes the same for tables, many pairs at once and exactly at the limit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = 1_000_000
EARTH = 6_371_008.8
_FAR = float("inf")


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def as_curve(values: Column) -> Column:
    """A one-dimensional curve from array<double>."""
    return F.transform(values, lambda v: F.array(v))


def valid_curve(pts: Column, dim: Column) -> Column:
    """At least one vertex, all of one dimension, all coordinates finite."""
    fine = F.forall(pts, lambda p: (F.size(p) == dim) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _FAR)))
    return pts.isNotNull() & (F.size(pts) > 0) & (dim > 0) & fine


def point_tier(d2: Column, delta: Column | float, dim: Column | int) -> Column:
    """Three-valued closeness from a squared distance: NULL where floating point can't tell."""
    limit = (F.lit(delta) if not isinstance(delta, Column) else delta) ** 2
    slack = 8.0 * (dim + 4) * 2.0**-53 * (d2 + limit) + dim * 8 * 2.0**-1070
    return F.when(d2 - limit > slack, False).when(limit - d2 > slack, True)


def upto(n: Column) -> Column:
    """1 to n; nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _columns(ref: Column, obs: Column, first: Column, cell, head) -> Column:
    """Fold over obs: the column of ref's cells. cell(prev, out, p, q, i) gives cell i (1-based) after the head."""

    def column(prev: Column, q: Column) -> Column:
        return F.aggregate(upto(F.size(ref)), F.array(head(prev)), lambda out, i: F.concat(out, F.array(cell(prev, out, F.element_at(ref, i), q, i))))

    return F.aggregate(obs, first, column)


def discrete_frechet(a: Column, b: Column) -> Column:
    """Least maximal pair distance over monotone couplings; infinite if one curve alone has no vertex, 0 if both have none."""

    def cell(prev, out, p, q, i):
        # prev[0] and out[0] stand before the first vertex: only the first cell of the first column starts there.
        return F.greatest(F.least(F.get(prev, i - 1), F.get(prev, i), F.get(out, i - 1)), dist(p, q))

    first = F.concat(F.array(F.lit(0.0)), F.transform(a, lambda p: F.lit(_FAR)))
    return F.element_at(_columns(a, b, first, cell, lambda prev: F.lit(_FAR)), -1)


def dtw(a: Column, b: Column) -> Column:
    """Least sum of pair distances."""

    def cell(prev, out, p, q, i):
        return F.least(F.get(prev, i - 1), F.get(prev, i), F.get(out, i - 1)) + dist(p, q)

    first = F.concat(F.array(F.lit(0.0)), F.transform(a, lambda p: F.lit(_FAR)))
    return F.element_at(_columns(a, b, first, cell, lambda prev: F.lit(_FAR)), -1)


def _dtw_cells(a: Column, b: Column) -> Column:
    """(cost, length of the path) of the last cell; ties prefer diagonal, then up, then left."""
    pair = lambda c, n: F.struct(c.cast("double").alias("c"), n.cast("long").alias("n"))

    def cell(prev, out, p, q, i):
        # The curves' roles: rows are a, columns b; up is the same b, left the same a.
        d, u, left = F.get(prev, i - 1), F.get(out, i - 1), F.get(prev, i)
        best = F.when((d["c"] <= u["c"]) & (d["c"] <= left["c"]), d).when(u["c"] <= left["c"], u).otherwise(left)
        return let(best, lambda x: pair(x["c"] + dist(p, q), x["n"] + 1))

    first = F.concat(F.array(pair(F.lit(0.0), F.lit(0))), F.transform(a, lambda p: pair(F.lit(_FAR), F.lit(0))))
    return F.element_at(_columns(a, b, first, cell, lambda prev: pair(F.lit(_FAR), F.lit(0))), -1)


def dtw_normalized(a: Column, b: Column) -> Column:
    return let(_dtw_cells(a, b), lambda x: x["c"] / x["n"])


def edr(a: Column, b: Column, eps: Column | float) -> Column:
    """Fewest edits with a match within eps costing nothing."""
    eps2 = (eps if isinstance(eps, Column) else F.lit(eps)) ** 2

    def cell(prev, out, p, q, i):
        return F.least(F.get(prev, i - 1) + F.when(sq_dist(p, q) <= eps2, 0).otherwise(1), F.get(prev, i) + 1, F.get(out, i - 1) + 1)

    return F.element_at(_columns(a, b, F.sequence(F.lit(0), F.size(a)), cell, lambda prev: F.get(prev, F.lit(0)) + 1), -1)


def lcss(a: Column, b: Column, eps: Column | float) -> Column:
    """Most vertices matched in order within eps."""
    eps2 = (eps if isinstance(eps, Column) else F.lit(eps)) ** 2

    def cell(prev, out, p, q, i):
        return F.when(sq_dist(p, q) <= eps2, F.get(prev, i - 1) + 1).otherwise(F.greatest(F.get(prev, i), F.get(out, i - 1)))

    return F.element_at(_columns(a, b, F.concat(F.array(F.lit(0)), F.transform(a, lambda p: F.lit(0))), cell, lambda prev: F.lit(0)), -1)


def lcss_distance(a: Column, b: Column, eps: Column | float) -> Column:
    return 1 - lcss(a, b, eps) / F.least(F.size(a), F.size(b))


def erp(a: Column, b: Column, gap: Column | None = None) -> Column:
    """Edit distance with real penalty to a gap point (default: the origin)."""
    g = gap if gap is not None else F.transform(F.element_at(a, 1), lambda x: F.lit(0.0))

    def cell(prev, out, p, q, i):
        return F.least(F.get(prev, i - 1) + dist(p, q), F.get(prev, i) + dist(q, g), F.get(out, i - 1) + dist(p, g))

    first = F.aggregate(a, F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + dist(p, g))))
    # The head of a column is the head before it and the gap cost of that column's vertex.
    def column(prev: Column, q: Column) -> Column:
        head = F.array(F.get(prev, F.lit(0)) + dist(q, g))
        return F.aggregate(upto(F.size(a)), head, lambda out, i: F.concat(out, F.array(cell(prev, out, F.element_at(a, i), q, i))))

    return F.element_at(F.aggregate(b, first, column), -1)


def block_reach(ref: Column, delta: Column | float) -> Column:
    """One-dimensional: for each vertex the first (1-based) that one ball of radius delta covers together with all between."""
    d = delta if isinstance(delta, Column) else F.lit(delta)
    x = lambda i: F.element_at(F.element_at(ref, i), 1)

    def step(out: Column, i: Column) -> Column:
        start = F.when(F.size(out) > 0, F.try_element_at(out, F.lit(-1))).otherwise(F.lit(1))
        fits = lambda t: let(F.transform(F.sequence(t, i), x), lambda v: F.array_max(v) - F.array_min(v) <= 2 * d)
        return F.concat(out, F.array(F.element_at(F.filter(F.sequence(start, i), fits), 1)))

    return F.aggregate(upto(F.size(ref)), F.array().cast("array<int>"), step)


def edit_cost(ref: Column, obs: Column, delta: Column | float, mode: str, reach: Column | None = None) -> Column:
    """Fewest edits of obs that bring it within delta of ref in the discrete measure; NULL if none do.

    delete works in any dimension; insert and both need reach (block_reach of ref and delta, which
    depends on the reference alone and so is best computed once a reference).
    """
    if mode not in ("delete", "insert", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    d = delta if isinstance(delta, Column) else F.lit(delta)
    delete, insert = mode != "insert", mode != "delete"
    inf = F.lit(INF)
    if insert and reach is None:
        return let(block_reach(ref, d), lambda rows: edit_cost(ref, obs, delta, mode, rows))

    def inserted(out: Column, i: Column) -> Column:
        lo = F.element_at(reach, i)
        return F.least(inf, 1 + F.array_min(F.slice(out, lo, i - lo + 1)))

    first = F.array(F.lit(0))
    zero = F.aggregate(upto(F.size(ref)), first, lambda out, i: F.concat(out, F.array(inserted(out, i) if insert else inf)))

    def column(f: Column, q: Column) -> Column:
        start = F.struct(inf.alias("k"), F.array(F.least(inf, F.get(f, F.lit(0)) + 1) if delete else inf).alias("out"))

        def row(s: Column, i: Column) -> Column:
            near = sq_dist(F.element_at(ref, i), q) <= d * d
            k = F.when(near, F.least(s["k"], F.get(f, i - 1), F.get(f, i))).otherwise(inf)
            ways = lambda k: [k, *([inserted(s["out"], i)] if insert else []), *([F.least(inf, F.get(f, i) + 1)] if delete else [])]
            best = lambda k: F.least(*ways(k)) if len(ways(k)) > 1 else k
            return let(k, lambda k: F.struct(k.alias("k"), F.concat(s["out"], F.array(best(k))).alias("out")))

        return F.aggregate(upto(F.size(ref)), start, row, lambda s: s["out"])

    cost = F.element_at(F.aggregate(obs, zero, column), -1)
    return F.nullif(F.least(cost, inf), inf)


def smooth(pts: Column, window: int, median: bool = False) -> Column:
    """Centred moving average (or median) of each coordinate; near the ends the window shrinks on both sides."""
    if isinstance(window, bool) or not isinstance(window, int) or window < 1 or window % 2 == 0:
        raise ValueError("window must be a positive odd integer")
    n = F.size(pts)

    def at(p: Column, i: Column) -> Column:
        r = F.least(F.lit(window // 2), i, n - 1 - i)
        part = F.slice(pts, i - r + 1, 2 * r + 1)

        def coordinate(x: Column, c: Column) -> Column:
            xs = F.transform(part, lambda y: F.element_at(y, c + 1))
            return F.get(F.sort_array(xs), r) if median else F.aggregate(xs, F.lit(0.0), lambda s, y: s + y) / (2 * r + 1)

        return F.transform(p, coordinate)

    return F.transform(pts, at)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    minus = lambda u, v: F.zip_with(u, v, lambda x, y: x - y)

    def along(v: Column) -> Column:
        t = F.coalesce(F.try_divide(dot(minus(p, a), v), dot(v, v)), F.lit(0.0))
        return let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), lambda t: dist(p, F.zip_with(a, v, lambda x, y: x + t * y)))

    return let(minus(b, a), along)


def polyline_distance(p: Column, line: Column) -> Column:
    """Distance of a point to a polyline, which may be a single vertex."""
    legs = F.sequence(F.lit(1), F.size(line) - 1)
    far = F.array_min(F.transform(legs, lambda i: segment_distance(p, F.element_at(line, i), F.element_at(line, i + 1))))
    return F.when(F.size(line) == 1, dist(p, F.element_at(line, 1))).otherwise(far)


def longest_run(flags: Column) -> Column:
    """(start, length) of the first longest run of true; (0, 0) without any."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("best_s"), F.lit(0).alias("best_n"), F.lit(0).alias("i"))

    def step(a: Column, f: Column) -> Column:
        n = F.when(f, a["n"] + 1).otherwise(0)
        s = F.when(f & (a["n"] == 0), a["i"]).otherwise(a["s"])
        return let(F.struct(s.alias("s"), n.alias("n")), lambda c: F.struct(c["s"].alias("s"), c["n"].alias("n"), F.when(c["n"] > a["best_n"], c["s"]).otherwise(a["best_s"]).alias("best_s"), F.greatest(c["n"], a["best_n"]).alias("best_n"), (a["i"] + 1).alias("i")))

    return F.aggregate(flags, start, step, lambda a: F.struct(a["best_s"].alias("start"), a["best_n"].alias("length")))


def decimate(pts: Column, most: int) -> Column:
    """Every k-th vertex so that about most remain, and the last."""
    n = F.size(pts)
    step = F.greatest(F.lit(1), F.ceil((n - 1) / F.lit(max(1, most - 1)))).cast("int")
    return F.filter(pts, lambda p, i: (i % step == 0) | (i == n - 1))


def resample(pts: Column, factor: float) -> Column:
    """Integer factors interpolate linearly; fractions keep every round(1/factor)-th vertex (2 at least) and the last."""
    if factor >= 1:
        k = int(factor)
        if k != factor:
            raise ValueError("an upsampling factor must be whole")
        mid = lambda p, i: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.zip_with(p, F.element_at(pts, i + 2), lambda x, y: x + (y - x) * t / k))
        return F.concat(F.flatten(F.transform(F.slice(pts, F.lit(1), F.size(pts) - 1), mid)), F.array(F.element_at(pts, -1)))
    if factor <= 0:
        raise ValueError("factor must be positive")
    step = max(round(1 / factor), 2)
    return F.filter(pts, lambda p, i: (i % step == 0) | (i == F.size(pts) - 1))


def path_length(pts: Column) -> Column:
    legs = F.transform(F.slice(pts, F.lit(2), F.size(pts)), lambda p, i: dist(p, F.element_at(pts, i + 1)))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def replay(obs: Column, edits: Column) -> Column:
    """Edits (struct op, index, gap, ord, point) applied to obs."""
    gone = F.transform(F.filter(edits, lambda e: e["op"] == "delete"), lambda e: e["index"])
    added = F.filter(edits, lambda e: e["op"] == "insert")

    def at(g: Column) -> Column:
        here = F.array_sort(F.transform(F.filter(added, lambda e: e["gap"] == g), lambda e: F.struct(e["ord"].alias("o"), e["point"].alias("p"))))
        kept = F.when((g < F.size(obs)) & ~F.array_contains(gone, g), F.slice(obs, g + 1, 1)).otherwise(F.slice(obs, 1, 0))
        return F.concat(F.transform(here, lambda e: e["p"]), kept)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(obs)), at))


def edits_valid(obs: Column, edits: Column) -> Column:
    """Indices in range and distinct, gaps in range, orders contiguous from 0 in each gap."""
    gone = F.transform(F.filter(edits, lambda e: e["op"] == "delete"), lambda e: e["index"])
    places = F.transform(F.filter(edits, lambda e: e["op"] == "insert"), lambda e: F.struct(e["gap"].alias("g"), e["ord"].alias("o")))
    n = F.size(obs)
    first = F.forall(gone, lambda i: (i >= 0) & (i < n)) & (F.size(F.array_distinct(gone)) == F.size(gone))
    then = F.forall(places, lambda p: (p["g"] >= 0) & (p["g"] <= n) & (p["o"] >= 0) & ((p["o"] == 0) | F.exists(places, lambda q: (q["g"] == p["g"]) & (q["o"] == p["o"] - 1))))
    return first & then & (F.size(F.array_distinct(places)) == F.size(places))


def coupling_valid(ref: Column, curve: Column, coupling: Column, delta: Column | float) -> Column:
    """From corner to corner in steps (1,0), (0,1), (1,1), with every pair within delta; NULL where only exact arithmetic can tell."""
    d = delta if isinstance(delta, Column) else F.lit(delta)
    dim = F.size(F.get(ref, F.lit(0)))
    ends = (F.get(coupling, F.lit(0))["r"] == 0) & (F.get(coupling, F.lit(0))["e"] == 0) & (F.try_element_at(coupling, F.lit(-1))["r"] == F.size(ref) - 1) & (F.try_element_at(coupling, F.lit(-1))["e"] == F.size(curve) - 1)

    def fine(c: Column, i: Column) -> Column:
        before = F.get(coupling, i - 1)
        dr, de = c["r"] - before["r"], c["e"] - before["e"]
        step = F.when(i == 0, True).otherwise(dr.isin(0, 1) & de.isin(0, 1) & (dr + de > 0))
        return step & point_tier(sq_dist(F.get(ref, c["r"]), F.get(curve, c["e"])), d, dim)

    flags = F.transform(coupling, fine)
    return (F.size(coupling) > 0) & ends & F.forall(flags, lambda x: x)


def to_xy(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = EARTH) -> Column:
    """Local tangent plane, safe across the antimeridian."""
    east = F.pmod(lon - lon0 + 180, F.lit(360.0)) - 180
    return F.array(F.radians(east) * F.cos(F.radians(lat0)) * radius, F.radians(lat - lat0) * radius)


def to_latlon(xy: Column, lat0: Column, lon0: Column, radius: float = EARTH) -> Column:
    lat = lat0 + F.degrees(F.element_at(xy, 2) / radius)
    lon = lon0 + F.degrees(F.element_at(xy, 1) / (radius * F.cos(F.radians(lat0))))
    return F.struct(lat.alias("lat"), (F.pmod(lon + 180, F.lit(360.0)) - 180).alias("lon"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def gradient(pts: Column) -> Column:
    """Tangents: half the difference of the neighbours, one-sided at the ends."""
    last = F.size(pts) - 1

    def at(i: Column) -> Column:
        lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, last)
        return F.zip_with(F.get(pts, lo), F.get(pts, hi), lambda x, y: (y - x) / F.greatest(hi - lo, F.lit(1)))

    return F.transform(F.sequence(F.lit(0), last), at)


def normals(pts: Column) -> Column:
    """Unit normals of a planar curve, to the left of its course; zero where it stands still."""

    def turn(t: Column) -> Column:
        x, y = F.element_at(t, 1), F.element_at(t, 2)
        size = F.sqrt(x * x + y * y)
        return let(F.when(size == 0, F.lit(1.0)).otherwise(size), lambda s: F.array(-y / s, x / s))

    return F.transform(gradient(pts), turn)


def offset(pts: Column, by: float) -> Column:
    """A planar curve moved sideways along its normals."""
    return F.zip_with(pts, normals(pts), lambda p, n: F.zip_with(p, n, lambda x, d: x + by * d))


def cumulative_length(pts: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.size(pts)), F.array().cast("array<double>"), lambda s, i: F.concat(s, F.array(F.when(i == 1, F.lit(0.0)).otherwise(F.element_at(s, -1) + dist(F.get(pts, i - 1), F.get(pts, F.greatest(i - 2, F.lit(0))))))))


def arc_resample(pts: Column, n: int, spacing: float | None = None) -> Column:
    """n vertices evenly along the curve: over all of it, or spacing apart from its start. NULL for curves of no length or shorter than that."""
    if n < 2:
        raise ValueError("n must be at least 2")

    def made(cum: Column) -> Column:
        total = F.element_at(cum, -1)
        target = lambda k: k * total / F.lit(float(n - 1)) if spacing is None else k * F.lit(float(spacing))

        def at(k: Column) -> Column:
            # The last leg that starts at or before the target.
            leg = lambda t: F.least(F.size(F.filter(cum, lambda c: c <= t)), F.size(cum) - 1)
            part = lambda t, i: F.coalesce(F.try_divide(t - F.element_at(cum, i), F.element_at(cum, i + 1) - F.element_at(cum, i)), F.lit(0.0))
            along = lambda t, i: let(F.least(part(t, i), F.lit(1.0)), lambda u: F.zip_with(F.element_at(pts, i), F.element_at(pts, i + 1), lambda x, y: x + u * (y - x)))
            return let(target(k), lambda t: let(leg(t), lambda i: along(t, i)))

        fits = total > 0 if spacing is None else (total > 0) & (total >= (n - 1) * spacing)
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))

    return let(cumulative_length(pts), made)


def extent(pts: Column) -> Column:
    """Diagonal of the bounding box."""
    side = lambda c: F.array_max(F.transform(pts, lambda p: F.get(p, c))) - F.array_min(F.transform(pts, lambda p: F.get(p, c)))
    return F.sqrt(F.aggregate(F.sequence(F.lit(0), F.size(F.element_at(pts, 1)) - 1), F.lit(0.0), lambda s, c: s + side(c) * side(c)))


def longest_step(pts: Column) -> Column:
    steps = F.transform(F.slice(pts, F.lit(2), F.size(pts)), lambda p, i: dist(p, F.get(pts, i)))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


def projection_scale_error(lats: Column, lat0: Column) -> Column:
    """Greatest relative error of east-west lengths in the tangent plane around lat0."""
    return F.array_max(F.transform(lats, lambda x: F.abs(F.cos(F.radians(x)) / F.cos(F.radians(lat0)) - 1)))
