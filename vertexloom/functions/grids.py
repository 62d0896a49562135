"""Free-space diagrams of two curves on a regular grid, as Columns: arrays of rows, [t][s], t along b and s along a."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexloom.functions.curves import let, sq_dist


def sample(pts: Column, resolution: int) -> Column:
    """resolution points at even steps of the vertex index, both ends included."""
    if resolution < 2:
        raise ValueError("resolution must be at least 2")
    last = F.size(pts) - 1

    def at(k: Column) -> Column:
        u = k * last / F.lit(float(resolution - 1))
        i = F.greatest(F.lit(0), F.least(F.floor(u).cast("int"), last - 1))
        between = lambda i: F.zip_with(F.get(pts, i), F.get(pts, F.least(i + 1, last)), lambda x, y: x + (y - x) * (u - i))
        return let(i, between)

    return F.transform(F.sequence(F.lit(0), F.lit(resolution - 1)), at)


def free_space(a: Column, b: Column, eps: float, resolution: int) -> Column:
    if eps < 0:
        raise ValueError("eps must not be negative")
    rows = lambda p, q: F.transform(q, lambda y: F.transform(p, lambda x: F.sqrt(sq_dist(y, x)) <= eps))
    return let(sample(a, resolution), lambda p: let(sample(b, resolution), lambda q: rows(p, q)))


def reachable(free: Column) -> Column:
    """Free cells that a monotone walk (right, up, diagonal) of free cells from the origin arrives at."""
    off = F.lit(False)

    def row(done: Column, line: Column) -> Column:
        below = F.try_element_at(done, F.lit(-1))

        def cell(out: Column, s: Column) -> Column:
            start = (F.size(done) == 0) & (s == 0)
            came = F.coalesce(F.get(out, s - 1), off) | F.coalesce(F.get(below, s), off) | F.coalesce(F.get(below, s - 1), off)
            return F.concat(out, F.array(F.get(line, s) & (start | came)))

        made = F.aggregate(F.sequence(F.lit(0), F.size(line) - 1), F.array().cast("array<boolean>"), cell)
        return F.concat(done, F.array(made))

    return F.aggregate(free, F.array().cast("array<array<boolean>>"), row)


def monotone_path(reach: Column) -> Column:
    """One walk to the far corner as array<struct<s,t>>, found backwards preferring diagonal, then left, then down; NULL if there is none."""
    height, width = F.size(reach), F.size(F.get(reach, F.lit(0)))
    step = lambda s, t: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"))
    open_ = lambda s, t: F.coalesce(F.get(F.get(reach, t), s), F.lit(False))

    def back(path: Column, _: Column) -> Column:
        at = F.element_at(path, 1)
        s, t = at["s"], at["t"]
        to = F.when((s > 0) & (t > 0) & open_(s - 1, t - 1), step(s - 1, t - 1)).when((s > 0) & open_(s - 1, t), step(s - 1, t)).when((t > 0) & open_(s, t - 1), step(s, t - 1))
        return F.when((s == 0) & (t == 0), path).otherwise(F.concat(F.array(to), path))

    walked = F.aggregate(F.sequence(F.lit(1), height + width), F.array(step(width - 1, height - 1)), back)
    return F.when(open_(width - 1, height - 1), walked)
