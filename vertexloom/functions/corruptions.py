"""Damage done to curves on purpose, with a record of what was done, as Columns.

Every function takes (pts, key, seed, ...) and gives a struct of pts and record. key names the curve:
equal keys and seeds give equal damage on every cluster. Drawing more vertices than there are to draw
from is an error. record.n_injected counts what was done, which is no lower bound of the repair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import chance
from vertexloom.functions.curves import dist, let
from vertexloom.functions.curves import resample as _resampled


def _none() -> Column:
    return F.array().cast("array<int>")


def _count(n, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return n


def _amount(x, name: str) -> float:
    if isinstance(x, bool) or not math.isfinite(x) or x < 0:
        raise ValueError(f"{name} must be a finite non-negative number")
    return float(x)


def _pool(pts: Column, ends: bool) -> Column:
    """Indices that may be touched."""
    every = F.sequence(F.lit(0), F.size(pts) - 1)
    return every if ends else F.slice(every, F.lit(2), F.greatest(F.size(pts) - 2, F.lit(0)))


def _enough(have: Column, need: int, value: Column) -> Column:
    return F.when(have >= need, value).otherwise(F.raise_error(F.concat(F.lit(f"{need} vertices asked for, eligible: "), have.cast("string"))))


def _result(name: str, pts: Column, out: Column, mapping: Column, injected: Column, displaced: Column | None = None, removed: Column | None = None, fabricated: Column | None = None) -> Column:
    none = _none()
    record = lambda out: F.struct(
        F.lit(name).alias("operator"),
        F.size(pts).alias("original_length"),
        F.size(out).alias("corrupted_length"),
        (none if displaced is None else displaced).alias("displaced"),
        (none if removed is None else removed).alias("removed"),
        (none if fabricated is None else fabricated).alias("fabricated"),
        mapping.cast("array<int>").alias("output_to_original"),
        injected.cast("int").alias("n_injected"),
    )
    return let(out, lambda out: F.struct(out.alias("pts"), record(out).alias("record")))


def _same(pts: Column) -> Column:
    return F.sequence(F.lit(0), F.size(pts) - 1)


def _shift(p: Column, by: Column, size: float) -> Column:
    return F.zip_with(p, by, lambda x, d: x + size * d)


def spike(pts: Column, key: Column, seed: int, n: int, magnitude: float, ends: bool = False) -> Column:
    """n distinct vertices moved by magnitude, each in a direction of its own."""
    n, size = _count(n, "n"), _amount(magnitude, "magnitude")
    pool = _pool(pts, ends)
    dim = F.size(F.element_at(pts, 1))

    def made(chosen: Column) -> Column:
        out = F.transform(pts, lambda p, i: F.when(F.array_contains(chosen, i), _shift(p, chance.direction(key, seed, "spike", dim, i), size)).otherwise(p))
        return _result("spike", pts, out, _same(pts), F.lit(n), displaced=chosen)

    return let(_enough(F.size(pool), n, chance.pick(pool, n, key, seed, "spikes")), made)


def burst(pts: Column, key: Column, seed: int, length: int, magnitude: float, ends: bool = False) -> Column:
    """A run of vertices moved together by one vector."""
    length, size = _count(length, "length"), _amount(magnitude, "magnitude")
    pool = _pool(pts, ends)
    room = F.size(pool) - length + 1
    start = (F.lit(0 if ends else 1) + chance.bits(key, seed, "burst") % F.greatest(room, F.lit(1))).cast("int")
    by = chance.direction(key, seed, "burst", F.size(F.element_at(pts, 1)))

    def made(s: Column) -> Column:
        out = let(by, lambda v: F.transform(pts, lambda p, i: F.when((i >= s) & (i < s + length), _shift(p, v, size)).otherwise(p)))
        run = F.sequence(s, s + length - 1) if length else _none()
        return _result("burst", pts, out, _same(pts), F.lit(length), displaced=run)

    return let(_enough(F.size(pool), length, start), made)


def drop_samples(pts: Column, key: Column, seed: int, fraction: float, ends: bool = False) -> Column:
    """A fraction of the eligible vertices (rounded half to even) goes; one at least stays."""
    share = _amount(fraction, "fraction")
    if share > 1:
        raise ValueError("fraction must be at most 1")
    pool = _pool(pts, ends)
    n = F.bround(F.lit(share) * F.size(pool), 0).cast("int")
    n = F.least(n, F.size(pts) - 1) if ends else n

    def made(gone: Column) -> Column:
        return let(F.array_except(_same(pts), gone), lambda kept: _result("drop_samples", pts, F.transform(kept, lambda i: F.get(pts, i)), kept, F.size(gone), removed=gone))

    return let(chance.pick(pool, n, key, seed, "drop"), made)


def jitter(pts: Column, key: Column, seed: int, sigma: float) -> Column:
    """Normal noise on every coordinate; counts as no injected edit."""
    size = _amount(sigma, "sigma")
    out = F.transform(pts, lambda p, i: F.transform(p, lambda x, c: x + size * chance.normal(key, seed, "jitter", i, c)))
    return _result("jitter", pts, out, _same(pts), F.lit(0), displaced=_same(pts) if size else None)


def resample(pts: Column, key: Column, seed: int, factor: float) -> Column:
    """curves.resample with its record; no chance in it."""
    out = _resampled(pts, factor)
    if factor >= 1:
        k = int(factor)
        places = F.sequence(F.lit(0), (F.size(pts) - 1) * k)
        mapping = F.transform(places, lambda i: F.when(i % k == 0, F.floor(i / k).cast("int")))
        made = F.filter(places, lambda i: i % k != 0)
        return _result("resample", pts, out, mapping, F.size(made), fabricated=made)
    step = max(round(1 / factor), 2)
    kept = F.filter(_same(pts), lambda i: (i % step == 0) | (i == F.size(pts) - 1))
    return _result("resample", pts, out, kept, F.size(pts) - F.size(kept), removed=F.array_except(_same(pts), kept))


def prefix_suffix_noise(pts: Column, key: Column, seed: int, n: int, step: float | None = None) -> Column:
    """n made vertices before the first and n after the last: random walks away from the ends. step defaults to the median spacing."""
    n = _count(n, "n")
    if n == 0:
        return _result("prefix_suffix_noise", pts, pts, _same(pts), F.lit(0))
    gaps = F.array_sort(F.transform(F.slice(pts, F.lit(2), F.size(pts)), lambda p, i: dist(p, F.get(pts, i))))
    middle = lambda g: (F.get(g, F.floor((F.size(g) - 1) / 2).cast("int")) + F.get(g, F.floor(F.size(g) / 2).cast("int"))) / 2
    size = F.lit(_amount(step, "step")) if step is not None else let(gaps, lambda g: F.when(middle(g) > 0, middle(g)).otherwise(F.lit(1.0)))
    dim = F.size(F.element_at(pts, 1))

    def walk(end: Column, name: str, sign: int, size: Column) -> Column:
        far = lambda path, i: F.zip_with(F.element_at(path, -1), chance.direction(key, seed, name, dim, i), lambda x, d: x + sign * size * d)
        path = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(end), lambda path, i: F.concat(path, F.array(far(path, i))))
        return F.slice(path, 2, n)

    out = let(size, lambda s: F.concat(F.reverse(walk(F.element_at(pts, 1), "prefix", -1, s)), pts, walk(F.element_at(pts, -1), "suffix", 1, s)))
    blank = F.array_repeat(F.lit(None).cast("int"), n)
    fabricated = F.concat(F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.size(pts) + n, F.size(pts) + 2 * n - 1))
    return _result("prefix_suffix_noise", pts, out, F.concat(blank, _same(pts), blank), F.lit(2 * n), fabricated=fabricated)


def affected(record: Column) -> Column:
    """Original vertices that were moved or removed."""
    return F.array_sort(F.array_union(record["displaced"], record["removed"]))


def consistent(record: Column) -> Column:
    """Whether a record's index map is increasing, within range, and agrees with its lists."""
    named = F.filter(record["output_to_original"], lambda x: x.isNotNull())
    blank = F.filter(F.transform(record["output_to_original"], lambda x, i: F.when(x.isNull(), i)), lambda x: x.isNotNull())
    inside = lambda a: F.forall(a, lambda i: (i >= 0) & (i < record["original_length"]))
    rising = F.array_sort(F.array_distinct(named)) == named
    return (F.size(record["output_to_original"]) == record["corrupted_length"]) & rising & inside(named) & (F.size(F.array_except(blank, record["fabricated"])) == 0) & ~F.arrays_overlap(named, record["removed"]) & inside(affected(record))


def apply_pipeline(curves: DataFrame, steps: list, pts: str = "pts") -> DataFrame:
    """curves with pts damaged by each step (a function from the pts Column to a result) in order, records, and the composed output_to_original."""
    d = curves.withColumns({"records": F.array().cast("array<string>"), "output_to_original": _same(F.col(pts)).cast("array<int>")})
    names = []
    for k, step in enumerate(steps):
        name = f"_record{k}"
        d = d.withColumn("_step", step(F.col(pts)))
        composed = F.transform(F.col("_step.record.output_to_original"), lambda i: F.when(i.isNotNull(), F.get(F.col("output_to_original"), i)))
        d = d.withColumns({name: F.col("_step.record"), "output_to_original": composed, pts: F.col("_step.pts")}).drop("_step")
        names.append(name)
    return d.withColumn("records", F.array(*names) if names else F.col("records")).drop(*names)
