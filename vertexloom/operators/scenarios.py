"""Courses and tracks made up for demonstration, whose audits are known by construction.

A course is a loop on a plane; a runner's fixes lie along it at even distances, with errors that follow each other (each is
rho of the last and fresh noise). Random numbers come from key and seed alone, so every cluster makes the same fixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import chance
from vertexloom.functions import curves as C

LAT0, LON0 = 1.2855, 103.8575
SPEED, RHO = 3.2, 0.93
CORNERS = 16
#: Vertices of the loop that the shortcut leaves out.
SKIPPED = range(5, 11)
#: Places of spikes as shares of the track.
SPIKES = (0.66, 0.71, 0.72, 0.79, 0.86, 0.91)
FIXES = "array<struct<lat:double,lon:double>>"


def loop() -> list[list[float]]:
    """A closed course of CORNERS corners around the origin, about 3.4 km, not quite round."""
    at = [2 * math.pi * k / CORNERS for k in range(CORNERS + 1)]
    return [[(520 + 60 * math.cos(3 * t)) * math.sin(t), (560 + 50 * math.sin(2 * t)) * math.cos(t)] for t in at]


def _literal(points: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, p)) for p in points])


def along(path: Column, spacing: Column | float) -> Column:
    """Points every spacing along a path from its start, and its end."""
    gap = spacing if isinstance(spacing, Column) else F.lit(float(spacing))

    def made(cum: Column) -> Column:
        total = F.element_at(cum, -1)
        targets = F.concat(F.filter(F.transform(F.sequence(F.lit(0), F.ceil(total / gap).cast("int")), lambda k: k * gap), lambda t: t < total), F.array(total))

        def at(t: Column) -> Column:
            leg = F.least(F.size(F.filter(cum, lambda c: c <= t)), F.size(cum) - 1)
            return C.let(leg, lambda i: C.let((t - F.element_at(cum, i)) / (F.element_at(cum, i + 1) - F.element_at(cum, i)), lambda u: F.zip_with(F.element_at(path, i), F.element_at(path, i + 1), lambda x, y: x + u * (y - x))))

        return F.transform(targets, at)

    return C.let(C.cumulative_length(path), made)


def drift(n: Column, key: Column, seed: Column | int, sigma: Column | float, rho: float = RHO) -> Column:
    """n planar errors of deviation sigma, each rho of the one before and fresh noise."""
    size = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    name = F.concat_ws("/", key.cast("string"), F.lit(seed) if isinstance(seed, int) else seed.cast("string"))
    fresh = lambda i: F.array(*[chance.normal(name, 0, f"drift{c}", i) for c in "xy"])
    first = F.array(F.transform(fresh(F.lit(0)), lambda x: x * size))
    step = lambda out, i: F.concat(out, F.array(F.zip_with(F.element_at(out, -1), fresh(i), lambda a, b: rho * a + math.sqrt(1 - rho * rho) * size * b)))
    return F.aggregate(C.upto(n - 1), first, step)


def run(path: Column, interval: Column | float, key: Column, seed: Column | int, sigma: Column | float = 3.0) -> Column:
    """Fixes of a runner on a path, one every interval seconds; the first and the last are exact."""
    gap = SPEED * (interval if isinstance(interval, Column) else F.lit(float(interval)))

    def noisy(pts: Column) -> Column:
        n = F.size(pts)
        return C.let(drift(n, key, seed, sigma), lambda e: F.transform(pts, lambda p, i: F.when((i == 0) | (i == n - 1), p).otherwise(F.zip_with(p, F.get(e, i), lambda x, d: x + d))))

    return C.let(along(path, gap), noisy)


def spiked(track: Column, key: Column, seed: int, shares: tuple[float, ...] = SPIKES, least: float = 70.0, most: float = 240.0) -> Column:
    """(pts, injected): the fixes at the given shares of a track thrown off, each by a distance and in a direction of its own."""
    at = F.transform(F.array(*map(F.lit, shares)), lambda s: F.floor(F.size(track) * s).cast("int"))

    def thrown(chosen: Column) -> Column:
        turn = lambda i: 2 * math.pi * chance.uniform(key, seed, "angle", i)
        far = lambda i: least + (most - least) * chance.uniform(key, seed, "far", i)
        away = lambda p, i: F.array(F.element_at(p, 1) + far(i) * F.cos(turn(i)), F.element_at(p, 2) + far(i) * F.sin(turn(i)))
        pts = F.transform(track, lambda p, i: F.when(F.array_contains(chosen, i), away(p, i)).otherwise(p))
        return F.struct(pts.alias("pts"), chosen.alias("injected"))

    return C.let(at, thrown)


def fixes(xy: Column) -> Column:
    """A planar curve as fixes with coordinates to seven decimals."""
    place = lambda p: C.to_latlon(p, F.lit(LAT0), F.lit(LON0))
    return F.transform(xy, lambda p: C.let(place(p), lambda q: F.struct(F.round(q["lat"], 7).alias("lat"), F.round(q["lon"], 7).alias("lon"))))


def scenarios(spark: SparkSession, seed: int = 1) -> DataFrame:
    """id, title, expectation, delta_m, course, track (FIXES) and injected (indices of spikes) of the five demonstrations."""
    corners = loop()
    once, twice = _literal(corners), _literal(corners + corners[1:])
    cut = _literal([p for i, p in enumerate(corners) if i not in SKIPPED])
    rows = [
        ("clean", "A run with ordinary noise, a fix every 2 s", "on_course", 25.0),
        ("urban-canyon", "The same with six fixes thrown off by 70 to 240 m", "on_course_after_cleaning", 25.0),
        ("sparse-logging", "A fix every 30 s, too few for a discrete measure", "on_course", 30.0),
        ("shortcut", "A run that leaves out part of the loop", "off_course", 25.0),
        ("one-lap-of-two", "One lap of a course of two", "off_course", 25.0),
    ]
    d = spark.createDataFrame(rows, "id string, title string, expectation string, delta_m double")
    key = F.col("id")
    sparse = key == "sparse-logging"
    path = F.when(key == "shortcut", cut).otherwise(once)
    d = d.withColumn("_track", run(path, F.when(sparse, 30.0).otherwise(2.0), key, seed, F.when(sparse, 4.0).otherwise(3.0)))
    d = d.withColumn("_hit", spiked(F.col("_track"), key, seed))
    hit = key == "urban-canyon"
    d = d.withColumns({"track": fixes(F.when(hit, F.col("_hit.pts")).otherwise(F.col("_track"))), "course": fixes(F.when(key == "one-lap-of-two", twice).otherwise(once))})
    return d.withColumn("injected", F.when(hit, F.col("_hit.injected")).otherwise(F.array().cast("array<int>"))).select("id", "title", "expectation", "delta_m", "course", "track", "injected")
