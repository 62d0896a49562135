"""Choosing well-separated tracks: acceptance per track in Spark, the greedy choice over a bounded list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import curves as C

LEAST_POINTS, LEAST_EXTENT, MOST_GAP, LEAST_APART = 50, 300.0, 2000.0, 5000.0
EARTH = 6_371_000.0


def candidates(fixes: DataFrame, n_points: int = 40, spacing: float | None = 10.0) -> DataFrame:
    """Per path of (path, idx, lat, lon): raw_points, centre, extent, the resampled curve, and whether it is acceptable."""
    g = fixes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("f"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("raw_points"))
    d = g.withColumn("_xy", F.transform("f", lambda p: C.to_xy(p["lat"], p["lon"], F.col("lat"), F.col("lon"), EARTH)))
    d = d.withColumns({"extent": C.extent(F.col("_xy")), "_gap": C.longest_step(F.col("_xy")), "pts": C.arc_resample(F.col("_xy"), n_points, spacing)})
    fine = (F.col("raw_points") >= LEAST_POINTS) & (F.col("extent") >= LEAST_EXTENT) & (F.col("_gap") <= MOST_GAP) & F.col("pts").isNotNull()
    return d.withColumn("acceptable", fine).drop("f", "_xy", "_gap")


def choose(found: DataFrame, n: int, apart: float = LEAST_APART, most_scanned: int = 4000) -> DataFrame:
    """The first n acceptable tracks by path of which no two centres are closer than apart metres.

    Which are taken depends on those before, so centres of the first most_scanned paths (a stated limit of
    this operator) come to the driver. Fewer than n are an error.
    """
    if n < 1:
        raise ValueError("n must be positive")
    from math import asin, cos, radians, sin, sqrt

    def far(a, b) -> bool:
        h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
        return 2 * EARTH * asin(sqrt(min(1.0, h))) >= apart

    taken: dict[str, tuple[float, float]] = {}
    for r in found.select("path", "lat", "lon", "acceptable").orderBy("path").limit(most_scanned).where("acceptable").collect():
        if len(taken) < n and all(far((r.lat, r.lon), c) for c in taken.values()):
            taken[r.path] = (r.lat, r.lon)
    if len(taken) < n:
        raise ValueError(f"{len(taken)} acceptable tracks found, {n} wanted")
    return found.where(F.col("path").isin(list(taken)))
