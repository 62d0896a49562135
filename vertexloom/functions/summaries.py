"""Small summaries of arrays as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexloom.functions.curves import let


def nearest_rank(values: Column, share: float = 0.95) -> Column:
    """median, and as p95 the value at place int(share * n) of the sorted values, the last at most; NULLs without values."""

    def made(v: Column) -> Column:
        n = F.size(v)
        middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
        return F.struct(F.when(n > 0, middle).alias("median"), F.get(v, F.least(n - 1, F.floor(share * n).cast("int"))).alias("p95"))

    return let(F.array_sort(values), made)


def unique_points(pts: Column) -> Column:
    """points: the distinct vertices in order; inverse: the place of each vertex among them."""
    return let(F.array_sort(F.array_distinct(pts)), lambda u: F.struct(u.alias("points"), F.transform(pts, lambda p: (F.array_position(u, p) - 1).cast("int")).alias("inverse")))
