"""Random numbers as Columns that depend on a key and a seed alone, never on partitions or row order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(key: Column, seed: int, stream: str, *index: Column) -> Column:
    """A long of 32 random bits: the first eight hex digits of the MD5 of seed:stream:key:index..."""
    name = F.concat_ws(":", F.lit(f"{seed}:{stream}"), key.cast("string"), *[i.cast("string") for i in index])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int, stream: str, *index: Column) -> Column:
    """Within (0, 1)."""
    return (bits(key, seed, stream, *index) + 0.5) / F.lit(2.0**32)


def normal(key: Column, seed: int, stream: str, *index: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(key, seed, stream + "r", *index))) * F.cos(2 * math.pi * uniform(key, seed, stream + "a", *index))


def direction(key: Column, seed: int, stream: str, dim: Column, *index: Column) -> Column:
    """A unit vector of dim coordinates, uniform over directions."""
    from vertexloom.functions.curves import let

    raw = F.transform(F.sequence(F.lit(0), dim - 1), lambda c: normal(key, seed, stream, *index, c))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(raw, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def pick(pool: Column, n: Column | int, key: Column, seed: int, stream: str) -> Column:
    """n entries of an int array without return, ascending."""
    count = n if isinstance(n, Column) else F.lit(n)
    drawn = F.array_sort(F.transform(pool, lambda i: F.struct(bits(key, seed, stream, i).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(drawn, F.lit(1), count), lambda x: x["i"]))
