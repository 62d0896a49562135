"""Galleries of look-alike routes and damaged queries, for retrieval experiments; random by key and seed alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import chance, corruptions
from vertexloom.functions import curves as C

KINDS = ("base", "corridor", "shared_endpoint", "partial_overlap", "detour")


def _towards(p: Column, heading: Column, step: float) -> Column:
    return F.array(F.element_at(p, 1) + step * F.cos(heading), F.element_at(p, 2) + step * F.sin(heading))


def route(key: Column, seed: int, n: Column | int, origin: Column, step: float = 10.0, turn: float = 0.22) -> Column:
    """A walk of n vertices that keeps its heading but for normal turns."""
    count = n if isinstance(n, Column) else F.lit(n)
    state = lambda h, pts: F.struct(h.alias("h"), pts.alias("pts"))
    start = state(2 * math.pi * chance.uniform(key, seed, "heading"), F.array(origin))

    def walk(s: Column, i: Column) -> Column:
        return C.let(s["h"] + turn * chance.normal(key, seed, "turn", i), lambda h: state(h, F.concat(s["pts"], F.array(_towards(F.element_at(s["pts"], -1), h, step)))))

    more = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, start, walk, lambda s: s["pts"])


def shared_endpoint(pts: Column, key: Column, seed: int, bulge: float) -> Column:
    """Ends as pts, an arc of height bulge between, on either side."""
    a, b, n = F.element_at(pts, 1), F.element_at(pts, -1), F.size(pts)
    side = F.when(chance.bits(key, seed, "side") % 2 == 0, F.lit(-bulge)).otherwise(F.lit(bulge))
    dx, dy = F.element_at(b, 1) - F.element_at(a, 1), F.element_at(b, 2) - F.element_at(a, 2)
    size = F.sqrt(dx * dx + dy * dy)
    up = F.when(size == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.try_divide(-dy, size), F.try_divide(dx, size)))

    def at(i: Column, up: Column) -> Column:
        t = i / F.greatest(n - 1, F.lit(1))
        height = F.sin(math.pi * t) * side
        return F.array(F.element_at(a, 1) + t * dx + height * F.element_at(up, 1), F.element_at(a, 2) + t * dy + height * F.element_at(up, 2))

    return C.let(up, lambda up: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, up)))


def partial_overlap(pts: Column, key: Column, seed: int, keep: float = 0.5) -> Column:
    """The head of pts, then a walk of its own; as many vertices as pts."""
    split = F.least(F.size(pts), F.greatest(F.lit(2), F.floor(F.size(pts) * keep).cast("int")))

    def joined(split: Column) -> Column:
        head = F.slice(pts, F.lit(1), split)
        tail = route(key, seed, F.size(pts) - split + 1, F.element_at(head, -1))
        return F.concat(head, F.slice(tail, F.lit(2), F.size(pts) - split))

    return C.let(split, joined)


def detour(pts: Column, key: Column, seed: int, magnitude: float, length: int = 3) -> Column:
    """pts with an excursion of length vertices put in at its middle."""
    at = F.floor(F.size(pts) / 2).cast("int")
    rise = [0.4 + 0.6 * k / max(1, length - 1) for k in range(length)]
    away = lambda v: F.transform(F.array(*map(F.lit, rise)), lambda r: F.zip_with(F.get(pts, at), v, lambda x, d: x + magnitude * r * d))
    out = C.let(chance.direction(key, seed, "detour", F.size(F.element_at(pts, 1))), away)
    return F.concat(F.slice(pts, F.lit(1), at), out, F.slice(pts, at + 1, F.size(pts)))


def bases(spark: SparkSession, n: int, n_points: int = 40, seed: int = 0) -> DataFrame:
    """family and pts of n planar walks."""
    d = spark.range(n).select(F.format_string("fam%02d", "id").alias("family"))
    origin = F.array(*[1000 * chance.uniform(F.col("family"), seed, f"origin{c}") - 500 for c in "xy"])
    return d.select("family", route(F.col("family"), seed, n_points, origin).alias("pts"))


def gallery(bases: DataFrame, seed: int = 0, offset: float = 30.0, bulge: float = 120.0, magnitude: float = 90.0) -> DataFrame:
    """route_id, kind, family, pts: each base (family, planar pts) and four that look like it."""
    p, k = F.col("pts"), F.col("family")
    made = (p, C.offset(p, offset), shared_endpoint(p, k, seed, bulge), partial_overlap(p, k, seed + 1), detour(p, k, seed, magnitude))
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("pts")) for kind, c in zip(KINDS, made, strict=True)])
    d = bases.select("family", F.explode(rows).alias("r"))
    return d.select(F.concat_ws("-", F.col("family").cast("string"), "r.kind").alias("route_id"), "r.kind", F.col("family").cast("string").alias("family"), "r.pts")


def queries(gallery: DataFrame, per_route: int = 2, n_spikes: int = 2, magnitude: float = 150.0, sigma: float = 2.0, n_open: int = 4, n_points: int = 40, seed: int = 0) -> DataFrame:
    """query_id, relevant, pts, record, open_set: damaged bases, and n_open walks far from every route."""
    spark = gallery.sparkSession
    d = gallery.where("kind = 'base'").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(per_route - 1))))
    d = d.withColumn("query_id", F.format_string("%s-q%d", "route_id", "rep"))
    d = d.withColumn("hurt", corruptions.spike(F.col("pts"), F.col("query_id"), seed, n_spikes, magnitude))
    noisy = corruptions.jitter(F.col("hurt.pts"), F.col("query_id"), seed, sigma)["pts"]
    closed = d.select("query_id", F.array("route_id").alias("relevant"), noisy.alias("pts"), F.col("hurt.record").alias("record"), F.lit(False).alias("open_set"))
    far = spark.range(n_open).select(F.format_string("openset-q%d", "id").alias("query_id"))
    origin = F.array(*[50_000 + 10_000 * chance.uniform(F.col("query_id"), seed, f"origin{c}") for c in "xy"])
    strangers = far.select("query_id", F.array().cast("array<string>").alias("relevant"), route(F.col("query_id"), seed, n_points, origin).alias("pts"), F.lit(True).alias("open_set"))
    return closed.unionByName(strangers, allowMissingColumns=True)
