"""Audit of tracks against courses: projection, simplification, repair, offsets, a check and a verdict, one row per pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import curves as C
from vertexloom.operators import continuous
from vertexloom.operators.edits import continuous_edits, discrete_edits
from vertexloom.session import deal, settle, ship

MOST_LATITUDE, MOST_EXTENT = 80.0, 100_000.0
LEAST_DELTA, MOST_DELTA = 1.0, 1_000.0


def fix_problems(fixes: Column, what: str) -> Column:
    """The first reason why an array of fixes can't be audited, or NULL."""
    n = F.size(fixes)
    bad = lambda x, most: x.isNull() | F.isnan(x) | (F.abs(x) > most)
    return (
        F.when(fixes.isNull() | (n < 2), f"the {what} needs two fixes")
        .when(F.exists(fixes, lambda p: bad(p["lat"], MOST_LATITUDE) | bad(p["lon"], 180.0)), f"the {what} leaves the range of coordinates")
    )


def distances(pairs: DataFrame, course: str, track: str) -> DataFrame:
    """pairs with offsets (of track vertices to the course) and coverage (of course vertices to the track)."""
    ship(pairs.sparkSession)

    @F.pandas_udf("offsets array<double>, coverage array<double>")
    def measure(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import numpy as np

        from vertexloom.kernels.simplify import line_distances

        pts = lambda c: np.array([list(p) for p in c], dtype=np.float64)
        both = [(pts(a), pts(b)) for a, b in zip(x, y, strict=True)]
        return pd.DataFrame({"offsets": [line_distances(o, r).tolist() for r, o in both], "coverage": [line_distances(r, o).tolist() for r, o in both]})

    d = pairs.withColumn("_near", measure(F.col(course), F.col(track)))
    return d.withColumns({"offsets": F.col("_near.offsets"), "coverage": F.col("_near.coverage")}).drop("_near")


def audit(pairs: DataFrame, delta: float, deal_by: str | None = None) -> DataFrame:
    """pairs of course and track (array<struct<lat,lon>>) with problem, verdict, reasons, glitches and checks.

    Both are projected to a plane around the middle of their common box, and judged by all their fixes, however many.
    on_course: nothing to delete; on_course_after_cleaning: up to a quarter of the fixes deleted; off_course, with
    reasons; pairs that can't be audited keep only a problem. Every witness is checked. deal_by names a column that
    spreads the pairs over the kernels' tasks; without it they are dealt in turn.
    """
    if not LEAST_DELTA <= delta <= MOST_DELTA:
        raise ValueError(f"delta must be from {LEAST_DELTA:g} to {MOST_DELTA:g} metres")
    names, pairs = pairs.columns, settle(pairs)
    both = F.concat("course", "track")
    first = F.element_at("course", 1)["lon"]
    lats, easts = F.transform(both, lambda p: p["lat"]), F.transform(both, lambda p: F.pmod(p["lon"] - first + 180, F.lit(360.0)) - 180)
    sides = {"s": F.array_min(lats), "n": F.array_max(lats), "w": F.array_min(easts), "e": F.array_max(easts)}
    d = settle(pairs.withColumn("_box", F.struct(*[c.alias(k) for k, c in sides.items()])))
    d = d.withColumns({"lat0": (F.col("_box.s") + F.col("_box.n")) / 2, "lon0": first + (F.col("_box.w") + F.col("_box.e")) / 2})
    # The span comes from the box, not from projected fixes: the filter below is pushed under the projection and would repeat it.
    east, north = F.radians(F.col("_box.e") - F.col("_box.w")) * F.cos(F.radians("lat0")), F.radians(F.col("_box.n") - F.col("_box.s"))
    wide = F.sqrt(east * east + north * north) * C.EARTH > MOST_EXTENT
    reasons = (fix_problems(F.col("course"), "course"), fix_problems(F.col("track"), "track"), F.when(wide, f"the two span more than {MOST_EXTENT / 1000:g} km"))
    d = settle(d.withColumn("problem", F.coalesce(*reasons)).drop("_box"))
    refused, d = d.where("problem is not null").select(*names, "problem"), d.where("problem is null")
    # Rows are small and kernels costly: a stated number of partitions, which adaptive execution leaves alone.
    d = deal(d, *([deal_by] if deal_by else []))
    xy = lambda c: F.transform(c, lambda p: C.to_xy(p["lat"], p["lon"], F.col("lat0"), F.col("lon0")))
    d = d.withColumns({"_r": xy("course"), "_o": xy("track")})
    d = d.withColumn("scale_error", C.projection_scale_error(F.transform(both, lambda p: p["lat"]), F.col("lat0")))

    d = d.withColumn("glitch_budget", F.greatest(F.lit(1), F.floor(F.size("_o") / 4).cast("int")))
    inner = discrete_edits(d, "_r", "_o", delta, "delete")
    d = inner.withColumns({"discrete_cost": F.col("cost"), "discrete_status": F.col("status")}).drop("status", "cost", "witness_status", "edited_curve", "edits", "coupling", "detail", "counters")
    d = continuous_edits(d, "_r", "_o", delta, witness=True, max_deletions="glitch_budget")
    d = distances(d, "_r", "_o")
    found = F.col("witness_status") == "certified"
    d = continuous.verify(d, "_r", "_o", delta)
    d = d.withColumn("verification", F.when(~found, "not_applicable").when(F.col("ok"), "verified").otherwise("failed"))

    fix = lambda i: F.get("track", i)
    glitch = lambda e: F.struct(e["index"].alias("index"), fix(e["index"])["lat"].alias("lat"), fix(e["index"])["lon"].alias("lon"), F.round(F.get("offsets", e["index"]), 1).alias("offset_m"))
    cleaned = F.filter("track", lambda p, k: ~F.exists("edits", lambda e: e["index"] == k))
    d = d.withColumns({
        "glitches": F.transform("edits", glitch),
        "cleaned_track": F.when(found, cleaned),
        "fixes_near_course": F.array_max("offsets") <= delta,
        "course_covered": F.array_max("coverage") <= delta,
        "uncovered": F.size(F.filter("coverage", lambda x: x > delta)),
        "off_corridor": F.filter(F.transform("offsets", lambda x, k: F.when(x > delta, k)), lambda x: x.isNotNull()),
        "off_run": C.longest_run(F.transform("offsets", lambda x: x > delta)),
    })
    ran = C.path_length(F.slice("_o", F.col("off_run.start") + 1, F.greatest(F.col("off_run.length"), F.lit(1))))
    reasons = F.array_compact(F.array(
        F.when(F.col("uncovered") > 0, F.format_string("%d course vertices are never approached", "uncovered")),
        F.when(F.col("off_run.length") > 1, F.format_string("%d fixes in a row (%.0f m) are off the corridor", "off_run.length", ran)),
    ))
    order = F.array(F.lit("all is near, but not in the right order or number of times"))
    code = F.when(F.col("cost") == 0, "on_course").when(F.col("cost").isNotNull(), "on_course_after_cleaning").otherwise("off_course")
    d = d.withColumns({"verdict": code, "reasons": F.when(F.col("cost").isNull(), F.when(F.size(reasons) > 0, reasons).otherwise(order))})
    d = d.drop("_r", "_o", "lat0", "lon0", "ok", "coupling", "edited_curve")
    return d.unionByName(refused, allowMissingColumns=True)
