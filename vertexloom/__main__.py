"""Commands: python -m vertexloom edits | audit | evaluate | report | samples | grid | rank."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import grids
from vertexloom.operators import audit, edits, experiment, gallery, scenarios
from vertexloom.sources import tracks


def curve(text: str) -> list[list[float]]:
    """Vertices apart by spaces or semicolons, coordinates by colons; commas part the vertices of one dimension: "0,1,2" or "0:0 1:2"."""
    return [[float(x) for x in p.split(":")] for p in text.replace(";", " ").replace(",", " ").split()]


def _pair(spark: SparkSession, ref: str, obs: str) -> DataFrame:
    return spark.createDataFrame([(curve(ref), curve(obs))], "ref array<array<double>>, obs array<array<double>>")


def _show(rows: DataFrame) -> None:
    for line in [r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()]:
        print(line)


def run_edits(spark, a) -> None:
    pairs = _pair(spark, a.ref, a.obs)
    if a.continuous:
        got = edits.continuous_edits(pairs, "ref", "obs", a.delta, witness=True, max_deletions=a.most)
    else:
        got = edits.discrete_edits(pairs, "ref", "obs", a.delta, a.mode, witness=True)
    _show(got.drop("ref", "obs"))


def run_grid(spark, a) -> None:
    d = _pair(spark, a.ref, a.obs).withColumn("free", grids.free_space(F.col("ref"), F.col("obs"), a.delta, a.size))
    d = d.withColumn("reach", grids.reachable(F.col("free"))).withColumn("path", grids.monotone_path(F.col("reach")))
    r = d.first()
    on = {(p["s"], p["t"]) for p in r.path or ()}
    for t in range(a.size - 1, -1, -1):
        print("".join("o" if (s, t) in on else "+" if r.reach[t][s] else "." if r.free[t][s] else "#" for s in range(a.size)))


def _one_track(spark, path: str, name: str) -> DataFrame:
    fixes = tracks.read_tracks(spark, path)
    row = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return fixes.groupBy("path").agg(row.alias(name)).limit(1).select(name, F.lit(1).alias("id"))


def run_audit(spark, a) -> None:
    pairs = _one_track(spark, a.course, "course").join(_one_track(spark, a.track, "track"), "id")
    _show(audit.audit(pairs, a.delta, "id").drop("id", "course", "track", "offsets", "coverage"))


def run_samples(spark, a) -> None:
    """Courses as GeoJSON and GPX, tracks as CSV and GPX, of the five scenarios."""
    d = scenarios.scenarios(spark)
    Path(a.folder).mkdir(parents=True, exist_ok=True)
    for what, writers in (("course", ("geojson", "gpx")), ("track", ("csv", "gpx"))):
        fixes = d.select(F.concat_ws("-", "id", F.lit(what)).alias("path"), F.posexplode(what).alias("idx", "p")).select("path", "idx", "p.*", F.lit(None).cast("string").alias("time"))
        for kind in writers:
            for r in getattr(tracks, f"{kind}_text")(fixes).collect():
                (Path(a.folder) / f"{r.path}.{kind}").write_text(r[kind], encoding="utf-8")


def run_evaluate(spark, a) -> None:
    c = experiment.load_config(a.config) if a.config else {}
    seed, n_points = c.get("seed", 0), c.get("n_points", 40)
    routes = gallery.gallery(gallery.bases(spark, c.get("families", 6), n_points, seed), seed).cache()
    asked = gallery.queries(routes, c.get("per_route", 2), c.get("spikes", 2), c.get("magnitude", 150.0), c.get("sigma", 2.0), c.get("open", 4), n_points, seed).cache()
    scored = experiment.scores(asked, routes, c.get("delta", 25.0), c.get("eps"), tuple(c.get("methods", experiment.METHODS)), c.get("window", 3))
    out, summary = experiment.evaluate(asked, routes, scored, c.get("validation", 2), c.get("quantile", 0.95))
    experiment.write_run(out, summary, a.folder)
    print(experiment.report(summary, gallery=routes))


def run_report(spark, a) -> None:
    print(experiment.report(experiment.read_run(spark, a.folder)[1]))


def run_rank(spark, a) -> None:
    """A damaged route looked up in a gallery: the nearest routes, and the repair of the best."""
    routes = gallery.gallery(gallery.bases(spark, a.families, seed=a.seed), a.seed)
    asked = gallery.queries(routes, per_route=1, n_open=0, seed=a.seed).orderBy("query_id").limit(1)
    _show(experiment.best_routes(asked, routes, a.delta, a.top).drop("query", "template", "edited_curve", "coupling"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("vertexloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        c = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        c.set_defaults(run=run)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    delta = (("--delta",), {"type": float, "default": 25.0})
    pair = (("ref",), {}), (("obs",), {})
    command("edits", run_edits, *pair, delta, (("--mode",), {"default": "both", "choices": ["delete", "insert", "both"]}), (("--continuous",), {"action": "store_true"}), (("--most",), {"type": int}))
    command("grid", run_grid, *pair, delta, (("--size",), {"type": int, "default": 32}))
    command("audit", run_audit, (("course",), {}), (("track",), {}), delta)
    command("samples", run_samples, (("folder",), {}))
    command("evaluate", run_evaluate, (("folder",), {}), (("--config",), {}))
    command("report", run_report, (("folder",), {}))
    command("rank", run_rank, delta, (("--families",), {"type": int, "default": 6}), (("--seed",), {"type": int, "default": 0}), (("--top",), {"type": int, "default": 3}))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    session = spark or SparkSession.builder.appName("vertexloom").getOrCreate()
    try:
        a.run(session, a)
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
