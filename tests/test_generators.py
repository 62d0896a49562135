import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions import corruptions as K
from vertexloom.functions import curves as C
from vertexloom.functions import grids as G
from vertexloom.kernels import checker, floatfrechet, simplify
from vertexloom.operators import continuous, edits, experiment, gallery, selection


def curve(spark, pts):
    return spark.createDataFrame([("k", [[float(x) for x in p] for p in pts])], "key string, pts array<array<double>>")


LINE = [(i * 10.0, 0.0) for i in range(12)]


@pytest.mark.parametrize(
    "name,args,injected",
    [("spike", (3, 5.0), 3), ("burst", (4, 5.0), 4), ("drop_samples", (0.25,), 2), ("jitter", (1.0,), 0), ("resample", (3.0,), 22), ("resample", (0.5,), 5), ("prefix_suffix_noise", (2,), 4)],
)
def test_damage_is_recorded_and_repeatable(spark, name, args, injected):
    d = curve(spark, LINE).select("pts", getattr(K, name)(F.col("pts"), F.col("key"), 7, *args).alias("r"))
    got = d.select("r.*", K.consistent(F.col("r.record")).alias("fine"), K.affected(F.col("r.record")).alias("hit")).first()
    assert got == d.select("r.*", K.consistent(F.col("r.record")).alias("fine"), K.affected(F.col("r.record")).alias("hit")).first()
    rec = got.record
    assert got.fine and rec.n_injected == injected and rec.operator == name
    assert len(got.pts) == rec.corrupted_length == len(rec.output_to_original)
    for p, src in zip(got.pts, rec.output_to_original, strict=True):
        if src is not None and src not in rec.displaced:
            assert tuple(p) == LINE[src]
        elif src is not None and name in ("spike", "burst"):
            assert abs(math.dist(p, LINE[src]) - 5.0) < 1e-9
    if name in ("spike", "burst", "drop_samples"):
        assert not {0, 11} & set(got.hit)


def test_damage_beyond_the_pool_fails(spark):
    with pytest.raises(Exception, match="eligible"):
        curve(spark, LINE[:3]).select(K.spike(F.col("pts"), F.col("key"), 1, 2, 1.0)).collect()
    with pytest.raises(ValueError):
        K.drop_samples(F.col("pts"), F.col("key"), 1, 1.5)


def test_pipeline_composes_maps(spark):
    steps = [lambda p: K.prefix_suffix_noise(p, F.col("key"), 1, 1), lambda p: K.drop_samples(p, F.col("key"), 1, 0.5)]
    r = K.apply_pipeline(curve(spark, LINE), steps).first()
    assert len(r.records) == 2 and len(r.output_to_original) == len(r.pts)
    assert all(tuple(p) == LINE[i] for p, i in zip(r.pts, r.output_to_original, strict=True) if i is not None)


def test_normals_and_arc_resampling(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(9, 2)).cumsum(0)
    t = np.gradient(pts, axis=0)
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    cum = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(pts, axis=0), axis=1))])
    d = curve(spark, pts.tolist()).select(C.offset(F.col("pts"), 2.0).alias("o"), C.arc_resample(F.col("pts"), 7).alias("r"), C.arc_resample(F.col("pts"), 4, 0.5).alias("s"), C.arc_resample(F.col("pts"), 4, 500.0).alias("none")).first()
    assert np.allclose(d.o, pts + 2 * np.stack([-t[:, 1], t[:, 0]], 1))
    for got, at in ((d.r, np.linspace(0, cum[-1], 7)), (d.s, np.arange(4) * 0.5)):
        assert np.allclose(got, np.column_stack([np.interp(at, cum, pts[:, c]) for c in (0, 1)]))
    assert d.none is None


def test_grids(spark):
    a, b = [(0.0,), (4.0,), (1.0,)], [(0.5,), (3.0,), (1.5,), (1.0,)]
    both = spark.createDataFrame([([list(p) for p in a], [list(p) for p in b])], "a array<array<double>>, b array<array<double>>")
    both = both.withColumn("free", G.free_space(F.col("a"), F.col("b"), 1.1, 9)).withColumn("reach", G.reachable(F.col("free"))).withColumn("path", G.monotone_path(F.col("reach")))
    r = both.first()
    at = lambda c: np.interp(np.linspace(0, len(c) - 1, 9), range(len(c)), [p[0] for p in c])
    free = np.abs(at(b)[:, None] - at(a)[None, :]) <= 1.1
    assert (np.array(r.free) == free).all()
    reach = np.zeros_like(free)
    for t in range(9):
        for s in range(9):
            came = (t, s) == (0, 0) or any(x >= 0 and y >= 0 and reach[x, y] for x, y in ((t - 1, s), (t, s - 1), (t - 1, s - 1)))
            reach[t, s] = free[t, s] and came
    assert (np.array(r.reach) == reach).all()
    assert (r.path is not None) == reach[8, 8] and (r.path is None or (tuple(r.path[0]) == (0, 0) and tuple(r.path[-1]) == (8, 8)))


def test_float_decision_agrees_with_the_exact_one():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (np.array([[rng.randint(0, 4) / 1.0, rng.randint(0, 4) + 0.25] for _ in range(rng.randint(1, 5))]) for _ in range(2))
        eps = rng.choice([0.7, 1.3, 2.1, 3.3])
        assert floatfrechet.within(a, b, eps) == checker.continuous_within(a, b, eps)


def test_continuous_distance(spark):
    pairs = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0]], [[0.0, 1.0], [3.0, 2.0], [10.0, 1.0]]), ([[0.0, 0.0]], [[3.0, 4.0]])], "a array<array<double>>, b array<array<double>>")
    rows = continuous.within(continuous.distance(pairs, "a", "b"), "a", "b", 2.0).collect()
    assert abs(rows[0].distance - 2.0) < 1e-8 and rows[0]["within"]
    assert rows[1].distance == 5.0 and not rows[1]["within"]


def test_continuous_scripts_verify(spark):
    pairs = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0]], [[0.0, 0.0], [2.0, 0.1], [5.0, 30.0], [8.0, 0.0], [10.0, 0.0]])], "r array<array<double>>, o array<array<double>>")
    d = continuous.verify(edits.continuous_edits(pairs, "r", "o", 1.0, witness=True), "r", "o", 1.0)
    assert (d.first().cost, d.first().ok) == (1, True)
    bad = d.drop("ok").withColumn("cost", F.lit(2))
    assert continuous.verify(bad, "r", "o", 1.0).first().ok is False


def test_simplification():
    t = np.linspace(0, 20, 2000)
    pts = np.column_stack([t * 50, np.sin(t) * 100])
    kept, tol = simplify.simplify_to(pts, 150, 25.0)
    assert len(kept) <= 150 and kept[0] == 0 and kept[-1] == 1999 and 0 < tol <= 25
    for a, b in zip(kept, kept[1:], strict=False):
        if b - a > 1:
            assert simplify.chord_distances(pts[a + 1 : b], pts[a], pts[b]).max() <= tol
    with pytest.raises(ValueError):
        simplify.simplify_to(np.column_stack([np.arange(500.0), np.arange(500) % 2 * 1000.0]), 150, 5.0)


def test_experiment(spark, tmp_path):
    g = gallery.gallery(gallery.bases(spark, 4, 20), 3).cache()
    assert g.groupBy("kind").count().count() == 5 and g.count() == 20
    twin = {r.kind: r.pts for r in g.where("family = 'fam00'").collect()}
    assert len(twin["detour"]) == 23 and len(twin["partial_overlap"]) == 20 and np.allclose(twin["shared_endpoint"][-1], twin["base"][-1], atol=1e-9)
    q = gallery.queries(g, per_route=1, n_open=1, n_points=20).cache()
    s = experiment.scores(q, g, 25.0, methods=("fed_delete", "frechet", "edr")).cache()
    assert s.count() == 5 * 20 * 3
    out, summary = experiment.evaluate(q, g, s, n_validation=2)
    rows = {r.method: r for r in summary.collect()}
    assert rows["fed_delete"].n_queries == 2 and rows["fed_delete"].hit1_strict == 1.0 and rows["edr"].n_open_set == 1
    assert rows["fed_delete"].false_match_rate == 0.0
    text = experiment.report(summary)
    assert text.index("| edr") < text.index("| frechet") or rows["frechet"].hit1_strict == 1.0
    with pytest.raises(ValueError):
        experiment.report(summary.drop("coverage"))
    experiment.write_run(out, summary, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "summary")).count() == 3


def test_selection(spark):
    rows = [(p, i, 10.0 + 0.0005 * i, lon + 0.0001 * i) for p, lon, n in (("a", 10.0, 60), ("b", 10.001, 60), ("c", 11.0, 60), ("d", 12.0, 20)) for i in range(n)]
    found = selection.candidates(spark.createDataFrame(rows, "path string, idx int, lat double, lon double"))
    assert sorted(r.path for r in selection.choose(found, 2).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        selection.choose(found, 3)
