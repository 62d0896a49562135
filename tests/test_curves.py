import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions import curves as C
from vertexloom.operators import edits, measures, retrieval
from vertexloom.operators.audit import audit
from vertexloom.sources import tracks


def pairs(spark, rows):
    wrap = lambda c: [[float(x)] for x in c]
    return spark.createDataFrame([(wrap(r), wrap(o)) for r, o in rows], "r array<array<double>>, o array<array<double>>")


def test_expressions_equal_kernels(spark):
    import random

    rng = random.Random(3)
    df = pairs(spark, [([rng.choice([0, 1, 2.5]) for _ in range(rng.randint(1, 4))], [rng.choice([0, 1, 2.5]) for _ in range(rng.randint(1, 4))]) for _ in range(60)])
    for mode in ("delete", "insert", "both"):
        got = edits.discrete_edits(df.withColumn("x", C.edit_cost(F.col("r"), F.col("o"), 0.5, mode)), "r", "o", 0.5, mode, witness=True)
        rows = edits.verify(got, "r", "o", 0.5, mode).select("x", "cost", "ok").collect()
        assert all(a.x == a.cost and (a.cost is None or a.ok) for a in rows)


def test_options_are_checked(spark):
    df = pairs(spark, [((0,), (0,))])
    with pytest.raises(ValueError):
        edits.discrete_edits(df, "r", "o", 0.0)
    with pytest.raises(NotImplementedError):
        edits.continuous_edits(df, "r", "o", 1.0, mode="insert")
    with pytest.raises(ValueError):
        C.smooth(F.col("r"), 4)


def test_retrieval_ties(spark):
    scored = spark.createDataFrame([("q", "m", t, s) for t, s in (("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0))], "query_id string, method string, template_id string, score double")
    relevant = spark.createDataFrame([("q", "c")], "query_id string, template_id string")
    r = retrieval.outcomes(scored, relevant, (1,)).first()
    assert (r.hit1_strict, r.hit1_expected, r.hit1_optimistic) == (0.0, 0.25, 1.0)
    assert abs(r.rr_expected - (1 + 1 / 2 + 1 / 3 + 1 / 4) / 4) < 1e-12 and r.rr_strict == 0.25


def test_tracks_and_audit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,lat,lon\n1,1.0,2.0\n\n2,1.0,2.001\n")
    (tmp_path / "b.geojson").write_text('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[2.0,1.0],[2.001,1.0]]}}')
    (tmp_path / "c.gpx").write_text('<gpx xmlns="x"><trk><trkseg><trkpt lat="1" lon="2"><time>t</time></trkpt><trkpt lat="1" lon="2.0005"/><trkpt lat="1.01" lon="2.0007"/><trkpt lat="1" lon="2.001"/></trkseg></trk></gpx>')
    got = tracks.read_tracks(spark, str(tmp_path))
    assert got.count() == 8
    assert tracks.gpx(tracks.gpx_text(got.where("path like '%gpx'")).first().gpx)[2][:2] == (1.01, 2.0007)
    with pytest.raises(ValueError):
        tracks.gpx("<!DOCTYPE x><gpx/>")
    one = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("t"))
    curve = lambda end: one.where(f"path like '%{end}'").select(F.transform("t", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("x"))
    r = audit(curve("geojson").select(F.col("x").alias("course")).crossJoin(curve("gpx").select(F.col("x").alias("track"))), 20.0).first()
    assert (r.verdict, r.cost, r.edits[0]["index"]) == ("on_course_after_cleaning", 1, 2)


def test_verification_is_exact_at_the_limit(spark):
    just = 1 + 2.0**-52
    rows = [([[0.0]], [[x]], "optimal", 0, "certified", [[x]], [], [(0, 0)]) for x in (1.0, just, 0.5)]
    kinds = "r array<array<double>>, o array<array<double>>, status string, cost int, witness_status string, edited_curve array<array<double>>, edits array<struct<op:string,index:int,gap:int,ord:int,point:array<double>>>, coupling array<struct<r:int,e:int>>"
    got = edits.verify(spark.createDataFrame(rows, kinds), "r", "o", 1.0, "both").collect()
    assert [r.ok for r in got] == [True, False, True]


def test_curves_without_vertices(spark):
    df = pairs(spark, [((), (0, 1)), ((0, 1), ()), ((), ()), ((0, 3, 0.5), ())])
    for kind in measures.MEASURES:
        got = [r.x for r in measures.measure(df, "r", "o", kind, "x", 1.0 if kind in ("edr", "lcss", "lcss_distance") else None).collect()]
        assert got == ([float("inf"), float("inf"), 0.0, float("inf")] if kind == "frechet" else [None] * 4)
    assert [r.x for r in df.select(C.discrete_frechet(F.col("r"), F.col("o")).alias("x")).collect()] == [float("inf"), float("inf"), 0.0, float("inf")]
    for mode, cost in (("delete", [2, None, 0, None]), ("insert", [None, 1, 0, 3]), ("both", [2, 1, 0, 3])):
        assert [r.cost for r in measures.edit_cost(df, "r", "o", 0.5, mode).collect()] == cost
        assert [r.cost for r in df.select(C.edit_cost(F.col("r"), F.col("o"), 0.5, mode).alias("cost")).collect()] == cost
    nulls = spark.createDataFrame([(None, [[1.0]])], "r array<array<double>>, o array<array<double>>")
    assert measures.measure(nulls, "r", "o", "dtw", "x").first().x is None and measures.edit_cost(nulls, "r", "o", 1.0, "both").first().cost is None


def test_batches_equal_expressions_and_kernels(spark):
    import random

    from vertexloom.kernels.discrete import solve

    rng = random.Random(8)
    draw = lambda: [[rng.choice([0.0, 0.5, 1.0, 2.5]), rng.choice([0.0, 1.0, 1.5])] for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(draw(), draw()) for _ in range(80)], "r array<array<double>>, o array<array<double>>").repartition(3)
    r, o = F.col("r"), F.col("o")
    own = {"frechet": C.discrete_frechet(r, o), "dtw": C.dtw(r, o), "dtw_normalized": C.dtw_normalized(r, o), "edr": C.edr(r, o, 1.0), "lcss": C.lcss(r, o, 1.0), "lcss_distance": C.lcss_distance(r, o, 1.0), "erp": C.erp(r, o)}
    for kind, column in own.items():
        for row in measures.measure(df.withColumn("e", column), "r", "o", kind, "x", 1.0 if kind in ("edr", "lcss", "lcss_distance") else None).collect():
            assert abs(row.x - row.e) < 1e-9, kind
    for mode in ("delete", "insert", "both"):
        for row in measures.edit_cost(df, "r", "o", 1.0, mode).collect():
            assert row.cost == solve(np.array(row.r), np.array(row.o), 1.0, mode)["cost"]


def test_costs_are_exact_at_the_limit(spark):
    df = pairs(spark, [((0,), (1,)), ((0,), (1 + 2.0**-52,))])
    assert [r.cost for r in measures.edit_cost(df, "r", "o", 1.0, "delete").collect()] == [0, None]
