import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vertexloom import __main__ as commands
from vertexloom.operators import audit, scenarios
from vertexloom.sources import tracks


def fixes(df):
    return [(r.idx, r.lat, r.lon, r.time) for r in df.orderBy("path", "idx").collect()]


def read(spark, folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return tracks.read_tracks(spark, str(folder), name)


def test_delimited_files(spark, tmp_path):
    assert fixes(read(spark, tmp_path, "a.csv", "Latitude, LNG ,timestamp\n1.5,2.5,  t1 \n\n , ,\n-3,4,\n")) == [(0, 1.5, 2.5, "t1"), (1, -3.0, 4.0, None)]
    assert fixes(read(spark, tmp_path, "b.txt", "1,2\r\n3,4\r\n")) == [(0, 1.0, 2.0, None), (1, 3.0, 4.0, None)]
    assert fixes(read(spark, tmp_path, "c.csv", '﻿time,lon,lat\n"a, ""b""",5,6\n')) == [(0, 6.0, 5.0, 'a, "b"')]
    for bad in ("lat,lon\n1,x\n", "lat,lon\n91,0\n", "lat,lon\n1\n"):
        with pytest.raises(Exception, match="no coordinate"):
            read(spark, tmp_path, "bad.csv", bad).collect()


def test_logger_files_and_archives(spark, tmp_path):
    plt = "a\nb\nc\nd\ne\nf\n" + "1.0,2.0,0,1\nbad\n95,2\n3.0,4.0,0,1\n"
    assert fixes(read(spark, tmp_path, "x.plt", plt)) == [(0, 1.0, 2.0, None), (1, 3.0, 4.0, None)]
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("b/2.plt", plt)
        z.writestr("a/1.csv", "lat,lon\n7,8\n")
    got = tracks.read_tracks(spark, str(tmp_path), "*.zip")
    assert [(r.path.rpartition("!")[2], r.lat) for r in got.orderBy("path", "idx").collect()] == [("a/1.csv", 7.0), ("b/2.plt", 1.0), ("b/2.plt", 3.0)]


def test_kinds_by_content(spark, tmp_path):
    assert fixes(read(spark, tmp_path, "noname", ' {"type":"LineString","coordinates":[[1,2],[3,4]]}')) == [(0, 2.0, 1.0, None), (1, 4.0, 3.0, None)]
    with pytest.raises(Exception, match="unknown track format"):
        read(spark, tmp_path, "odd.bin", "hello").collect()


def test_writers_round_trip(spark, tmp_path):
    rows = [("t & <u>", i, 1.0 + i / 7, 2.0 - i / 3, 'x "y", z' if i else None) for i in range(5)]
    made = spark.createDataFrame(rows, "path string, idx int, lat double, lon double, time string")
    expected = [(i, round(lat, 7), round(lon, 7), t) for _, i, lat, lon, t in rows]
    for kind in ("csv", "gpx", "geojson"):
        text = getattr(tracks, f"{kind}_text")(made).first()[kind]
        got = fixes(read(spark, tmp_path, f"r.{kind}", text))
        assert got == [(i, lat, lon, t if kind != "geojson" else None) for i, lat, lon, t in expected], kind


def test_scenarios(spark):
    d = scenarios.scenarios(spark).cache()
    for delta in (25.0, 30.0):
        for r in audit.audit(d.where(F.col("delta_m") == delta), delta, "id").collect():
            assert r.verdict == r.expectation
            assert [g["index"] for g in r.glitches] == r.injected
            assert r.verification == ("not_applicable" if r.verdict == "off_course" else "verified")
            if r.id == "one-lap-of-two":
                assert r.fixes_near_course and r.course_covered and "order" in r.reasons[0]
            if r.id == "shortcut":
                assert not r.course_covered and r.off_corridor and r.cleaned_track is None
            if r.id == "sparse-logging":
                assert r.discrete_status == "infeasible" and r.cost == 0
            if r.id == "urban-canyon":
                assert len(r.cleaned_track) == len(r.track) - 6 and r.cost <= r.discrete_cost


def test_audit_refuses(spark):
    d = scenarios.scenarios(spark).where("id = 'clean'")
    for bad in (0.5, 1001.0):
        with pytest.raises(ValueError):
            audit.audit(d, bad)
    few = audit.audit(d.withColumn("track", F.slice("track", 1, 1)), 25.0).first()
    assert few.verdict is None and "two fixes" in few.problem


def test_audit_looks_at_all_fixes(spark):
    """A zigzag course of 201 corners that can't be simplified, and a track of 1,001 fixes of which 40 odd ones are far off: none may be left out."""
    corners = [[100.0 * i, 100.0 * (i % 2)] for i in range(201)]
    far = set(range(13, 1001, 25))
    on = [[20.0 * i, 100.0 - abs(100.0 - 20.0 * i % 200.0)] for i in range(1001)]
    track = [[x, y + 1000.0 * (i in far)] for i, (x, y) in enumerate(on)]
    d = spark.createDataFrame([(1, corners, track)], "id long, c array<array<double>>, t array<array<double>>")
    d = d.select("id", scenarios.fixes(F.col("c")).alias("course"), scenarios.fixes(F.col("t")).alias("track"))
    r = audit.audit(d, 25.0, "id").first()
    assert (r.verdict, r.cost, r.verification) == ("on_course_after_cleaning", len(far), "verified")
    assert [g["index"] for g in r.glitches] == sorted(far) and len(r.cleaned_track) == 1001 - len(far)
    assert len(r.offsets) == 1001 and r.off_corridor == sorted(far)


def test_commands(spark, tmp_path, capsys):
    commands.main(["edits", "0,1,2", "0,1,100,2", "--delta", "0.1"], spark)
    got = json.loads(capsys.readouterr().out)
    assert (got["cost"], got["edits"][0]["index"]) == (1, 2) and got["counters"]["points"] == 12
    commands.main(["edits", "0:0 10:0", "0:0 5:30 10:0", "--delta", "1", "--continuous"], spark)
    assert json.loads(capsys.readouterr().out)["cost"] == 1
    commands.main(["grid", "0,4", "0,4", "--delta", "1", "--size", "5"], spark)
    assert capsys.readouterr().out.split()[-1][0] == "o"
    commands.main(["samples", str(tmp_path / "s")], spark)
    assert len(list((tmp_path / "s").iterdir())) == 20
    commands.main(["audit", str(tmp_path / "s" / "clean-course.geojson"), str(tmp_path / "s" / "clean-track.csv")], spark)
    assert json.loads(capsys.readouterr().out)["verdict"] == "on_course"
    (tmp_path / "c.toml").write_text('families = 3\nper_route = 1\nopen = 1\nn_points = 15\nvalidation = 1\nmethods = ["fed_delete", "edr"]\n')
    commands.main(["evaluate", str(tmp_path / "run"), "--config", str(tmp_path / "c.toml")], spark)
    first = capsys.readouterr().out
    assert "| corridor | 3 |" in first
    commands.main(["report", str(tmp_path / "run")], spark)
    assert capsys.readouterr().out.strip() in first
    commands.main(["rank", "--families", "3", "--top", "2"], spark)
    ranked = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert ranked[0]["template_id"].startswith("fam00") and ranked[0]["status"] == "optimal"


def test_grouped_scores_equal_scores_of_pairs(spark):
    """Copies of curves under other ids, ties, a query among the routes: groups as tie_groups gives them, best routes as scores() ranks them."""
    from pyspark.sql import functions as F

    from vertexloom.operators import experiment, retrieval

    curves = [[[float((7 * i + j * j) % 23)] for j in range(2 + i % 4)] for i in range(9)]
    rows = [(i, curves[i % 9]) for i in range(27)]
    routes = spark.createDataFrame(rows, "route_id long, pts array<array<double>>")
    queries = routes.where("route_id % 5 = 0").select(F.col("route_id").alias("query_id"), (F.col("route_id") + 1).alias("relevant_id"), "pts")
    methods = ("edr", "fed_delete")
    pairs = experiment.scores(queries.drop("relevant_id"), routes, 4.0, methods=methods).where("query_id <> template_id").cache()
    want = retrieval.tie_groups(pairs, queries.select("query_id", F.col("relevant_id").alias("template_id")))
    columns = ["query_id", "method", "score", "size", "rel", "first_id", "before"]
    got = retrieval.ranked(experiment.tallies(queries, routes, 4.0, methods))
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))

    others = routes.where("route_id % 5 <> 0")
    best = {(r.query_id, r.rank): (r.template_id, r.cost) for r in experiment.best_routes(queries.drop("relevant_id"), others, 4.0, top=3).collect()}
    left = {}
    for r in sorted(pairs.where("method = 'fed_delete' and template_id % 5 <> 0").collect(), key=lambda r: (r.query_id, r.score, r.template_id)):
        n = sum(q == r.query_id for q, _ in left)
        if n < 3 and r.score < float("inf"):
            left[r.query_id, n + 1] = (r.template_id, int(r.score))
    assert best == left


def test_copies_of_a_curve_are_scored_once():
    import numpy as np
    import pyarrow as pa

    from vertexloom.operators import experiment

    met, inner = [], experiment._block(("edr",), 1.0, 1.0)
    block = lambda t, q: met.append((t.num_rows, q.num_rows)) or inner(t, q)
    curve = [[1.0], [2.0]]
    routes = pa.table([pa.array(np.arange(50)), pa.array([curve] * 50)], names=["template_id", "pts"])
    queries = pa.table([pa.array([0, 100]), pa.array([1, 101]), pa.array([curve] * 2)], names=["query_id", "relevant_id", "query"])
    got = experiment._tally(block, ("edr",))(routes, queries).to_pylist()
    assert met == [(1, 1)]
    assert [(r["query_id"], r["size"], r["rel"], r["first_id"]) for r in got] == [(0, 49, 1, 1), (100, 50, 0, 0)]


def test_counted_outcomes_equal_outcomes_of_pairs(spark):
    """Counts of blocks give what pairs give: copies, ties, infeasible scores, queries among the routes or not, relevant routes that are missing or the query itself."""
    from pyspark.sql import functions as F

    from vertexloom.operators import experiment, retrieval

    curves = [[[float((7 * i + j * j) % 23)] for j in range(2 + i % 4)] for i in range(11)]
    routes = spark.createDataFrame([(i, curves[i % 11 if i < 30 else 10 - i % 3]) for i in range(35)], "route_id long, pts array<array<double>>")
    asked = [(i, i + 1, curves[i % 11 if i < 30 else 10 - i % 3]) for i in range(0, 35, 5)] + [(100, 3, curves[0]), (101, 999, curves[4]), (5000, 5000, [[1.0], [2.0]]), (34, 34, curves[2])]
    queries = spark.createDataFrame(asked, "query_id long, relevant_id long, pts array<array<double>>")
    # Without any other curve like its own, and with routes that nothing reaches.
    routes = routes.union(spark.createDataFrame([(5000, [[1.0], [2.0]]), (5001, [[1e6], [2e6]])], routes.schema))
    pairs = experiment.scores(queries.drop("relevant_id"), routes, 4.0).where("query_id <> template_id").cache()
    relevant = queries.where("relevant_id <> query_id").select("query_id", F.col("relevant_id").alias("template_id"))
    want = retrieval.outcomes(pairs, relevant)
    got = experiment.outcomes(queries, routes, 4.0, route_block=8, query_block=4)
    rounded = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(sorted(want.columns)).collect())
    assert [repr(r) for r in rounded(got)] == [repr(r) for r in rounded(want)]
    one = retrieval.summary(got).orderBy("method").collect()
    assert [(r.method, r.threshold) for r in one] == sorted(map(tuple, retrieval.thresholds(want).collect()))


def test_kinds_leave_few_rows_of_many_copies(spark):
    """A curve of 5,000 routes reaches a block of scores as one row, and the best routes as its least id."""
    from pyspark.sql import functions as F

    from vertexloom.operators import experiment

    routes = spark.range(5000).select(F.col("id").alias("route_id"), F.expr("array(array(1D), array(IF(id % 2 = 0, 3D, -0D)))").alias("pts"))
    got = sorted((r.n, r.ids) for r in experiment.kinds(routes).collect())
    assert got == [(2500, [0, 2]), (2500, [1, 3])]


def test_expected_reciprocal_rank_of_large_groups(spark):
    from vertexloom.operators import retrieval

    cases = [(0, 3), (5, 1), (31, 40), (40, 2000), (0, 100_000), (70_000, 9)]
    rows = [(q, "m", 0.0, before, 0, 0, 0) for q, (before, _) in enumerate(cases) if before] + [(q, "m", 1.0, size, 1, 1, before) for q, (before, size) in enumerate(cases)]
    groups = spark.createDataFrame(rows, "query_id long, method string, score double, size long, rel long, first_id long, before long")
    got = {r.query_id: r.rr_expected for r in retrieval.outcomes_of(groups).collect()}
    for q, (before, size) in enumerate(cases):
        assert abs(got[q] - sum(1 / (before + i) for i in range(1, size + 1)) / size) < 1e-12
