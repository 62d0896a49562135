"""More registered queries, with their SQL: damage, projections, planar curves, selection, summaries and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vertexloom.functions import corruptions
from vertexloom.functions import curves as C
from vertexloom.functions.summaries import nearest_rank, unique_points
from vertexloom.operators import experiment, gallery, measures, retrieval, scenarios, selection
from vertexloom.operators.audit import audit
from vertexloom.plans.catalogue import (
    _BITS,
    _EDR_SQL,
    _EVENTS,
    _INFTY,
    _MIN3,
    _NINE,
    _ORDERS,
    _PICKED,
    _PLANE,
    EPS,
    SEED,
    _big,
    _dp,
    _r6,
    _table,
    event_curves,
    neighbours,
    order_curves,
    plane_curves,
)
from vertexloom.session import deal, settle

PLANE_DELTA = 120.0


def q_curve_valid(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 53 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    c = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.array("value")).alias("pts"))
    return c.select("id", C.valid_curve(F.col("pts"), F.lit(1)).alias("valid"), C.valid_curve(F.col("pts"), F.lit(2)).alias("planar"))


def q_point_tier(spark, sf_dir):
    first = lambda c: F.element_at(F.element_at(c, 1), 1)
    p = neighbours(event_curves(spark, sf_dir)).select("ref_id", "obs_id", first("ref").alias("x"), first("obs").alias("y"))
    # Every third pair is judged at its own distance, where floating point must leave the answer open.
    p = p.withColumn("delta", F.when(F.col("ref_id") % 3 == 0, F.abs(F.col("x") - F.col("y"))).otherwise(100.0))
    tier = C.point_tier((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")), F.col("delta"), 1)
    return p.select("ref_id", "obs_id", F.when(tier.isNull(), "open").when(tier, "near").otherwise("far").alias("tier"))


def _damaged(least: int, hurt):
    """Damaged order curves of at least so many vertices, one row a vertex."""

    def query(spark, sf_dir):
        d = order_curves(spark, sf_dir).select("id", F.when(F.size("pts") >= least, hurt(F.col("pts"), F.col("id"))["pts"]).alias("pts"))
        d = d.select("id", F.posexplode("pts").alias("idx", "p"))
        return d.select("id", _big("idx").alias("idx"), F.round(F.element_at("p", 1), 4).alias("v"))

    return query


def q_pipeline_map(spark, sf_dir):
    """Samples dropped, then every second of the rest: which vertex of the original each one is."""
    steps = [lambda p: corruptions.drop_samples(p, F.col("id"), SEED, 0.2), lambda p: corruptions.resample(p, F.col("id"), SEED, 0.5)]
    d = corruptions.apply_pipeline(event_curves(spark, sf_dir), steps)
    fine = F.forall("records", corruptions.consistent)
    d = d.select("id", fine.alias("consistent"), F.posexplode("output_to_original").alias("idx", "source"))
    return d.select("id", "consistent", _big("idx").alias("idx"), _big("source").alias("source"))


def q_affected(spark, sf_dir):
    """Vertices that a spike or a drop touched, joined into one list."""
    d = event_curves(spark, sf_dir).select("id", corruptions.affected(corruptions.drop_samples(F.col("pts"), F.col("id"), SEED, 0.2)["record"]).alias("a"))
    return d.select("id", _big(F.size("a")).alias("n"), F.array_join("a", ",").alias("touched"))


def _places(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.withColumns({"lat": F.pmod(F.col("id") * 37, F.lit(140)) - 70.0, "lon": F.pmod(F.col("id") * 91, F.lit(360)) - 180.0})


def q_projection(spark, sf_dir):
    d = _places(spark, sf_dir).withColumns({"lat0": F.col("lat") + 0.125, "lon0": F.when(F.col("lon") < -179, 179.75).otherwise(F.col("lon") - 0.25)})
    d = d.withColumn("xy", C.to_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))
    back = C.to_latlon(F.col("xy"), F.col("lat0"), F.col("lon0"))
    error = C.projection_scale_error(F.array("lat", F.col("lat") + 0.5), F.col("lat0"))
    return d.select("id", F.round(F.element_at("xy", 1), 3).alias("x"), F.round(F.element_at("xy", 2), 3).alias("y"), _r6(back["lat"]).alias("lat"), _r6(back["lon"]).alias("lon"), F.round(error, 9).alias("error"))


def q_offsets(spark, sf_dir):
    """The farthest vertex of each observation from its reference's polyline."""
    p = neighbours(order_curves(spark, sf_dir))
    far = F.array_max(F.transform("obs", lambda q: C.polyline_distance(q, F.col("ref"))))
    return p.select("ref_id", "obs_id", F.round(far, 4).alias("farthest"))


def q_unique_points(spark, sf_dir):
    d = event_curves(spark, sf_dir).select("id", unique_points(F.transform("pts", lambda p: F.transform(p, lambda x: F.floor(x / 25).cast("double")))).alias("u"))
    return d.select("id", _big(F.size("u.points")).alias("n"), F.array_join("u.inverse", ",").alias("inverse"))


def q_timings(spark, sf_dir):
    d = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list("value").alias("v"))
    return d.select("id", _r6(nearest_rank(F.col("v"))["median"]).alias("median"), nearest_rank(F.col("v"))["p95"].alias("p95"))


def _routes(spark, sf_dir):
    return gallery.gallery(plane_curves(spark, sf_dir).select(F.col("id").alias("family"), "pts"), SEED)


def q_gallery_kinds(spark, sf_dir):
    return experiment.kind_counts(_routes(spark, sf_dir)).select("kind", _big("n").alias("n"))


def q_gallery_points(spark, sf_dir):
    d = _routes(spark, sf_dir).where("kind in ('base', 'shared_endpoint', 'partial_overlap', 'detour')").select("route_id", F.posexplode("pts").alias("idx", "p"))
    return d.select("route_id", _big("idx").alias("idx"), F.round(F.element_at("p", 1), 3).alias("x"), F.round(F.element_at("p", 2), 3).alias("y"))


def q_candidates(spark, sf_dir):
    """Users' events as fixes: which make acceptable routes."""
    e = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    fixes = e.select(F.col("user_id").cast("string").alias("path"), place.alias("idx"), (F.col("value") / 5e4 + 10).alias("lat"), (place * 0.0002 + F.col("user_id") % 360 - 180).alias("lon"))
    d = selection.candidates(fixes)
    return d.select("path", _big("raw_points").alias("raw_points"), F.round("extent", 3).alias("extent"), "acceptable")


def q_delete_plane(spark, sf_dir):
    pairs = deal(neighbours(plane_curves(spark, sf_dir)), "ref_id")
    return measures.edit_cost(pairs, "ref", "obs", PLANE_DELTA, "delete").select("ref_id", "obs_id", "cost")


def q_frechet_plane(spark, sf_dir):
    pairs = deal(neighbours(plane_curves(spark, sf_dir)), "ref_id")
    return measures.measure(pairs, "ref", "obs", "frechet", "d").select("ref_id", "obs_id", _r6("d").alias("d"))


def _retrieved(spark, sf_dir, methods=("edr",)):
    """Customers whose key is divisible by 100 against all curves, in blocks; the next customer is relevant."""
    c = order_curves(spark, sf_dir)
    queries = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("relevant_id"), "pts")
    routes = c.select(F.col("id").alias("route_id"), "pts")
    return experiment.outcomes(queries, routes, EPS, methods)


_HITS = ("hit1_strict", "hit1_expected", "hit1_optimistic", "hit5_strict", "hit5_optimistic", "rr_strict", "rr_expected", "rr_optimistic")


def q_retrieval(spark, sf_dir):
    out = _retrieved(spark, sf_dir)
    return out.select("query_id", "top1", _big("n_scored").alias("n_scored"), "top1_score", "top1_tied", *[_r6(x).alias(x) for x in _HITS])


def q_retrieval_methods(spark, sf_dir):
    """All nine methods for the same queries."""
    out = _retrieved(spark, sf_dir, experiment.METHODS)
    return out.select("method", "query_id", "abstained", _big("n_scored").alias("n_scored"), _big("n_infeasible").alias("n_infeasible"), "top1", *[_r6(x).alias(x) for x in _HITS])


def q_retrieval_summary(spark, sf_dir):
    d = retrieval.summary(_retrieved(spark, sf_dir))
    return d.select("method", _big("n_queries").alias("n_queries"), "coverage", *[_r6(x).alias(x) for x in ("hit1_strict", "hit1_optimistic", "rr_strict", "rr_optimistic")], _r6("threshold").alias("threshold"))


def q_best_route(spark, sf_dir):
    """The route each asked customer comes nearest to by deletions, and how many its script has; with the decisions that took."""
    c = order_curves(spark, sf_dir)
    queries = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), "pts")
    others = c.where("id % 100 <> 0").select(F.col("id").alias("route_id"), "pts")
    best = experiment.best_routes(queries, others, EPS)
    counted = F.col("counters")["points"] == F.size("template") * F.size("query")
    return best.select("query_id", F.col("template_id").alias("route"), _big("cost").alias("cost"), _big(F.size("edits")).alias("n_edits"), counted.alias("counted"))


def q_experiment(spark, sf_dir):
    """Nine methods on damaged walks and look-alike galleries, with validation families, thresholds and strangers: one row a method."""
    g = gallery.gallery(gallery.bases(spark, 12, 30, SEED), SEED)
    q = gallery.queries(g, per_route=1, n_open=3, n_points=30, seed=SEED)
    _, summary = experiment.evaluate(q, g, experiment.scores(q, g, 25.0), n_validation=2)
    return summary.select("method", _big("n_queries").alias("n_queries"), "coverage", *[_r6(x).alias(x) for x in ("hit1_strict", "hit1_expected", "rr_strict", "rr_expected", "false_match_rate")])


def q_scenarios(spark, sf_dir):
    """The five demonstrations audited; what must come out is known by construction."""
    d = scenarios.scenarios(spark)
    limits = (25.0, 30.0)
    parts = [audit(d.where(F.col("delta_m") == x), x, "id") for x in limits]
    a = parts[0].unionByName(parts[1])
    found = F.coalesce(F.size("glitches"), F.lit(0))
    return a.select("id", "verdict", _big("cost").alias("cost"), _big(found).alias("n_glitches"), (F.transform("glitches", lambda g: g["index"]) == F.col("injected")).alias("as_injected"), "verification", "fixes_near_course", "course_covered")


def q_audit(spark, sf_dir):
    """Users' event curves as courses in metres; a track is its course with a few far fixes put in, or breaks off early (every seventh user)."""
    c = settle(deal(settle(plane_curves(spark, sf_dir)), "id"))
    c = settle(c.withColumn("pts", F.transform("pts", lambda p: F.array(F.element_at(p, 1) * 10, F.element_at(p, 2)))))
    n, k = F.size("pts"), (F.col("id") % 4).cast("int")
    far = lambda p: F.array(F.element_at(p, 1), F.element_at(p, 2) + 5000.0)
    with_far = F.flatten(F.transform("pts", lambda p, i: F.when((i % 10 == 0) & (i > 0) & (i <= 10 * k), F.array(p, far(p))).otherwise(F.array(p))))
    track = F.when(F.col("id") % 7 == 6, F.slice("pts", F.lit(1), F.floor(n * 2 / 3).cast("int"))).otherwise(with_far)
    d = c.select("id", scenarios.fixes(F.col("pts")).alias("course"), scenarios.fixes(track).alias("track"))
    a = audit(d, 25.0, "id")
    return a.select("id", "verdict", _big("cost").alias("cost"), F.array_join(F.transform("glitches", lambda g: g["index"]), ",").alias("glitches"), "verification")


QUERIES = {
    "q_curve_valid": q_curve_valid,
    "q_point_tier": q_point_tier,
    "q_burst": _damaged(5, lambda p, k: corruptions.burst(p, k, SEED, 3, 1000.0)),
    "q_jitter": _damaged(1, lambda p, k: corruptions.jitter(p, k, SEED, 10.0)),
    "q_prefix_suffix": _damaged(2, lambda p, k: corruptions.prefix_suffix_noise(p, k, SEED, 2)),
    "q_pipeline_map": q_pipeline_map,
    "q_affected": q_affected,
    "q_projection": q_projection,
    "q_offsets": q_offsets,
    "q_unique_points": q_unique_points,
    "q_timings": q_timings,
    "q_gallery_kinds": q_gallery_kinds,
    "q_gallery_points": q_gallery_points,
    "q_candidates": q_candidates,
    "q_delete_plane": q_delete_plane,
    "q_frechet_plane": q_frechet_plane,
    "q_retrieval": q_retrieval,
    "q_retrieval_summary": q_retrieval_summary,
    "q_retrieval_methods": q_retrieval_methods,
    "q_experiment": q_experiment,
    "q_best_route": q_best_route,
    "q_scenarios": q_scenarios,
    "q_audit": q_audit,
}

_U = lambda stream, key, index: f"(({_BITS(stream, index).replace('|| id ||', f'|| {key} ||')} + 0.5) / 4294967296.0)"
_NORMAL = lambda stream, key, index: f"(sqrt(-2 * ln({_U(stream + 'r', key, index)})) * cos(2 * pi() * {_U(stream + 'a', key, index)}))"
_SIGN = lambda stream, key, index: f"CASE WHEN cos(2 * pi() * {_U(stream + 'a', key, index)}) > 0 THEN 1 ELSE -1 END"
#: Random bits of a stream without an index.
_BARE = lambda stream, seed=SEED: f"CAST('0x' || substr(md5('{seed}:{stream}:' || id), 1, 8) AS BIGINT)"
_ROWS = lambda source, least: f"SELECT id, v, unnest(range(len(v))) AS idx FROM ({source}) WHERE len(v) >= {least}"

ORACLES = {
    "q_curve_valid": "SELECT user_id AS id, bool_and(event_id % 53 <> 0) AS valid, false AS planar FROM events GROUP BY user_id",
    "q_point_tier": f"""WITH c AS ({_EVENTS}), p AS (SELECT a.id AS ref_id, b.id AS obs_id, pow(a.v[1] - b.v[1], 2) AS d2,
      CASE WHEN a.id % 3 = 0 THEN abs(a.v[1] - b.v[1]) ELSE 100.0 END AS delta FROM c a JOIN c b ON b.id = a.id + 1)
      SELECT ref_id, obs_id, CASE WHEN d2 - delta * delta > slack THEN 'far' WHEN delta * delta - d2 > slack THEN 'near' ELSE 'open' END AS tier
      FROM (SELECT *, 40.0 * pow(2.0, -53) * (d2 + delta * delta) AS slack FROM p)""",
    "q_burst": f"""SELECT id, CAST(idx AS BIGINT) AS idx, round(v[idx + 1] + CASE WHEN idx >= s AND idx < s + 3 THEN 1000.0 * ({_SIGN("burst", "id", "0")}) ELSE 0 END, 4) AS v
      FROM (SELECT *, 1 + {_BARE("burst")} % greatest(len(v) - 4, 1) AS s FROM ({_ROWS(_ORDERS, 5)}))""",
    "q_jitter": f"""SELECT id, CAST(idx AS BIGINT) AS idx, round(v[idx + 1] + 10.0 * {_NORMAL("jitter", "id", "idx || ':0'")}, 4) AS v FROM ({_ROWS(_ORDERS, 1)})""",
    "q_prefix_suffix": f"""WITH c AS (SELECT id, v, len(v) AS n, list_median(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))) AS g FROM ({_ORDERS}) WHERE len(v) >= 2),
      s AS (SELECT id, v, n, CASE WHEN g > 0 THEN g ELSE 1.0 END AS g, {_SIGN("prefix", "id", "'1:0'")} AS p1, {_SIGN("prefix", "id", "'2:0'")} AS p2,
        {_SIGN("suffix", "id", "'1:0'")} AS s1, {_SIGN("suffix", "id", "'2:0'")} AS s2 FROM c),
      w AS (SELECT id, list_concat([v[1] - g * p1 - g * p2, v[1] - g * p1], v, [v[n] + g * s1, v[n] + g * s1 + g * s2]) AS w FROM s)
      SELECT id, CAST(unnest(range(len(w))) AS BIGINT) AS idx, round(unnest(w), 4) AS v FROM w""",
    "q_projection": """WITH c AS (SELECT c_custkey AS id, (c_custkey * 37) % 140 - 70.0::DOUBLE AS lat, (c_custkey * 91) % 360 - 180.0::DOUBLE AS lon FROM customer),
      d AS (SELECT *, lat + 0.125 AS lat0, CASE WHEN lon < -179 THEN 179.75 ELSE lon - 0.25 END AS lon0 FROM c),
      p AS (SELECT *, radians((lon - lon0 + 540) % 360 - 180) * cos(radians(lat0)) * 6371008.8 AS x, radians(lat - lat0) * 6371008.8 AS y FROM d)
      SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon,
        round(greatest(abs(cos(radians(lat)) / cos(radians(lat0)) - 1), abs(cos(radians(lat + 0.5)) / cos(radians(lat0)) - 1)), 9) AS error FROM p""",
    "q_offsets": f"""WITH c AS ({_ORDERS}) SELECT a.id AS ref_id, b.id AS obs_id, round(list_max(list_transform(b.v, lambda q: CASE WHEN len(a.v) = 1 THEN abs(q - a.v[1])
      ELSE list_min(list_transform(range(1, len(a.v)), lambda i: greatest(0, least(a.v[i], a.v[i + 1]) - q, q - greatest(a.v[i], a.v[i + 1])))) END)), 4) AS farthest
      FROM c a JOIN c b ON b.id = a.id + 1""",
    "q_unique_points": f"""SELECT id, CAST(len(u) AS BIGINT) AS n, array_to_string(list_transform(w, lambda x: list_position(u, x) - 1), ',') AS inverse
      FROM (SELECT id, w, list_sort(list_distinct(w)) AS u FROM (SELECT id, list_transform(v, lambda x: floor(x / 25)) AS w FROM ({_EVENTS})))""",
    "q_timings": """SELECT user_id AS id, round(median(value), 6) AS median, list_sort(list(value))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT)) + 1] AS p95 FROM events GROUP BY user_id""",
    "q_gallery_kinds": "SELECT kind, count(DISTINCT user_id) AS n FROM events, (SELECT unnest(['base', 'corridor', 'shared_endpoint', 'partial_overlap', 'detour']) AS kind) GROUP BY kind",
}

ORACLES["q_pipeline_map"] = f"""WITH gone AS (SELECT id, idx FROM ({_PICKED(_EVENTS, "drop")}) WHERE place <= round_even(0.2 * greatest(len(v) - 2, 0), 0)),
  kept AS (SELECT id, idx AS source, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY id) AS n
    FROM (SELECT id, unnest(range(len(v))) AS idx FROM ({_EVENTS})) ANTI JOIN gone USING (id, idx))
  SELECT id, true AS consistent, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS BIGINT) AS idx, CAST(source AS BIGINT) AS source FROM kept WHERE k % 2 = 0 OR k = n - 1"""
ORACLES["q_affected"] = f"""WITH gone AS (SELECT id, idx FROM ({_PICKED(_EVENTS, "drop")}) WHERE place <= round_even(0.2 * greatest(len(v) - 2, 0), 0))
  SELECT e.id, count(g.idx) AS n, coalesce(string_agg(CAST(g.idx AS VARCHAR), ',' ORDER BY g.idx), '') AS touched FROM ({_EVENTS}) e LEFT JOIN gone g ON g.id = e.id GROUP BY e.id"""

_PLANE_POINTS = f"SELECT id, list_transform(range(1, len(x) + 1), lambda i: {{'x': x[i], 'y': y[i]}}) AS v FROM ({_PLANE})"
_APART = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
ORACLES["q_frechet_plane"] = _dp(_PLANE_POINTS, f"greatest({_MIN3}, {_APART})", _INFTY, _INFTY, "round(cur[m + 1], 6)", "d")
_K = f"CASE WHEN q IS NOT NULL AND {_APART} <= {PLANE_DELTA} THEN least(k, prev2[i2], prev2[i2 + 1]) ELSE 1000000 END"
ORACLES["q_delete_plane"] = _dp(_PLANE_POINTS, "least(1000000, k2, prev2[i2 + 1] + 1)", "prev2[1] + 1", "1000000", "CASE WHEN cur[m + 1] < 1000000 THEN CAST(cur[m + 1] AS BIGINT) END", "cost", k=_K, k0="1000000", head0="0", kind="BIGINT")

# Routes: the base, an arc between its ends, its head and a walk, and an excursion from its middle.
_TURN = _NORMAL("turn", "id", "i").replace(f"'{SEED}:", f"'{SEED + 1}:")
_HEADING = f"2 * pi() * ({_BARE('heading', SEED + 1)} + 0.5) / 4294967296.0"
ORACLES["q_gallery_points"] = f"""WITH c AS (SELECT id, x, y, len(x) AS n FROM ({_PLANE})),
  base AS (SELECT id, 'base' AS kind, unnest(range(n)) AS idx, unnest(x) AS x, unnest(y) AS y FROM c),
  ends AS (SELECT *, x[n] - x[1] AS dx, y[n] - y[1] AS dy, CASE WHEN {_BARE("side")} % 2 = 0 THEN -120.0 ELSE 120.0 END AS side FROM c),
  arc AS (SELECT id, 'shared_endpoint' AS kind, idx, x[1] + t * dx - sin(pi() * t) * side * dy / g AS x, y[1] + t * dy + sin(pi() * t) * side * dx / g AS y
    FROM (SELECT *, sqrt(dx * dx + dy * dy) AS g, idx / greatest(n - 1, 1) AS t FROM (SELECT *, unnest(range(n)) AS idx FROM ends))),
  half AS (SELECT *, least(n, greatest(2, CAST(floor(n * 0.5) AS INT))) AS s FROM c),
  steps AS (SELECT id, x[s] AS x0, y[s] AS y0, s, i, 0.22 * {_TURN} AS turn FROM (SELECT *, unnest(range(1, n - s + 1)) AS i FROM half)),
  headed AS (SELECT *, {_HEADING} + sum(turn) OVER (PARTITION BY id ORDER BY i) AS h FROM steps),
  walk AS (SELECT id, 'partial_overlap' AS kind, s + i - 1 AS idx, x0 + sum(10.0 * cos(h)) OVER (PARTITION BY id ORDER BY i) AS x, y0 + sum(10.0 * sin(h)) OVER (PARTITION BY id ORDER BY i) AS y FROM headed),
  head AS (SELECT id, 'partial_overlap' AS kind, idx, x[idx + 1] AS x, y[idx + 1] AS y FROM (SELECT *, unnest(range(s)) AS idx FROM half)),
  away AS (SELECT *, {_NORMAL("detour", "id", "0")} AS ex, {_NORMAL("detour", "id", "1")} AS ey, n // 2 AS mid FROM c),
  trip AS (SELECT id, 'detour' AS kind, idx, CASE WHEN idx < mid THEN x[idx + 1] WHEN idx < mid + 3 THEN x[mid + 1] + 90.0 * r * ex / e ELSE x[idx - 2] END AS x,
      CASE WHEN idx < mid THEN y[idx + 1] WHEN idx < mid + 3 THEN y[mid + 1] + 90.0 * r * ey / e ELSE y[idx - 2] END AS y
    FROM (SELECT *, 0.4 + 0.3 * (idx - mid) AS r, sqrt(ex * ex + ey * ey) AS e FROM (SELECT *, unnest(range(n + 3)) AS idx FROM away)))
  SELECT id || '-' || kind AS route_id, CAST(idx AS BIGINT) AS idx, round(x, 3) AS x, round(y, 3) AS y
  FROM (SELECT * FROM base UNION ALL SELECT * FROM arc UNION ALL SELECT * FROM head UNION ALL SELECT * FROM walk UNION ALL SELECT * FROM trip)"""

ORACLES["q_candidates"] = """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 5e4 + 10 AS lat, user_id FROM events),
  g AS (SELECT path, idx, lat, idx * 0.0002 + user_id % 360 - 180 AS lon, avg(lat) OVER (PARTITION BY path) AS lat0 FROM f),
  xy AS (SELECT *, radians(lon) * cos(radians(lat0)) * 6371000.0 AS x, radians(lat) * 6371000.0 AS y FROM g),
  s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM xy WINDOW w AS (PARTITION BY path ORDER BY idx)),
  t AS (SELECT path, count(*) AS n, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS extent, coalesce(max(step), 0) AS gap, coalesce(sum(step), 0) AS total FROM s GROUP BY path)
  SELECT path, n AS raw_points, round(extent, 3) AS extent, n >= 50 AND extent >= 300 AND gap <= 2000 AND total >= 390 AS acceptable FROM t"""

#: Outcomes of scored pairs s(method, query_id, t, d); one route is relevant.
_OUTCOMES = f"""rel AS (SELECT method, query_id, d FROM s WHERE t = query_id + 1),
  g AS (SELECT s.method, s.query_id, count_if(s.d < {_INFTY}) AS n_scored, count_if(s.d = {_INFTY}) AS n_infeasible, min(s.d) AS top1_score, arg_min(t, (s.d, t)) AS top1, CAST(count_if(s.d < rel.d) AS BIGINT) AS before, CAST(count_if(s.d = rel.d) AS BIGINT) AS size, max(rel.d) AS found
    FROM s LEFT JOIN rel ON rel.query_id = s.query_id AND rel.method = s.method GROUP BY s.method, s.query_id),
  b AS (SELECT g.*, count_if(s.d = g.top1_score) > 1 AS tied FROM g JOIN s USING (method, query_id) GROUP BY ALL),
  o AS (SELECT method, CAST(query_id AS BIGINT) AS query_id, n_scored = 0 AS abstained, CAST(n_scored AS BIGINT) AS n_scored, CAST(n_infeasible AS BIGINT) AS n_infeasible, CASE WHEN n_scored > 0 THEN top1 END AS top1, CASE WHEN n_scored > 0 THEN CAST(top1_score AS DOUBLE) END AS top1_score, n_scored > 0 AND tied AS top1_tied,
    CASE WHEN before + size <= 1 AND found IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit1_strict, CASE WHEN before = 0 AND found IS NOT NULL THEN 1.0::DOUBLE / size ELSE 0.0::DOUBLE END AS hit1_expected,
    CASE WHEN before + 1 <= 1 AND found IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit1_optimistic,
    CASE WHEN before + size <= 5 AND found IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit5_strict, CASE WHEN before + 1 <= 5 AND found IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit5_optimistic,
    CASE WHEN found IS NOT NULL THEN 1.0::DOUBLE / (before + size) ELSE 0.0::DOUBLE END AS rr_strict, CASE WHEN found IS NOT NULL THEN list_avg(list_transform(range(size), lambda i: 1.0::DOUBLE / (before + 1 + i))) ELSE 0.0::DOUBLE END AS rr_expected,
    CASE WHEN found IS NOT NULL THEN 1.0::DOUBLE / (before + 1) ELSE 0.0::DOUBLE END AS rr_optimistic FROM b)"""
_RANKED = lambda methods: "WITH s AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, ref_id // 1000000000 AS query_id, obs_id AS t, CAST(d AS DOUBLE) AS d FROM ({sql})" for m, sql in methods.items()) + "), " + _OUTCOMES
_ONE = _RANKED({"edr": _EDR_SQL})
ORACLES["q_retrieval"] = f"{_ONE} SELECT query_id, top1, n_scored, top1_score, top1_tied, {', '.join(f'round({x}, 6) AS {x}' for x in _HITS)} FROM o"
ORACLES["q_retrieval_methods"] = f"{_RANKED(_NINE)} SELECT method, query_id, abstained, n_scored, n_infeasible, top1, {', '.join(f'round({x}, 6) AS {x}' for x in _HITS)} FROM o"
ORACLES["q_best_route"] = f"""SELECT CAST(query_id AS BIGINT) AS query_id, arg_min(t, (d, t)) AS route, CAST(min(d) AS BIGINT) AS cost, CAST(min(d) AS BIGINT) AS n_edits, true AS counted
  FROM (SELECT ref_id // 1000000000 AS query_id, obs_id AS t, d FROM ({_NINE["fed_delete"]})) WHERE t % 100 <> 0 AND d < {_INFTY} GROUP BY query_id"""
ORACLES["q_retrieval_summary"] = f"""{_ONE} SELECT 'edr' AS method, count(*) AS n_queries, 1.0::DOUBLE AS coverage,
  {", ".join(f"round(avg({x}), 6) AS {x}" for x in ("hit1_strict", "hit1_optimistic", "rr_strict", "rr_optimistic"))}, round(quantile_cont(top1_score, 0.95), 6) AS threshold FROM o"""

ORACLES["q_scenarios"] = """SELECT * FROM (VALUES ('clean', 'on_course', 0::BIGINT, 0::BIGINT, true, 'verified', true, true), ('urban-canyon', 'on_course_after_cleaning', 6, 6, true, 'verified', false, true),
  ('sparse-logging', 'on_course', 0, 0, true, 'verified', true, true), ('shortcut', 'off_course', NULL, 0, true, 'not_applicable', false, false), ('one-lap-of-two', 'off_course', NULL, 0, true, 'not_applicable', true, true))
  t(id, verdict, cost, n_glitches, as_injected, verification, fixes_near_course, course_covered)"""
ORACLES["q_audit"] = """SELECT user_id AS id, CASE WHEN user_id % 7 = 6 THEN 'off_course' WHEN user_id % 4 = 0 THEN 'on_course' ELSE 'on_course_after_cleaning' END AS verdict,
  CASE WHEN user_id % 7 <> 6 THEN CAST(user_id % 4 AS BIGINT) END AS cost, CASE WHEN user_id % 7 = 6 THEN '' ELSE array_to_string(list_transform(range(1, user_id % 4 + 1), lambda m: m * 11), ',') END AS glitches,
  CASE WHEN user_id % 7 = 6 THEN 'not_applicable' ELSE 'verified' END AS verification FROM (SELECT DISTINCT user_id FROM events)"""
