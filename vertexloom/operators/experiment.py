"""Retrieval experiments: every query scored against every route by every method, then judged and reported."""

from __future__ import annotations

import itertools
import json
import tomllib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from vertexloom.functions import curves as C
from vertexloom.operators import edits, measures, retrieval
from vertexloom.operators.edits import check_options
from vertexloom.session import deal, ship

INF = float("inf")


EDIT_METHODS = {"fed_delete": "delete", "fed_insert": "insert", "fed_both": "both"}
#: Method to (measure, whether the query is smoothed first); lower is better.
MEASURES = {"frechet": ("frechet", False), "filter_frechet": ("frechet", True), "edr": ("edr", False), "lcss": ("lcss_distance", False), "dtw": ("dtw", False), "erp": ("erp", False)}
METHODS = (*EDIT_METHODS, *MEASURES)


def _inserting(methods) -> bool:
    return any(EDIT_METHODS.get(m) in ("insert", "both") for m in methods)


def _reaches(curves: list[np.ndarray], delta: float) -> tuple[list[list[int]], np.ndarray]:
    """What insertion needs to know of each reference, and which are numerically ambiguous."""
    from vertexloom.kernels.ball import reach
    from vertexloom.kernels.exact import Ambiguous

    def first(c):
        try:
            return reach(c, delta)
        except Ambiguous:
            return None

    back = [first(c) for c in curves]
    return [r if r is not None else list(range(len(c))) for r, c in zip(back, curves, strict=True)], np.array([r is None for r in back])


def _score(method: str, plain, smooth, delta: float, eps: float, known, open_) -> np.ndarray:
    """Scores of a group of pairs by one method; infinite where infeasible, NaN where ambiguous."""
    from vertexloom.kernels import batch as B

    if method in EDIT_METHODS:
        cost = B.edit_cost(plain, delta, EDIT_METHODS[method], known).astype(np.float64)
        cost[cost >= B.NEVER] = INF
        if EDIT_METHODS[method] != "delete":
            cost[open_] = np.nan
        return cost
    kind, smoothed = MEASURES[method]
    p = smooth if smoothed else plain
    return np.asarray(getattr(B, kind)(p, eps) if kind in ("edr", "lcss_distance") else getattr(B, kind)(p), np.float64)


class _Routes:
    """Curves of a block of routes, padded once, which queries meet one after another."""

    def __init__(self, curves: list[np.ndarray], methods: tuple[str, ...], delta: float, eps: float):
        from vertexloom.kernels import batch as B

        if any(c is None or not len(c) for c in curves):
            raise ValueError("routes and queries must have vertices")
        self.n, self.methods, self.delta, self.eps, self.groups = len(curves), methods, delta, eps, []
        order = np.argsort([len(c) for c in curves], kind="stable")
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            mine = [curves[k] for k in some]
            self.groups.append((some, *B.padded(mine), *(_reaches(mine, delta) if _inserting(methods) else (None, None))))

    def lines(self, query: np.ndarray, smooth: np.ndarray | None = None) -> list[np.ndarray]:
        """Of each method the scores of a query against all routes."""
        from vertexloom.kernels import batch as B

        if query is None or not len(query):
            raise ValueError("routes and queries must have vertices")
        out = [np.empty(self.n) for _ in self.methods]
        for some, a, la, known, open_ in self.groups:
            measures.check(a[:1, 0], query)
            plain = B.Pairs.against(a, la, query)
            smoothed = B.Pairs.against(a, la, smooth) if smooth is not None else None
            for line, m in zip(out, self.methods, strict=True):
                line[some] = _score(m, plain, smoothed, self.delta, self.eps, known, open_)
        return out


def _block(methods: tuple[str, ...], delta: float, eps: float):
    """Scores of a block of queries against a block of routes."""

    def run(routes, queries):
        import pyarrow as pa

        met = _Routes(measures.curves(routes.column("pts")), methods, delta, eps)
        smooth = measures.curves(queries.column("smooth")) if "smooth" in queries.column_names else itertools.repeat(None)
        out: list[list] = [[] for _ in methods]
        asked = 0
        for query, smoothed in zip(measures.curves(queries.column("query")), smooth):
            asked += 1
            for column, line in zip(out, met.lines(query, smoothed), strict=True):
                column.append(line)
        take = lambda column, index: column.combine_chunks().take(pa.array(index))
        scored = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64(), from_pandas=True) for c in out]
        every = take(queries.column("query_id"), np.repeat(np.arange(asked), met.n)), take(routes.column("template_id"), np.tile(np.arange(met.n), asked))
        return pa.table([*every, *scored], ["query_id", "template_id", *methods])

    return run


def _alike(table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """First row of each curve, and every row's kind."""
    seen: dict[tuple, int] = {}
    kind = np.array([seen.setdefault((c.shape[1], c.tobytes()), len(seen)) for c in measures.curves(table.column(column))], np.int64)
    return np.unique(kind, return_index=True)[1], kind


def _kinds(keep: int):
    """Each different curve of a task's rows once, with how many rows have it and the `keep` least ids of those."""

    def run(batches):
        from bisect import insort

        import pyarrow as pa

        known: dict[tuple[int, bytes], list] = {}
        kind, id_kind = None, None
        for b in batches:
            kind, id_kind = b.schema.field("pts").type, b.schema.field("route_id").type
            for c, i in zip(measures.curves(b.column("pts")), b.column("route_id").to_pylist(), strict=True):
                if c is None or not len(c):
                    raise ValueError("routes and queries must have vertices")
                got = known.setdefault((c.shape[1], c.tobytes()), [0, []])
                got[0] += 1
                if len(got[1]) < keep or i < got[1][-1]:
                    insort(got[1], i)
                    del got[1][keep:]
        rows = iter(known.items())
        while some := list(itertools.islice(rows, 8192)):
            pts = [np.frombuffer(c).reshape(-1, dim) for (dim, c), _ in some]
            ends = np.cumsum(np.repeat([dim for (dim, _), _ in some], [len(c) for c in pts]))
            values = pa.array(np.concatenate([c.ravel() for c in pts]))
            inner = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), values)
            outer = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(c) for c in pts])).astype(np.int32), inner)
            yield pa.RecordBatch.from_arrays([outer.cast(kind), pa.array([n for _, (n, _) in some], pa.int64()), pa.array([i for _, (_, i) in some], pa.list_(id_kind))], names=["pts", "n", "ids"])

    return run


def kinds(gallery: DataFrame, keep: int = 2) -> DataFrame:
    """pts, n, ids: each different curve of a gallery, how many routes have it, and the least ids of those (at most `keep`)."""
    ship(gallery.sparkSession)
    rows = gallery.select("route_id", F.col("pts").cast("array<array<double>>").alias("pts"))
    schema = T.StructType([rows.schema["pts"], T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["route_id"].dataType))])
    return deal(rows, "pts").mapInArrow(_kinds(keep), schema)


def _nearest(method: str, delta: float, eps: float, top: int):
    """Per query of a block its top templates by score and id, of those in reach. Templates and queries of one curve are scored once."""

    def run(routes, queries):
        import pyarrow as pa

        out, rows = [[], [], []], []
        if routes.num_rows and queries.num_rows:
            (first_t, kind_t), (first_q, kind_q) = _alike(routes, "pts"), _alike(queries, "query")
            ids, asked = routes.column("template_id").to_numpy(), queries.column("query_id").to_numpy()
            curves, queried = measures.curves(routes.column("pts")), measures.curves(queries.column("query"))
            met = _Routes([curves[k] for k in first_t], (method,), delta, eps)
            place_of = np.unique(ids, return_inverse=True)[1]  # ids may be text
            order = np.lexsort((place_of, kind_t))
            cut = np.append(0, np.cumsum(np.bincount(kind_t)))
            least = place_of[order[cut[:-1]]]
            members = np.split(np.argsort(kind_q, kind="stable"), np.cumsum(np.bincount(kind_q))[:-1])
            for first, like in zip(first_q, members, strict=True):
                (line,) = met.lines(queried[first])
                limit = np.partition(line, top - 1)[top - 1] if top < len(line) else INF
                near = np.flatnonzero(np.isfinite(line) & ~(line > limit))
                near = near[np.lexsort((least[near], line[near]))[:top]]
                each = [order[cut[g] : min(cut[g + 1], cut[g] + top)] for g in near]
                found = np.concatenate(each) if each else np.zeros(0, np.int64)
                score = np.repeat(line[near], [len(e) for e in each])
                best = np.lexsort((place_of[found], score))[:top]
                rows.append(np.tile(found[best], len(like)))
                for column, x in zip(out, (np.repeat(asked[like], len(best)), np.tile(ids[found][best], len(like)), np.tile(score[best], len(like))), strict=True):
                    column.append(x)
        kinds = (routes.schema.field("template_id").type, pa.float64())
        columns = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, (queries.schema.field("query_id").type, *kinds), strict=True)]
        template = routes.column("pts").combine_chunks().take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
        return pa.table([*columns, template], names=["query_id", "template_id", "score", "template"])

    return run


def _relevant(methods: tuple[str, ...], delta: float, eps: float):
    """Scores of each query's relevant route, one a method; none where there is no such route."""

    def run(batches):
        import pyarrow as pa

        from vertexloom.kernels import batch as B

        for b in batches:
            read = lambda c: measures.curves(b.column(c)) if c in b.schema.names else None  # noqa: B023, E731
            routes, queries, smooth = read("wanted"), read("query"), read("smooth")
            out = np.full((b.num_rows, len(methods)), np.nan)
            full = [k for k, c in enumerate(routes) if c is not None]
            for k in full:
                measures.check(routes[k], queries[k])
            for some in B.groups([routes[k] for k in full], [queries[k] for k in full]) if full else ():
                at = [full[k] for k in some]
                mine = [routes[k] for k in at]
                plain = B.Pairs(mine, [queries[k] for k in at])
                smoothed = B.Pairs(mine, [smooth[k] for k in at]) if smooth else None
                known, open_ = _reaches(mine, delta) if _inserting(methods) else (None, None)
                for i, m in enumerate(methods):
                    out[at, i] = _score(m, plain, smoothed, delta, eps, known, open_)
            keep = [n for n in b.schema.names if n != "wanted"]
            scored = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(methods), dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], scored], [*keep, "wanted_score"])

    return run


_COUNTED = "query_id long, method string, n_scored long, n_infeasible long, n_ambiguous long, before long, size long, wanted_score double, top_score double, top_size long, top_id long"


def _count(methods: tuple[str, ...], delta: float, eps: float):
    """Per query and method of a block: how many templates are scored, infeasible, ambiguous, before and level with the relevant one, and the best group.

    Templates come as kinds(), and queries of one curve are scored once. A query is no template of its own.
    """

    def run(routes, queries):
        import pyarrow as pa

        names = [c.split()[0] for c in _COUNTED.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _COUNTED.split(", ")]
        out: list[list] = [[] for _ in names]
        if routes.num_rows and queries.num_rows:
            weight = routes.column("n").to_numpy()
            ids = routes.column("ids").to_pylist()
            least = np.array([i[0] for i in ids], np.int64)
            curves, queried = measures.curves(routes.column("pts")), measures.curves(queries.column("query"))
            smooth = measures.curves(queries.column("smooth")) if "smooth" in queries.column_names else None
            place = {(c.shape[1], c.tobytes()): k for k, c in enumerate(curves)}
            met = _Routes(curves, methods, delta, eps)
            first_q, kind_q = _alike(queries, "query")
            asked = queries.column("query_id").to_numpy()
            own = [None if c is None else place.get((c.shape[1], c.tobytes())) for c in measures.curves(queries.column("own"))]
            wanted = np.array(queries.column("wanted_score").to_pylist(), np.float64).reshape(len(asked), len(methods))
            members = np.split(np.argsort(kind_q, kind="stable"), np.cumsum(np.bincount(kind_q))[:-1])
            for first, mine in zip(first_q, members, strict=True):
                for i, line in enumerate(met.lines(queried[first], smooth[first] if smooth else None)):
                    counted = _counts(line, weight, least, ids, asked[mine], [own[j] for j in mine], wanted[mine, i])
                    for column, x in zip(out, (asked[mine], np.full(len(mine), methods[i]), *counted), strict=True):
                        column.append(x)
        return pa.table([pa.array(np.concatenate(c) if c else [], k, from_pandas=k == pa.float64()) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _counts(line, weight, least, ids, asked, own, wanted) -> tuple[np.ndarray, ...]:
    """The counts of _count() for the queries of one curve, whose scores against the kinds are line."""
    finite, open_ = np.isfinite(line), np.isnan(line)
    whole, none = int(weight[finite].sum()), int(weight[open_].sum())
    each = lambda x, kind=np.int64: np.full(len(asked), x, kind)
    n_scored, n_infeasible, n_ambiguous = each(whole), each(int(weight.sum()) - whole - none), each(none)
    before, size = each(0), each(0)
    for w in np.unique(wanted[~np.isnan(wanted)]).tolist():
        like = wanted == w
        before[like], size[like] = weight[line < w].sum(), weight[line == w].sum()

    def best(some: np.ndarray) -> tuple[float, np.ndarray]:
        low = line[some].min() if some.any() else np.nan
        return low, np.flatnonzero(line == low)

    low, group = best(finite)
    top_score, top_size, top_id = each(low, np.float64), each(weight[group].sum()), each(least[group].min() if len(group) else 0)
    for q, g in enumerate(own):
        if g is None:
            continue
        v = line[g]
        (n_ambiguous if np.isnan(v) else n_infeasible if np.isinf(v) else n_scored)[q] -= 1
        before[q] -= v < wanted[q]
        size[q] -= v == wanted[q]
        if v == low:
            alone = top_size[q] == 1  # the best group was the query itself
            now, at = best(finite & (line > low)) if alone else (low, group)
            others = [i for k in at.tolist() for i in ids[k] if i != asked[q]]
            top_score[q], top_size[q], top_id[q] = now, weight[at].sum() - (not alone), min(others, default=0)
    return n_scored, n_infeasible, n_ambiguous, before, size, wanted, top_score, top_size, top_id


def outcomes(queries: DataFrame, gallery: DataFrame, delta: float, methods: tuple[str, ...] = METHODS, ks: tuple[int, ...] = (1, 5), window: int = 3, route_block: int = 65536, query_block: int = 4096) -> DataFrame:
    """What retrieval.outcomes() gives for scores() of queries (query_id, pts, relevant_id) against all routes but one of the query's own id; unique long ids.

    The relevant route of each query is scored first; then a block of routes needs to give counts only, one row a query and method. Each
    different curve is scored once, however many routes and queries have it.
    """
    _check(delta, methods)
    ship(queries.sparkSession)
    curve = lambda c: F.col(c).cast("array<array<double>>")
    n_routes, n_queries = _blocks(queries, gallery, route_block, query_block)
    named = queries.select(F.explode(F.array("query_id", "relevant_id")).alias("route_id")).distinct()
    met = gallery.join(named, "route_id", "left_semi").select("route_id", curve("pts").alias("met"))
    also = [C.smooth(curve("pts"), window).alias("smooth")] if "filter_frechet" in methods else []
    q = queries.select("query_id", "relevant_id", curve("pts").alias("query"), *also)
    q = q.join(met.select(F.col("route_id").alias("query_id"), F.col("met").alias("own")), "query_id", "left")
    q = q.join(met.select(F.col("route_id").alias("relevant_id"), F.col("met").alias("wanted")), "relevant_id", "left")
    q = q.withColumn("wanted", F.when(F.col("relevant_id") != F.col("query_id"), F.col("wanted"))).drop("relevant_id")
    schema = T.StructType([*[f for f in q.schema.fields if f.name != "wanted"], T.StructField("wanted_score", T.ArrayType(T.DoubleType()))])
    eps = delta
    q = deal(q, "query_id").mapInArrow(_relevant(tuple(methods), delta, eps), schema)
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    t = kinds(gallery).select("*", of("pts", n_routes).alias("_t"), every(n_queries).alias("_q"))
    q = q.select("*", of("query", n_queries).alias("_q"), every(n_routes).alias("_t"))
    both = deal(t, "_t", "_q").groupBy("_t", "_q").cogroup(deal(q, "_t", "_q").groupBy("_t", "_q"))
    found = both.applyInArrow(_count(tuple(methods), delta, eps), _COUNTED)
    counts = ("n_scored", "n_infeasible", "n_ambiguous", "before", "size")
    top = F.collect_list(F.when(F.col("top_score").isNotNull(), F.struct(F.col("top_score").alias("score"), F.col("top_size").alias("size"), F.col("top_id").alias("id"))))
    d = found.groupBy("query_id", "method").agg(*[F.sum(c).alias(c) for c in counts], F.max("wanted_score").alias("wanted_score"), top.alias("_top"))
    d = d.where("n_scored + n_infeasible + n_ambiguous > 0").withColumn("_best", F.array_min("_top")["score"])
    level = F.filter("_top", lambda x: x["score"] == F.col("_best"))
    size = F.aggregate(level, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    d = d.withColumn("top", F.struct(F.array_min(F.transform(level, lambda x: x["id"])).alias("first_id"), size.alias("size"), F.col("_best").alias("score")))
    g = F.struct(F.col("wanted_score").alias("score"), "size", F.lit(1).cast("long").alias("rel"), "before")
    d = d.withColumn("g", F.when(F.col("wanted_score").isNotNull(), g)).drop("size", "before", "wanted_score", "_top", "_best")
    return retrieval.judged(d, ks)


def _tally(block, methods: tuple[str, ...]):
    """Per query, method and score of a block: how many templates, their least id, and how many are relevant.

    Templates of one curve, and queries of one curve, are scored once. Rows of _block's output are (query, template) pairs of
    the first of their kind; weights come from the lists of ids.
    """

    def run(routes, queries):
        import pyarrow as pa

        names = ["query_id", "method", "score", "size", "rel", "first_id"]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        if not routes.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        first_t, kind_t = _alike(routes, "pts")
        first_q, kind_q = _alike(queries, "query")
        ids = routes.column("template_id").to_numpy()
        asked, wanted = (queries.column(c).to_numpy() for c in ("query_id", "relevant_id"))
        t = routes.take(pa.array(first_t)).set_column(routes.column_names.index("template_id"), "template_id", pa.array(np.arange(len(first_t))))
        weight = np.bincount(kind_t)
        least = np.full(len(first_t), np.iinfo(np.int64).max)
        np.minimum.at(least, kind_t, ids)
        of_id = {int(i): k for k, i in enumerate(ids)}
        out = [[] for _ in names]
        # A few queries at a time, so that scores of a block take little memory.
        for at in range(0, len(first_q), 32):
            some = first_q[at : at + 32]
            q = queries.take(pa.array(some)).select([c for c in queries.column_names if c != "relevant_id"])
            q = q.set_column(q.column_names.index("query_id"), "query_id", pa.array(np.arange(len(some))))
            got = block(t, q)
            place = np.lexsort((got.column("template_id").to_numpy(), got.column("query_id").to_numpy()))
            for m in methods:
                table = got.column(m).to_numpy(zero_copy_only=False)[place].reshape(len(some), len(first_t))
                for k, line in enumerate(table):
                    score, group = np.unique(line, return_inverse=True, equal_nan=True)
                    size = np.bincount(group, weight).astype(np.int64)
                    low = np.full(len(score), np.iinfo(np.int64).max)
                    np.minimum.at(low, group, least)
                    for i in np.flatnonzero(kind_q == at + k):
                        n, first = size, low
                        rel = np.zeros(len(score), np.int64)
                        own = of_id.get(int(asked[i]))
                        if own is not None:  # a query is no template of its own
                            g = group[kind_t[own]]
                            n, first = n.copy(), first.copy()
                            n[g] -= 1
                            if first[g] == ids[own]:
                                others = ids[(group[kind_t] == g) & (ids != ids[own])]
                                first[g] = others.min() if len(others) else 0
                        hit = of_id.get(int(wanted[i]))
                        if hit is not None and hit != own:
                            rel[group[kind_t[hit]]] = 1
                        keep = np.flatnonzero(n > 0)
                        for column, x in zip(out, (np.full(len(keep), asked[i]), np.full(len(keep), m), score[keep], n[keep], rel[keep], first[keep]), strict=True):
                            column.append(x)
        return pa.table([pa.array(np.concatenate(c) if c else [], k, from_pandas=k == pa.float64()) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def tallies(queries: DataFrame, gallery: DataFrame, delta: float, methods: tuple[str, ...] = METHODS, route_block: int = 16384, query_block: int = 4096) -> DataFrame:
    """query_id, method, score, size, rel, first_id: the groups of equal scores of each query, of all routes but one of the query's own id.

    What scores() and retrieval.tie_groups() give for queries (query_id, pts, relevant_id) with one relevant route each and unique
    long ids, but grouped where the scores arise: no row per pair leaves a task. Curves are dealt by what they are, so copies
    meet in a block, where they are scored once.
    """
    return _scored(queries, gallery, delta, None, methods, 3, route_block, query_block, "tally")


def scores(queries: DataFrame, gallery: DataFrame, delta: float, eps: float | None = None, methods: tuple[str, ...] = METHODS, window: int = 3, route_block: int = 2048, query_block: int = 512) -> DataFrame:
    """query_id, method, template_id, score of the stated queries against all routes; infinite where infeasible, null where numerically ambiguous.

    Routes and queries are cut into blocks of about route_block and query_block, and each pair of blocks is one task's group, so
    curves are sent once a block and not once a pair.
    """
    d = _scored(queries, gallery, delta, eps, methods, window, route_block, query_block)
    rows = F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("score")) for n in methods])
    return d.select("query_id", "template_id", F.explode(rows).alias("s")).select("query_id", "s.method", "template_id", "s.score")


def _check(delta, methods) -> None:
    check_options(delta, "both")
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")


def _blocks(queries: DataFrame, gallery: DataFrame, route_block: int, query_block: int, spread: bool = True) -> tuple[int, int]:
    """How many blocks of routes and of queries there are; with spread, of few rows still enough for all cores."""
    blocks = lambda n, most: max(1, -(-n // most))
    rows = gallery.count()
    n_routes, n_queries = blocks(rows, route_block), blocks(queries.count(), query_block)
    if spread:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        n_routes = max(n_routes, min(blocks(rows, 256), -(-4 * cores // n_queries)))
    return n_routes, n_queries


def _scored(queries, gallery, delta, eps, methods, window, route_block, query_block, what=None, top=1) -> DataFrame:
    _check(delta, methods)
    ship(queries.sparkSession)
    curve = lambda c: F.col(c).cast("array<array<double>>")
    # With what, blocks are large, as copies meet in one.
    n_routes, n_queries = _blocks(queries, gallery, route_block, query_block, what is not None)
    if what == "nearest":  # of equal curves only the first routes can be among the best
        gallery = kinds(gallery, top).select(F.explode("ids").alias("route_id"), "pts")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    key = (lambda c: "pts") if what else (lambda c: c)
    t = gallery.select(F.col("route_id").alias("template_id"), curve("pts").alias("pts"), own(key("route_id"), n_routes).alias("_t"), every(n_queries).alias("_q"))
    also = [C.smooth(curve("pts"), window).alias("smooth")] if "filter_frechet" in methods else []
    q = queries.select("query_id", *(["relevant_id"] if what == "tally" else []), curve("pts").alias("query"), *also, own(key("query_id"), n_queries).alias("_q"), every(n_routes).alias("_t"))
    schema = T.StructType([q.schema["query_id"], t.schema["template_id"], *[T.StructField(m, T.DoubleType()) for m in methods]])
    block = _block(tuple(methods), delta, delta if eps is None else eps)
    both = deal(t, "_t", "_q").groupBy("_t", "_q").cogroup(deal(q, "_t", "_q").groupBy("_t", "_q"))
    if what is None:
        return both.applyInArrow(block, schema)
    if what == "nearest":
        return both.applyInArrow(_nearest(methods[0], delta, delta if eps is None else eps, top), T.StructType([*schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("template", t.schema["pts"].dataType)]))
    found = both.applyInArrow(_tally(block, tuple(methods)), "query_id long, method string, score double, size long, rel long, first_id long")
    return found.groupBy("query_id", "method", "score").agg(F.sum("size").alias("size"), F.sum("rel").alias("rel"), F.min("first_id").alias("first_id"))


def best_routes(queries: DataFrame, gallery: DataFrame, delta: float, top: int = 1, mode: str = "delete") -> DataFrame:
    """Of each query the `top` routes of fewest edits (ties to the smaller id), with rank and the edit script of each, as discrete_edits gives it."""
    place = W.partitionBy("query_id").orderBy("score", "template_id")
    near = _scored(queries, gallery, delta, None, (f"fed_{mode}",), 3, 65536, 4096, "nearest", top).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    best = near.select("query_id", "template_id", "rank", "template").join(queries.select("query_id", F.col("pts").alias("query")), "query_id")
    best = best.select("template_id", "query_id", "rank", "query", "template")
    return edits.discrete_edits(deal(best, "template", "query"), "template", "query", delta, mode, witness=True)


def evaluate(queries: DataFrame, gallery: DataFrame, scored: DataFrame, n_validation: int = 2, quantile: float = 0.95, ks: tuple[int, ...] = (1, 5)) -> tuple[DataFrame, DataFrame]:
    """(outcomes, summary): one row per query and method, one per method.

    Acceptance thresholds come from closed queries of the first n_validation families; the summary from all others.
    Open queries, which have no relevant route, count for the false-match rate alone.
    """
    relevant = queries.select("query_id", F.explode("relevant").alias("template_id"))
    out = retrieval.outcomes(scored, relevant, ks).join(queries.select("query_id", "open_set"), "query_id")
    families = gallery.select("family").distinct().orderBy("family").limit(n_validation).withColumn("validation", F.lit(True))
    out = out.withColumn("family", F.split_part("query_id", F.lit("-"), F.lit(1))).join(F.broadcast(families), "family", "left")
    out = out.withColumn("validation", F.coalesce("validation", F.lit(False)) & ~F.col("open_set"))
    limits = retrieval.thresholds(out.where("validation"), quantile)
    test = out.where("not validation").join(F.broadcast(limits), "method", "left")
    summary = retrieval.aggregate(test.where("not open_set").drop("threshold"))
    accepted = ~F.col("abstained") & (F.col("top1_score") <= F.col("threshold"))
    opened = test.where("open_set").groupBy("method").agg(
        F.first("threshold").alias("threshold"),
        F.when(F.first("threshold").isNotNull(), F.count("*")).otherwise(F.lit(0)).alias("n_open_set"),
        F.when(F.first("threshold").isNotNull(), F.avg(F.coalesce(accepted, F.lit(False)).cast("double"))).alias("false_match_rate"),
    )
    return out, summary.join(opened, "method", "left")


def load_config(path: str) -> dict:
    """Settings of an experiment from TOML."""
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def write_run(outcomes: DataFrame, summary: DataFrame, folder: str) -> None:
    """A run's rows as JSON lines under folder/per_query and folder/summary."""
    outcomes.write.mode("overwrite").json(f"{folder}/per_query", ignoreNullFields=False)
    summary.write.mode("overwrite").json(f"{folder}/summary", ignoreNullFields=False)


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, summary) of a run that write_run left; fails if either lacks a field the report needs."""
    found = spark.read.json(f"{folder}/per_query"), spark.read.json(f"{folder}/summary")
    for d, needed in zip(found, (("query_id", "method", "abstained"), _REQUIRED), strict=True):
        if missing := [c for c in needed if c not in d.columns]:
            raise ValueError(f"the run lacks {missing}")
    return found


def kind_counts(gallery: DataFrame) -> DataFrame:
    """kind, n: routes of each kind."""
    return gallery.groupBy("kind").agg(F.count("*").alias("n"))


_REQUIRED = ("method", "n_queries", "coverage", "hit1_strict", "hit1_expected", "hit1_optimistic", "rr_strict", "rr_expected", "rr_optimistic")


def report(summary: DataFrame, title: str = "Retrieval", gallery: DataFrame | None = None) -> str:
    """Markdown of a summary (one row a method), best strict hit first, with the gallery's routes by kind; fails if a field is missing."""
    missing = [c for c in _REQUIRED if c not in summary.columns]
    if missing:
        raise ValueError(f"the summary lacks {missing}")
    rows = summary.orderBy(F.desc("hit1_strict"), "method").collect()
    if any(r[c] is None for r in rows for c in _REQUIRED):
        raise ValueError("the summary has empty fields")
    number = lambda x: x if isinstance(x, str) else str(x) if isinstance(x, int) else f"{x:.3f}"
    lines = [f"# {title}", "", "| " + " | ".join(_REQUIRED) + " |", "|" + "-|" * len(_REQUIRED)]
    lines += ["| " + " | ".join(number(r[c]) for c in _REQUIRED) + " |" for r in rows]
    if gallery is not None:
        lines += ["", "| kind | routes |", "|-|-|", *[f"| {r.kind} | {r.n} |" for r in kind_counts(gallery).orderBy("kind").collect()]]
    return "\n".join(lines) + "\n"


def result_json(columns: list[str]) -> Column:
    """Result columns as one JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def config_json(config: dict) -> str:
    return json.dumps(config, sort_keys=True)
