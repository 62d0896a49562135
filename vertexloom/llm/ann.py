"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vertexloom.llm.base import Workspace


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(k):
            if (m := own == j).any():
                c[j] = x[m].mean(0)
    return np.unique(c, axis=0)


class Tree:
    """Inner nodes hold the centres of their children; leaves are numbered.

    Inner product search is done in a space of one more dimension, where every vector has the
    length of the longest, so that the nearest by distance is the largest by inner product.
    """

    def __init__(self, sample: np.ndarray, longest: float, branch: int, leaf_rows: int, most_leaves: int, seed: int = 7):
        self.longest = longest
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # centres, children (leaf j as -1 - j)
        self.leaves = 0
        x = self.lift(sample)
        if not len(x):
            x = np.zeros((1, sample.shape[1] + 1))
        self.root = self._grow(x, branch, leaf_rows, most_leaves, rng)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.column_stack([x, rest])

    def _grow(self, x, branch, leaf_rows, most_leaves, rng) -> int:
        k = min(branch, most_leaves, len(x) // max(1, leaf_rows) + 1)
        c = _kmeans(x, k, rng) if k > 1 and len(np.unique(x, axis=0)) > k else x[:1]
        if len(c) < 2:
            self.leaves += 1
            return -self.leaves
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        at = len(self.nodes)
        self.nodes.append((c, []))
        for j in range(len(c)):
            self.nodes[at][1].append(self._grow(x[own == j], branch, leaf_rows, max(1, most_leaves // len(c)), rng))
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        x = self.lift(x)
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                c, kids = self.nodes[node]
                own = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
                todo += [(kid, rows[own == j]) for j, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """Best bin first, for many queries at once: [query, leaf] the place at which each leaf is opened.

        The unopened branch with the nearest centre is opened next, so a leaf comes when the farthest centre on its way does.
        """
        length = np.sqrt((q * q).sum(1))
        q = np.column_stack([q * (self.longest / np.where(length > 0, length, 1.0))[:, None], np.zeros(len(q))])
        own = np.zeros((len(q), self.leaves))
        late = np.zeros((len(q), self.leaves))
        todo = [(self.root, np.zeros(len(q)), np.zeros(len(q)))]
        while todo:
            node, far, last = todo.pop()
            if node < 0:
                late[:, -1 - node], own[:, -1 - node] = far, last
            else:
                c, kids = self.nodes[node]
                d = np.maximum((c * c).sum(1) - 2 * q @ c.T + (q * q).sum(1)[:, None], 0.0)
                todo += [(kid, np.maximum(far, d[:, j]), d[:, j]) for j, kid in enumerate(kids)]
        first = np.lexsort((own, late), axis=1)
        place = np.empty_like(first)
        np.put_along_axis(place, first, np.broadcast_to(np.arange(self.leaves), first.shape), axis=1)
        return place


def _vectors(batch, d: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 vectors) of a batch's usable rows, by length; of length d alone where it's given."""
    column = batch.column("v")
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    start = np.cumsum(sizes) - sizes
    named = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[sizes > 0]) if d is None else [d]:
        rows = np.flatnonzero((sizes == size) & named)
        x = flat[start[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        out.append((rows[good], x[good]))
    return out


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products whose rounding doesn't depend on where a row stands."""
    return (x * q).sum(axis=1)


class _Best:
    """The k best rows of each of many queries so far.

    Rows are singled out by products of vectors brought below 1 by a power of two, which can't overflow, in single precision
    where that is safe, with room for its rounding; then they are ordered by the products of the vectors as they are. fine
    orders those that exceed double precision.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, unit: int, k: int):
        self.ids, self.vectors, self.unit, self.k = ids, vectors, unit, k
        self.small = np.ldexp(vectors, unit)
        self.length = np.sqrt((self.small * self.small).sum(1))
        self.single = self.small.astype(np.float32)
        self.top = np.full((len(ids), k), -np.inf)
        self.room = {True: np.empty(1 << 18, np.float32), False: np.empty(1 << 18)}
        self.pool: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: np.ndarray) -> None:
        """Let queries of the numbers some meet these rows, which are in order of id."""
        small = np.ldexp(vectors, self.unit)
        most = math.sqrt(float((small * small).sum(1).max())) if len(small) else 0.0
        single = most > 1e-12
        x = small.astype(np.float32) if single else small
        rows = (ids, vectors, small, leaf)
        cut = self.top[some].min(axis=1)
        new = some[cut == -np.inf]
        for at in range(0, len(new), 256):
            for lo in range(0, len(ids), 4096):
                self._first(new[at : at + 256], *[c[lo : lo + 4096] for c in (*rows, x)], single, most)
        known = some[cut > -np.inf]
        for at in range(0, len(known), 512):
            self._rest(known[at : at + 512], *rows, x, single, most)

    def _limit(self, some, cut, x, single, most) -> np.ndarray:
        """What a product must reach for its row to be looked at: rounding may have taken that much from it, and given it to others."""
        slack = 4 * (x.shape[1] + 4) * 2.0 ** (-24 if single else -53) * self.length[some] * most
        # Rounded down, so that comparing in single precision loses none.
        kind = np.float32 if single else np.float64
        return np.nextafter((cut - slack).astype(kind), kind(-np.inf))

    def _first(self, some, ids, vectors, small, leaf, x, single, most) -> None:
        """Queries that have no k rows yet: their own rows stand back, and the k-th of these rows is the limit."""
        single = single and float(self.length[some].min()) > 1e-12
        x = x if single else small
        near = (self.single if single else self.small)[some] @ x.T
        lo, hi = np.searchsorted(ids, self.ids[some]), np.searchsorted(ids, self.ids[some], side="right")
        for i in np.flatnonzero(hi > lo):
            near[i, lo[i] : hi[i]] = -np.inf
        cut = self.top[some].min(axis=1)
        if near.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k])
        q, r = np.nonzero((near >= self._limit(some, cut, x, single, most)[:, None]) & (near > -np.inf))
        self._take(some, q, r, near[q, r], ids, vectors, small, leaf)

    def _rest(self, some, ids, vectors, small, leaf, x, single, most) -> None:
        """Queries that have k rows: few others reach their limit. Products of a tile stay in the processor's cache."""
        single = single and float(self.length[some].min()) > 1e-12
        x = x if single else small
        limit = self._limit(some, self.top[some].min(axis=1), x, single, most)[:, None]
        asked = (self.single if single else self.small)[some]
        hits = []
        for lo in range(0, len(ids), 512):
            part = x[lo : lo + 512]
            tile = self.room[single][: len(some) * len(part)].reshape(len(some), len(part))
            np.matmul(asked, part.T, out=tile)
            if len(at := np.flatnonzero(tile >= limit)):
                q, r = np.divmod(at, len(part))
                hits.append((q, r + lo, tile.ravel()[at].astype(np.float64)))
        if hits:
            q, r, got = (np.concatenate(c) for c in zip(*hits, strict=True))
            other = np.flatnonzero(ids[r] != self.ids[some[q]])
            order = other[np.argsort(q[other], kind="stable")]
            self._take(some, q[order], r[order], got[order], ids, vectors, small, leaf)

    def _take(self, some, q, r, got, ids, vectors, small, leaf) -> None:
        """Rows r for queries some[q], in order of q, with their products so far."""
        if not len(q):
            return
        count = np.bincount(q, minlength=len(some))
        pad = np.full((len(some), int(count.max())), -np.inf)
        pad[q, np.arange(len(q)) - (np.cumsum(count) - count)[q]] = got
        hit = np.flatnonzero(count)
        both = np.concatenate([self.top[some[hit]], pad[hit]], axis=1)
        self.top[some[hit]] = np.partition(both, pad.shape[1], axis=1)[:, pad.shape[1] :]
        for a in range(0, len(q), 1 << 16):
            i, j = q[a : a + (1 << 16)], r[a : a + (1 << 16)]
            with np.errstate(over="ignore", invalid="ignore"):
                score = _exact(vectors[j], self.vectors[some[i]])
            finer = np.zeros(len(i))
            if len(beyond := np.flatnonzero(~np.isfinite(score))):
                finer[beyond] = _exact(small[j[beyond]], self.small[some[i[beyond]]])
                score[beyond] = np.copysign(np.inf, finer[beyond])
            self.pool.append([some[i], ids[j], score, finer, leaf[j]])
            self.held += len(i)
        if self.held > 3 * self.k * len(self.ids) + (1 << 20):
            self.result()

    def result(self) -> list[np.ndarray]:
        """Query numbers, ids, scores, fine and leaves, best first within each query."""
        kinds = (np.int64, np.int64, np.float64, np.float64, np.int64)
        columns = [np.concatenate(c).astype(t) for c, t in zip(zip(*self.pool, strict=True), kinds, strict=True)] if self.pool else [np.zeros(0, t) for t in kinds]
        order = np.lexsort((columns[1], -columns[3], -columns[2], columns[0]))
        columns = [c[order] for c in columns]
        count = np.bincount(columns[0], minlength=len(self.ids))
        mine = np.arange(len(order)) - (np.cumsum(count) - count)[columns[0]] < self.k
        columns = [c[mine] for c in columns]
        self.pool, self.held = [columns], len(columns[0])
        return columns


def _copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that can be among some query's k best, rows being in order of id.

    Of one vector's rows k of each id at most, and of those the first 2 * k: without the rows of a query's own id, k are left.
    """
    words = np.ascontiguousarray(vectors).view(np.uint64)
    odd = np.random.default_rng(5).integers(1, 1 << 62, words.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = ((words ^ (words >> np.uint64(29))) * odd).sum(axis=1)
    order = np.argsort(mixed, kind="stable")

    def joined(order: np.ndarray) -> np.ndarray:
        same = mixed[order][1:] == mixed[order][:-1]
        at = np.flatnonzero(same)
        same[at] = (vectors[order[at]] == vectors[order[at + 1]]).all(1)
        return same

    same = joined(order)
    if not same.any():
        return np.arange(len(ids))

    def place(same: np.ndarray) -> np.ndarray:
        at = np.arange(len(same) + 1)
        return at - np.maximum.accumulate(np.where(np.append(False, same), 0, at))

    order = order[place(same & (ids[order][1:] == ids[order][:-1])) < k]
    # Rows between two of a vector's may be gone, never the first of them.
    return np.sort(order[place(joined(order)) < 2 * k])


def _clean(d: int | None):
    """Usable rows of length d; or, without d, a row a batch and length: rows, exponent of the largest component, greatest length below it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if d is not None:
                rows = pa.array(_vectors(b, d)[0][0])
                yield pa.RecordBatch.from_arrays([b.column(c).take(rows) for c in ("id", "v")], ["id", "v"])
                continue
            out = []
            for _, x in _vectors(b):
                if len(x):
                    e = math.frexp(float(np.abs(x).max()))[1]
                    out.append((x.shape[1], len(x), e, math.sqrt(float((np.ldexp(x, -e) ** 2).sum(1).max()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.float64()))], ["d", "n", "e", "l"])

    return run


def _truth(tree: Tree, unit: int, d: int, k: int, ids: np.ndarray, asked: np.ndarray):
    """The k best rows of each asked query in a partition, with their leaves; and the rows of each leaf, as query -1."""

    def run(batches):
        import pyarrow as pa

        best, n = _Best(ids, asked, unit, k), np.zeros(tree.leaves, np.int64)
        for b in batches:
            rows, x = _vectors(b, d)[0]
            if len(rows):
                leaf = tree.assign(np.ldexp(x, unit))
                n += np.bincount(leaf, minlength=tree.leaves)
                names = b.column("id").take(pa.array(rows)).to_numpy(zero_copy_only=False)
                kept = _ordered(names, x, k)
                best.add(np.arange(len(ids)), names[kept], x[kept], leaf[kept])
        some = np.flatnonzero(n)
        none = np.zeros(len(some))
        whole = [np.append(a, c) for a, c in zip((np.full(len(some), -1), n[some], none, none, some), best.result(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in whole], ["query", "vec_id", "score", "fine", "leaf"])

    return run


def _to_blocks(tree: Tree, unit: int, d: int, first: np.ndarray, cuts: np.ndarray):
    """Rows with their leaf and block; a leaf of several blocks deals its rows by id."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, x = _vectors(b, d)[0]
            rows = pa.array(rows)
            names = b.column("id").take(rows)
            leaf = tree.assign(np.ldexp(x, unit)) if len(x) else np.zeros(0, np.int64)
            mixed = names.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = first[leaf] + (mixed % cuts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), names, b.column("v").take(rows), pa.array(leaf, pa.int64())], ["block", "id", "v", "leaf"])

    return run


def _ask(tree: Tree, unit: int, most: int, first: np.ndarray, cuts: np.ndarray):
    """Queries, once for each block that holds one of the most leaves they visit, with those leaves as bits from the block's first one on."""
    lowest, highest = _spans(first, cuts)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = _vectors(b)[0][1]
                visited = tree.order(np.ldexp(x, unit)) < most
                for block, (lo, hi) in enumerate(zip(lowest, highest, strict=True)):
                    if len(some := np.flatnonzero(visited[:, lo:hi].any(axis=1))):
                        bits = np.packbits(visited[some, lo:hi], axis=1)
                        n = pa.array(some)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), *[b.column(c).take(n) for c in ("key", "id", "v")], pa.array([r.tobytes() for r in bits], pa.binary())], ["block", "key", "qid", "qv", "bits"])

    return run


def _spans(first: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the first leaf and the one after the last."""
    n = int((first + cuts).max())
    leaf = np.arange(len(first))
    lowest, highest = np.full(n, len(first)), np.zeros(n, np.int64)
    for i, (f, c) in enumerate(zip(first.tolist(), cuts.tolist(), strict=True)):
        lowest[f : f + c], highest[f : f + c] = np.minimum(lowest[f : f + c], leaf[i]), leaf[i] + 1
    return lowest, highest


def _plan(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, cuts): leaves one after another share a block of about most rows; one of more rows has several of its own."""
    cuts, first = np.maximum(1, -(-n // most)), np.zeros(len(n), np.int64)
    at, held = 0, 0
    for i, (rows, c) in enumerate(zip(n.tolist(), cuts.tolist(), strict=True)):
        if held and held + rows > most:
            at, held = at + 1, 0
        first[i] = at
        if c > 1:
            at, held = at + c, 0
        else:
            held += rows
    return first, cuts


def _ordered(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that matter, in order of id."""
    order = np.argsort(ids, kind="stable")
    return order[_copies(ids[order], vectors[order], k)]


def _scan(k: int, unit: int, lowest: np.ndarray):
    """One cogroup: a block of rows, and a block of the queries that visit some of its leaves."""

    def run(where, rows, queries):
        import pyarrow as pa

        names, kinds = ["key", "query_id", "vec_ids", "scores", "fines"], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        start = int(lowest[where[0].as_py()])
        ids, leaf = (rows.column(c).to_numpy() for c in ("id", "leaf"))
        column = rows.column("v").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        by_leaf = np.argsort(leaf, kind="stable")
        leaves, at = np.unique(leaf[by_leaf], return_index=True)
        parts = [p[_ordered(ids[p], flat[p].astype(np.float64), k)] for p in np.split(by_leaf, at[1:])]
        out = []
        for at in range(0, queries.num_rows, 1 << 14):
            some = queries.slice(at, 1 << 14)
            key, qid = (some.column(c).to_numpy() for c in ("key", "qid"))
            asked = some.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(qid), -1)
            bits = some.column("bits").combine_chunks()
            visited = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(qid), -1), axis=1)
            best = _Best(qid, asked, unit, k)
            for own, part in zip(leaves.tolist(), parts, strict=True):
                best.add(np.flatnonzero(visited[:, own - start]), ids[part], flat[part].astype(np.float64), leaf[part])
            of, vec, score, fine, _ = best.result()
            ends = np.cumsum(np.bincount(of, minlength=len(qid)))
            cut = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(c)) for c in (vec, score, fine)]
            out.append(pa.table([pa.array(key, pa.int64()), pa.array(qid, pa.int64()), *lists], names=names))
        return pa.concat_tables(out)

    return run


FOUND = "key long, query_id long, vec_ids array<long>, scores array<double>, fines array<double>"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.96, sample_rows: int = 20000, calibrate: int = 200, branch: int = 16, leaf_rows: int = 64, most_leaves: int = 1024, block_rows: int = 1 << 17, query_rows: int = 1 << 17, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, largest inner product first.

    The tree is fitted on at most sample_rows rows and has at most most_leaves leaves, so what
    is broadcast is bounded; every row is indexed. Up to calibrate sampled queries are answered
    exactly over all rows, where these lie, and the visits are widened until the leaves that hold
    target of their true neighbours are reached. Leaves share blocks of at most block_rows rows, a larger one (such as one vector held by
    a third of all rows) is cut into several, and each block meets the queries that visit it, up to query_rows at once; what goes
    from a block to the end is each query's k best there. Of a vector's copies in one leaf only those that can be among the k
    nearest are compared. Ties go to the smaller id.
    Vectors that are null, zero, or hold nulls or non-finite values take no part, nor do rows
    without id or of another length than most; of a repeated id each row is a candidate, and as a query has results of its
    own; rows of a query's own id are never among them. Fewer candidates than k give fewer rows; an empty table gives none.
    Columns other than the two named are not read. A score that exceeds double precision is infinite, in its right place.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    kind = "array<float>" if all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "array<double>"
    x, q = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")) for df in (vectors, queries))
    stats = ws.keep(x.mapInArrow(_clean(None), "d int, n long, e int, l double").groupBy("d", "e").agg(F.sum("n").alias("n"), F.max("l").alias("l")), "lengths")
    usual = stats.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = usual.d, usual.n
    found = stats.where(F.col("d") == d).collect()  # one row an exponent
    unit = -max(r.e for r in found)
    longest = max(math.ldexp(r.l, r.e + unit) for r in found)
    some = x
    if n > sample_rows:
        share = (sample_rows - 4 * math.sqrt(sample_rows)) / n
        some = x.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < int(share * (1 << 40)))
    some = some.mapInArrow(_clean(d), f"id long, v {kind}").limit(sample_rows).toArrow()
    tree = Tree(np.ldexp(_vectors(some, d)[0][1], unit), longest, branch, leaf_rows, most_leaves)
    q = q.mapInArrow(_clean(d), f"id long, v {kind}")
    q = ws.keep(q.withColumn("key", F.monotonically_increasing_id()), "queries")  # written, so keys stay
    trial = q.orderBy(F.xxhash64("id", F.lit(11)), "key").limit(calibrate).toArrow()
    ids, asked = trial.column("id").to_numpy(), _vectors(trial, d)[0][1]
    truth = ws.keep(x.mapInArrow(_truth(tree, unit, d, k, ids, asked), "query long, vec_id long, score double, fine double, leaf long"), "truth")
    rows = np.zeros(tree.leaves, np.int64)
    for r in truth.where("query < 0").groupBy("leaf").agg(F.sum("vec_id").alias("n")).collect():  # at most most_leaves rows
        rows[r.leaf] = r.n
    w = W.partitionBy("query").orderBy(F.desc("score"), F.desc("fine"), "vec_id")
    near = truth.where("query >= 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "leaf").collect()  # at most calibrate * k rows
    place = tree.order(np.ldexp(asked, unit))
    visits = np.sort(place[[r.query for r in near], [r.leaf for r in near]]) if near else np.zeros(0, np.int64)
    most = int(visits[max(0, math.ceil(target * len(visits)) - 1)]) + 1 if len(visits) else 1
    # About twelve blocks, if they aren't too large for that: the more there are, the more often a query is sent.
    first, cuts = _plan(rows, max(1024, min(block_rows, -(-n // 12))))
    parts = max(1, -(-q.count() // query_rows))
    held = x.mapInArrow(_to_blocks(tree, unit, d, first, cuts), f"block long, id long, v {kind}, leaf long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    sent = q.mapInArrow(_ask(tree, unit, most, first, cuts), f"block long, key long, qid long, qv {kind}, bits binary").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    got = held.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(_scan(k, unit, _spans(first, cuts)[0]), FOUND).repartition("key")
    one = got.select("key", "query_id", F.explode(F.arrays_zip("vec_ids", "scores", "fines")).alias("f")).select("key", "query_id", F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score"), F.col("f.fines").alias("fine"))
    w = W.partitionBy("key").orderBy(F.desc("score"), F.desc("fine"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
