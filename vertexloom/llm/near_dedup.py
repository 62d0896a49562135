"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace, components, slices

HASHES = 128
SKETCH = "doc_id long, n_shingles long, digest binary, sig binary"
_LEVEL = np.uint64(0x9FB21C651E98DF25)


def _sketch(k: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        from vertexloom.llm.textblocks import MinHash, Words, shingles

        minwise = MinHash(HASHES)
        for batch in batches:
            for b in slices(batch, "text"):
                words = Words(b.column("text"))
                h = words.hashes()
                n, digest, sig = [], [], []
                for i in range(len(words)):
                    s = np.unique(shingles(h[words.first_word[i] : words.first_word[i + 1]], k))
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(minwise(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _branch(node: np.ndarray, row: np.ndarray, sig: np.ndarray, steps: int, again: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, row): each node chooses one minwise token, and a second one in a share `again` of nodes.

    The choice depends on the node alone, so all rows at a node choose alike, wherever they are.
    """
    from vertexloom.llm.textblocks import mix

    for _ in range(steps):
        with np.errstate(over="ignore"):
            c = mix(node * _LEVEL + np.uint64(1))
            first = (c % np.uint64(HASHES)).astype(np.int64)
            second = ((c >> np.uint64(8)) % np.uint64(HASHES - 1)).astype(np.int64)
            second += second >= first
            more = (c >> np.uint64(40)).astype(np.float64) < again * 2**24
            down = [mix(node ^ mix((col.astype(np.uint64) << np.uint64(32)) | sig[row, col])) for col in (first, second)]
        node, row = np.concatenate([down[0], down[1][more]]), np.concatenate([row, row[more]])
    return node, row


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)


def _paths(trials: int, steps: int, again: float):
    def run(batches):
        import pyarrow as pa

        from vertexloom.llm.textblocks import mix

        roots = mix(np.arange(1, trials + 1, dtype=np.uint64))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = part.num_rows
                sig = _sigs(part.column("sig"))
                for tree, root in enumerate(roots):
                    node, row = _branch(np.full(n, root), np.arange(n), sig, steps, again)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column("rep").take(pa.array(row)), pa.array(np.full(len(row), tree, np.int32))], ["node", "rep", "tree"])

    return run


def _deeper(steps: int, again: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                node = b.column("node").to_numpy().view(np.uint64)
                node, row = _branch(node, np.arange(b.num_rows), _sigs(b.column("sig")), steps, again)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[b.column(c).take(pa.array(row)) for c in ("rep", "tree")]], ["node", "rep", "tree"])

    return run


def _alike(least: float):
    """Rows of a node (or of two of its blocks) whose sketch is like that of a row of another component."""

    def run(t):
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        hit = np.zeros(len(comp), bool)
        for i in np.flatnonzero(side != 1):
            to = np.flatnonzero((comp != comp[i]) & (side != 0 if side[i] == 0 else True))
            near = to[(sig[to] == sig[i]).mean(axis=1) >= least]
            if len(near):
                hit[i] = True
                hit[near] = True
        return t.filter(hit).drop_columns(["sig"])

    return run


def _link(k: int, num: int, den: int):
    """Links across components within a node, confirmed on full sets; a spanning forest of them, so no more than rows."""

    def run(t):
        import pyarrow as pa

        from vertexloom.llm.textblocks import Words, shingles

        if not t.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        sets: list[np.ndarray] = []
        for b in t.select(["text"]).combine_chunks().to_batches():
            for part in slices(b, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                sets += [np.unique(shingles(h[w.first_word[i] : w.first_word[i + 1]], k)) for i in range(len(w))]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[word] > 1
        row, word = row[shared], word[shared]
        _, word = np.unique(word, return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(word.max()) + 1 if len(word) else 0, 2048):
            some = (word >= lo) & (word < lo + 2048)
            m = np.zeros((len(sets), 2048), np.float32)
            m[row[some], word[some] - lo] = 1
            both += m @ m.T
        alike = den * both >= num * (size[:, None] + size[None, :] - both)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x] = parent.get(parent[x], parent[x])
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y and both[i, j] > 0:
                parent[max(x, y)] = min(x, y)
                out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _confirm(k: int, num: int, den: int):
    def run(batches):
        import pyarrow as pa

        from vertexloom.llm.textblocks import Words, shingles

        for batch in batches:
            for b in slices(batch, "ta"):
                sets = []
                for col in ("ta", "tb"):
                    w = Words(b.column(col))
                    h = w.hashes()
                    sets.append([np.unique(shingles(h[w.first_word[i] : w.first_word[i + 1]], k)) for i in range(len(w))])
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(k: int, num: int, den: int):
    """Links inside a node, or two of its blocks: only rows whose sketch is within 0.15 of the threshold of another component's row have their full sets compared."""
    alike, link = _alike(num / den - 0.15), _link(k, num, den)

    def run(t):
        return link(alike(t))

    return run


def _exhaust(ws: Workspace, nodes: DataFrame, comp: DataFrame, reps: DataFrame, text: DataFrame, k: int, num: int, den: int, leaf: int) -> DataFrame:
    """Links between rows of different components that share a node: sketches single out rows, full sets decide."""
    placed = nodes.select("node", "rep", "n").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    torn = placed.groupBy("node").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("node")
    torn = ws.keep(placed.join(torn, "node", "left_semi").select("node", "rep", "n", "comp").dropDuplicates(["node", "rep"]), "torn")
    wide = torn.join(reps.dropDuplicates(["rep"]), "rep")
    parts = F.ceil(F.col("n") / (16 * leaf)).cast("long")
    wide = wide.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # A row meets every block of its node once: side 0 from the lower block, 1 from the higher, 2 within one.
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    wide = wide.select("rep", "comp", "sig", side.alias("side"), "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    some = text.join(torn.select(F.col("rep").alias("u")).distinct().hint("shuffle_hash"), text.doc_id == F.col("u"), "left_semi")
    met = wide.join(some.select(F.col("doc_id").alias("rep"), "text"), "rep")
    links = ws.keep(met.groupBy("node", "lo", "hi").applyInArrow(_meet(k, num, den), "a long, b long").distinct(), "links", 256)
    ws.drop(torn)
    return links


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, trials: int = 16, start: int = 4, leaf: int = 64, deepest: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Texts link if den * |intersection| >= num * |union| of their k-word shingle sets.

    Equal sets are one class from the start, with a combinable minimum, so exact copies cost
    nothing more. Class representatives are the rows of a chosen-path join: in each of `trials`
    independent trees a node chooses one of 128 minwise tokens, or two often enough that a pair at the
    threshold has one common child on average, and rows branch to the children their tokens
    name. Nodes of over `leaf` rows branch on, to `deepest`. A pair at the threshold meets in
    about 6 of 10 trees at depth 4 and 4 of 10 at depth 8, so 16 trees miss about one in 5000 of
    the deepest and none in practice of the others.

    Within a node, rows are linked to its smallest row first, and confirmed on their full sets; then
    only rows across components need comparing: sketches single out the rows that are like one of
    another component (to 0.15 under the threshold, over four deviations of a sketch at 0.8), and these are compared exhaustively on their full sets, inside the node, of which
    only a spanning forest of links leaves. A node that stays large is compared in pairs of
    blocks, by many tasks.

    Null, empty and wordless texts have no shingles and link with nothing. Rows with a null id are
    returned with null component and kept; rows that repeat an id are judged together. Of texts that link, the
    smallest id names the class, so there are no ties. An empty
    table gives no rows; other columns are not read. Texts are read whole.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    again = den / num - 1
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = ws.keep(d.mapInArrow(_sketch(k), SKETCH), "sketches", 256)
    linkable = sk.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    mine = sk.select("digest", F.col("doc_id").alias("rep"), "sig").join(classes.hint("shuffle_hash"), ["digest", "rep"], "left_semi")
    reps = ws.keep(mine.dropDuplicates(["rep", "digest"]).select("rep", "sig"), "reps")

    grown = []
    rows = ws.keep(reps.mapInArrow(_paths(trials, start, again), "node long, rep long, tree int"), "paths", 2048)
    for depth in range(start, deepest + 1, 2):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1")
        # Written first: a join whose sides both are shuffles can split a node that very many rows are at.
        sizes = ws.keep(sizes, "sizes")
        live = ws.keep(rows.join(sizes, "node"), "nodes")
        ws.drop(rows, sizes)
        if depth + 2 > deepest:
            grown.append(live)
            break
        grown.append(live)
        big = live.where(F.col("n") > leaf).select("node", "rep", "tree")
        if big.isEmpty():
            break
        rows = ws.keep(big.join(reps.dropDuplicates(["rep"]), "rep").mapInArrow(_deeper(2, again), "node long, rep long, tree int"), "paths", 2048)
    # Of all but the last level only the small nodes count; large ones have branched on.
    nodes = grown[-1]
    for more in grown[:-1]:
        nodes = nodes.unionByName(more.where(F.col("n") <= leaf))

    text = d.where("doc_id is not null")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = ws.keep(pairs, "pairs")
        used = pairs.select(F.col("a").alias("u")).union(pairs.select(F.col("b").alias("u"))).distinct().hint("shuffle_hash")
        some = text.join(used, text.doc_id == F.col("u"), "left_semi")
        ta = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        both = ta.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        out = ws.keep(both.mapInArrow(_confirm(k, num, den), "a long, b long").distinct(), "links", 128)
        ws.drop(pairs)
        return out

    # First links: every row with the smallest row of its nodes.
    links = confirm(nodes.where("lead < rep").groupBy("rep").agg(F.min("lead").alias("a")).select("a", F.col("rep").alias("b")))
    # A few trees first: what they link needn't be compared in the others.
    some = max(1, trials // 4)
    for lo, hi in ((0, some), (some, trials)):
        comp = ws.keep(components(ws, links), "components")
        links = links.union(_exhaust(ws, nodes.where((F.col("tree") >= lo) & (F.col("tree") < hi)), comp, reps, text, k, num, den, leaf))
        ws.drop(comp)
    ws.drop(reps, *grown)
    comp = components(ws, links)
    named = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sk.select("doc_id", "n_shingles", "digest").join(ws.keep(named, "named"), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    out = ws.keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    ws.drop(sk)
    return out
