"""Repeated passages by MinHash banding over paragraphs.

Paragraphs are of two kinds. A line is one, compared by its 5-word shingles: bands of one minwise value each, enough
of them to miss a pair at the threshold about once in 600, bring lines together, and colliding ones are
verified by exact Jaccard. The other kind doesn't depend on what stands around a passage: of each PASSAGE
words in a row the 5-word shingle with the least hash is an anchor, and the HALF words before it and the HALF
words from it on are paragraphs, one of which lies inside any run of PASSAGE words, wherever that is set
in. Anchored paragraphs match word for word, so their one band is their content.

Paragraphs linked into a component are one passage. Its first document keeps it; elsewhere its words are marked, and the ends
of what is marked are moved outward word by word as long as the kept occurrence goes on alike.
Marked runs of PASSAGE words or more are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vertexloom.llm.base import Workspace, components
from vertexloom.llm.chunks import AT_ONCE, beside, bounds, bucket_of, buckets_for, chunked, items

SHINGLE = 5
#: A passage has over 50 words; HALF is the most that fits on one side of an anchor in every run of PASSAGE words.
PASSAGE, HALF = 51, 26
#: Words that an anchored paragraph can miss of a run on one side; BLOCK words' surroundings are kept together.
REACH, BLOCK = PASSAGE - HALF, 256
_SALT = np.uint64(0xA24BAED4963EE407)


def _sliding(op, x: np.ndarray, k: int) -> np.ndarray:
    """op over each k values in a row."""
    size = 1
    while size < k:
        by = min(size, k - size)
        x, size = op(x[:-by], x[by:]), size + by
    return x


class Paragraphs:
    """Paragraphs of a chunk, lines first: p covers words first[p]:end[p] of document doc[p]."""

    def __init__(self, texts, bands: int):
        from vertexloom.llm.textblocks import PLACE, Words, _power, mix, shingle_at

        self.words = w = Words(texts)
        n = len(w.start)
        self.first = self.end = self.doc = np.zeros(0, np.int64)
        self.content, self.bands, self.lines = np.zeros(0, np.uint64), np.zeros((bands, 0), np.uint64), 0
        self.word_hash = h = w.hashes()
        if n < SHINGLE:
            return
        doc = np.searchsorted(w.first_word, np.arange(n), side="right") - 1
        at_line = np.ones(n, bool)
        breaks = np.cumsum(w.raw == 10)
        at_line[1:] = (breaks[w.start[1:]] != breaks[w.start[:-1]]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(at_line)
        end = np.append(first[1:], n)
        first, end = first[end - first >= SHINGLE], end[end - first >= SHINGLE]
        self.lines = len(first)
        self.shingles = sh = shingle_at(h, SHINGLE)
        if n >= PASSAGE:
            span = PASSAGE - SHINGLE + 1
            low = _sliding(np.minimum, sh, span)
            low[doc[: len(low)] != doc[PASSAGE - 1 :]] = 0
            edge = np.zeros(span - 1, np.uint64)
            top = _sliding(np.maximum, np.concatenate([edge, low, edge]), span)
            anchor = np.flatnonzero((top == sh) & (top > 0))
            before = anchor[anchor - HALF >= w.first_word[doc[anchor]]]
            after = anchor[anchor + HALF <= w.first_word[doc[anchor] + 1]]
            a = np.sort(np.concatenate([before - HALF, after]))
            a = a[np.append(True, a[1:] != a[:-1])] if len(a) else a
            first, end = np.concatenate([first, a]), np.concatenate([end, a + HALF])
        self.first, self.end, self.doc = first, end, doc[first]
        f, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * f[:n], out=sums[1:])
            self.content = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64) * PLACE[16])
        self.content[self.lines :] = mix(self.content[self.lines :] ^ _SALT)
        if self.lines:
            # reduceat over the shingles of each line; the odd ranges between are dropped.
            edges = np.column_stack([first, end - SHINGLE + 1])[: self.lines].ravel()
            pad = np.append(sh, np.full(SHINGLE, np.uint64(2**64 - 1)))
            rng, got = np.random.default_rng(99), []
            with np.errstate(over="ignore"):
                for _ in range(bands):
                    a = rng.integers(1, 2**63, dtype=np.uint64) | np.uint64(1)
                    got.append(mix(np.minimum.reduceat(mix(pad * a), edges)[::2] ^ a))
            self.bands = np.array(got)

    def line_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Band keys of lines, and the line of each."""
        return self.bands.ravel(), np.tile(np.arange(self.lines), len(self.bands))

    def anchored_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Contents of anchored paragraphs, and the paragraph of each."""
        return self.content[self.lines :], np.arange(self.lines, len(self.first))

    def distinct(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order; of each the content of one paragraph, and flags: 1 two documents or more, 2 two contents or more."""
        doc, content = self.doc[at], self.content[at]
        order = np.lexsort((content, key))
        key, doc, content = key[order], doc[order], content[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return key, content, np.zeros(0, np.uint8)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        last = np.append(first[1:], len(key)) - 1
        return key[first], content[first], several + 2 * (content[first] != content[last]).astype(np.uint8)

    def set_of(self, p: int) -> np.ndarray:
        """The shingles of a paragraph, 32 bits each."""
        return np.unique((self.shingles[self.first[p] : self.end[p] - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32))


def _stretches(marked: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """(from, end) of each longest run of marked words inside a document."""
    cut = np.zeros(len(marked) + 1, bool)
    cut[first_word] = True
    on = np.append(marked, False)
    begins = marked & (cut[:-1] | ~np.append(False, marked[:-1]))
    ends = marked & (cut[1:] | ~on[1:])
    return np.column_stack([np.flatnonzero(begins), np.flatnonzero(ends) + 1])


_SAID = "bucket long, cid long, lines boolean, key binary, content binary, flags binary"
_ANSWER = "cid long, bucket long, lines boolean, n long, bits binary, apart binary"


def _announce(bands: int, count: int):
    """Distinct keys of a chunk by bucket; those of lines with the content of one line of each."""

    def run(batches):
        import pyarrow as pa

        for cid, docs, _ in items(batches):
            p = Paragraphs(docs.field("text"), bands)
            for lines in (True, False):
                keys, content, flags = p.distinct(*(p.line_keys() if lines else p.anchored_keys()))
                got = bounds(bucket_of(keys, count))
                blob = lambda x: pa.array([x[a:b].tobytes() for _, a, b in got], pa.binary())  # noqa: B023, E731
                told = blob(content) if lines else pa.nulls(len(got), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([cid] * len(got), pa.int64()), pa.array([lines] * len(got), pa.bool_()), blob(keys), told, blob(flags.astype(np.uint8))], ["bucket", "cid", "lines", "key", "content", "flags"])

    return run


def _repeated(t):
    """Two bits for each key: whether it stands in two documents or more, and whether paragraphs of two contents or more have it."""
    import pyarrow as pa

    lines = t.column("lines").to_numpy()
    parts = []
    for kind in (True, False):
        some = t.filter(pa.array(lines == kind))
        join = lambda c, as_: np.frombuffer(b"".join(some.column(c).to_pylist()), as_)  # noqa: B023, E731
        keys, flags = join("key", np.uint64), join("flags", np.uint8)
        content = join("content", np.uint64) if kind else keys
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        first = np.flatnonzero(new)
        place = np.cumsum(new) - 1
        bits, apart = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        if len(first):
            c, f = content[order], flags[order]
            times = np.add.reduceat(1 + (f & 1).astype(np.int64), first)
            bits[order] = (times > 1)[place]
            apart[order] = ((np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)) | (np.maximum.reduceat(f, first) > 1))[place]
        cuts = np.append(0, np.cumsum([len(x) // 8 for x in some.column("key").to_pylist()]))
        packed = lambda x: pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())  # noqa: B023, E731
        parts.append(pa.table([some.column("cid"), some.column("bucket"), some.column("lines"), pa.array(np.diff(cuts), pa.int64()), packed(bits), packed(apart) if kind else pa.nulls(some.num_rows, pa.binary())], ["cid", "bucket", "lines", "n", "bits", "apart"]))
    return pa.concat_tables(parts)


def _bits(answers, lines: bool, name: str) -> np.ndarray:
    """The bits of a chunk's keys of lines or anchored paragraphs, in order of the keys."""
    import pyarrow as pa

    some = answers.filter(pa.array(answers.column("lines").to_numpy() == lines)) if answers.num_rows else answers
    got = sorted(zip(*(some.column(c).to_pylist() for c in ("bucket", "n", name)), strict=True))
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in got]).astype(bool) if got else np.zeros(0, bool)


HITS = "cid long, row int, word int, n int, content long, u boolean, doc_id long, shingles binary, bands binary, around binary"


def _colliding(bands: int):
    """A row for each paragraph of which a band is repeated, and one (content null, word the block) for the words around their ends.

    The shingles of a line go with its first occurrence in the chunk alone, and only if a line of another content has one of its bands.
    """

    def work(cid, docs, answers):
        import pyarrow as pa

        p = Paragraphs(docs.field("text"), bands)
        begin = p.words.first_word

        def told(of_lines: bool, name: str) -> np.ndarray:
            key, at = p.line_keys() if of_lines else p.anchored_keys()
            return np.unique(at[_bits(answers, of_lines, name)[np.searchsorted(p.distinct(key, at)[0], key)]]) if len(key) else at

        lines = told(True, "bits")
        hit = np.concatenate([lines, told(False, "bits")])
        _, once = np.unique(p.content[lines], return_index=True)
        shown = np.zeros(len(lines), bool)
        shown[once] = True
        shown &= np.isin(lines, told(True, "apart"))
        sets = [p.set_of(x).tobytes() if s else None for x, s in zip(lines, shown, strict=True)]
        vals = [p.bands[:, x].tobytes() if s else None for x, s in zip(lines, shown, strict=True)]
        places = np.concatenate([p.first[hit], p.end[hit]]) - np.tile(begin[p.doc[hit]], 2)
        block = np.unique(np.column_stack([np.tile(p.doc[hit], 2), places // BLOCK]), axis=0)
        lo = np.maximum(block[:, 1] * BLOCK - REACH, 0)
        hi = np.minimum(block[:, 1] * BLOCK + BLOCK + REACH, np.diff(begin)[block[:, 0]])
        short = (p.word_hash >> np.uint64(32)).astype("<u4")
        around = [short[begin[d] + a : begin[d] + b].tobytes() for d, a, b in zip(block[:, 0], lo, hi, strict=True)]
        doc = np.concatenate([p.doc[hit], block[:, 0]])
        rest, none = [None] * (len(hit) - len(lines)), [None] * len(block)
        columns = [
            pa.array(np.full(len(doc), cid), pa.int64()),
            pa.array(doc, pa.int32()),
            pa.array(np.concatenate([p.first[hit] - begin[p.doc[hit]], block[:, 1]]), pa.int32()),
            pa.array(np.concatenate([(p.end - p.first)[hit], lo]), pa.int32()),
            pa.concat_arrays([pa.array(p.content[hit].view(np.int64)), pa.nulls(len(block), pa.int64())]),
            docs.field("doc_id").is_null().take(pa.array(doc)),
            docs.field("doc_id").take(pa.array(doc)),
            pa.array([*sets, *rest, *none], pa.binary()),
            pa.array([*vals, *rest, *none], pa.binary()),
            pa.array([None] * len(hit) + around, pa.binary()),
        ]
        return pa.table(columns, ["cid", "row", "word", "n", "content", "u", "doc_id", "shingles", "bands", "around"])

    return work


def _verify(num: int, den: int):
    """Links of different paragraphs of a band (or pair of its blocks) with enough in common: a spanning forest, so fewer than paragraphs.

    Only pairs that share one of the least (1 - num/den) of either set can reach the threshold, so an
    index of those finds all without comparing every pair; pairs that links connect already aren't compared.
    """

    def run(t):
        import pyarrow as pa

        ids, side = t.column("content").to_numpy(), t.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint32) for x in t.column("shingles").to_pylist()]
        parent = list(range(len(sets)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        index: dict[int, list[int]] = {}
        links = []
        for i in np.argsort([len(s) for s in sets], kind="stable"):
            s = sets[i]
            front = s[: len(s) - -(-num * len(s) // den) + 1].tolist()
            for j in {j for x in front for j in index.get(x, ())}:
                if ids[i] != ids[j] and (side[i] == 2 or side[i] != side[j]) and den * len(sets[j]) >= num * len(s) and top(i) != top(j):
                    both = len(np.intersect1d(s, sets[j], assume_unique=True))
                    if den * both >= num * (len(s) + len(sets[j]) - both):
                        parent[top(i)] = top(j)
                        links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
            for x in front:
                index.setdefault(x, []).append(i)
        both = np.array(sorted(links), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return run


def _alike(own: np.ndarray, kept: np.ndarray) -> int:
    """How many values agree from the start."""
    n = min(len(own), len(kept))
    other = np.flatnonzero(own[:n] != kept[:n])
    return int(other[0]) if len(other) else n


def _marked(w, drops) -> np.ndarray:
    """Words of a chunk that lie in marked paragraphs or between these and their extended ends."""
    row, word, n = (drops.column(c).to_numpy().astype(np.int64) for c in ("row", "word", "n"))
    at = w.first_word[row] + word
    end = at + n
    edges = np.flatnonzero(n == 0)
    if len(edges):
        short = (w.hashes() >> np.uint64(32)).astype("<u4")
        told = drops.select(["side", "around"]).take(edges)
        for k, side, around in zip(edges, *(told.column(c).to_pylist() for c in ("side", "around")), strict=True):
            kept = np.frombuffer(around or b"", "<u4")
            if side:
                end[k] += _alike(short[at[k] : min(w.first_word[row[k] + 1], at[k] + REACH)], kept)
            else:
                at[k] -= _alike(short[max(w.first_word[row[k]], at[k] - REACH) : at[k]][::-1], kept[::-1])
    size = len(w.start) + 1
    return np.cumsum(np.bincount(at, minlength=size) - np.bincount(end, minlength=size))[:-1] > 0


def _cut(cid, docs, drops):
    import pyarrow as pa

    from vertexloom.llm.textblocks import Words

    texts = docs.field("text")
    w = Words(texts)
    removed, spans = [0] * len(docs), [0] * len(docs)
    if drops.num_rows:
        got = _stretches(_marked(w, drops), w.first_word)
        got = got[got[:, 1] - got[:, 0] >= PASSAGE]
        drop: dict[int, list[tuple[int, int]]] = {}
        for x, a, b in zip(np.searchsorted(w.first_word, got[:, 0], side="right") - 1, got[:, 0], got[:, 1], strict=True):
            drop.setdefault(int(x), []).append((int(a), int(b)))
        texts = texts.to_pylist()
        for row, runs in drop.items():
            off = w.offsets[row]
            data, parts, at = w.raw[off : w.offsets[row + 1]].tobytes(), [], 0
            for a, b in runs:
                parts.append(data[at : int(w.start[a] - off)])
                # The gap after a removed run goes with it.
                at = int(w.start[b] - off) if b < w.first_word[row + 1] else len(data)
                removed[row] += b - a
                spans[row] += 1
            texts[row] = b"".join([*parts, data[at:]]).decode().rstrip(" \t\n\x0b\x0c\r")
        texts = pa.array(texts, pa.string())
    columns = [docs.field("doc_id"), pa.array(np.diff(w.first_word), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), texts, docs.field("rest")]
    return pa.table(columns, ["doc_id", "n_words", "n_removed", "n_spans", "text", "rest"])


def _links(ws: Workspace, hits: DataFrame, bands: int, block: int, num: int, den: int) -> DataFrame:
    """(a, b) contents of lines that share a band and pass verification."""
    kinds = ws.keep(hits.where("shingles is not null").groupBy("content").agg(F.min(F.struct("shingles", "bands")).alias("x")).select("content", "x.*"), "kinds")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))))
    banded = kinds.select("content", band.alias("band"))
    # Copies with few changes share all bands; bands of the same lines are looked at once.
    sizes = banded.groupBy("band").agg(F.count("*").alias("k"), F.sum(F.xxhash64("content").cast("decimal(38,0)")).alias("h")).where("k > 1")
    sizes = ws.keep(sizes.groupBy("k", "h").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("k") / block).cast("long").alias("parts")), "sizes")
    put = banded.join(sizes, "band").join(kinds.select("content", "shingles"), "content").withColumn("own", F.pmod(F.xxhash64("content"), F.col("parts")))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    put = put.select("content", "shingles", side.alias("side"), "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    links = ws.keep(put.groupBy("band", "lo", "hi").applyInArrow(_verify(num, den), "a long, b long").distinct(), "links", 1024)
    ws.drop(kinds, sizes)
    return links


def _drops(ws: Workspace, hits: DataFrame, comp: DataFrame) -> DataFrame:
    """cid, row, word, n of marked paragraphs; and with n = 0 and side (0 left, 1 right) their ends at which no marked one goes on, with what the kept occurrence has around."""
    occ = hits.where("content is not null").select("cid", "row", "word", "n", "content", F.struct("u", "doc_id", "cid", "row").alias("who"))
    occ = occ.join(comp.withColumnRenamed("id", "content"), "content", "left").withColumn("kind", F.coalesce("component", "content")).drop("content", "component")
    occ = ws.keep(occ, "occurrences")
    firsts = occ.groupBy("kind").agg(F.min("who").alias("who0"), F.max("who").alias("who1"), F.min(F.struct("who", "word", "n")).alias("keep")).where("who0 <> who1")
    # Written first: a join whose sides both are shuffles can split a passage that very many documents hold.
    firsts = ws.keep(firsts.select("kind", "keep"), "firsts")
    marked = occ.join(firsts, "kind").where(F.col("who") != F.col("keep.who")).select("cid", "row", "word", "n", "kind")
    place, end = W.partitionBy("cid", "row").orderBy("word", "n"), F.col("word") + F.col("n")
    ahead = F.max(end).over(place.rowsBetween(W.unboundedPreceding, -1))
    behind = F.lead("word").over(place)
    marked = marked.withColumns({"left": F.coalesce(ahead < F.col("word"), F.lit(True)), "right": F.coalesce(behind > end, F.lit(True))})
    marked = ws.keep(marked, "marked")
    side = lambda i, at: F.struct(F.lit(i).alias("side"), at.alias("at"))
    both = lambda word, n: F.explode(F.array(side(0, word), side(1, word + n)))
    ends = marked.where("left or right").select("cid", "row", "kind", "left", "right", both(F.col("word"), F.col("n")).alias("e"))
    ends = ends.where("if(e.side = 0, left, right)").select("cid", "row", "kind", "e.*")
    asked = firsts.join(ends.select("kind").distinct(), "kind", "left_semi").select("kind", "keep.who.cid", "keep.who.row", both(F.col("keep.word"), F.col("keep.n")).alias("e"))
    asked = asked.select("kind", "cid", "row", "e.*", F.expr(f"cast(e.at div {BLOCK} as int)").alias("block"))
    blocks = hits.where("content is null").select("cid", "row", F.col("word").alias("block"), F.col("n").alias("lo"), "around")
    before = F.expr(f"substring(around, (greatest(at - {REACH}, lo) - lo) * 4 + 1, (at - greatest(at - {REACH}, lo)) * 4)")
    after = F.expr(f"substring(around, (at - lo) * 4 + 1, {REACH * 4})")
    told = asked.join(blocks, ["cid", "row", "block"]).select("kind", "side", F.when(F.col("side") == 0, before).otherwise(after).alias("around"))
    told = ws.keep(told, "told")
    got = ends.join(told, ["kind", "side"]).select("cid", "row", F.col("at").alias("word"), F.lit(0).alias("n"), "side", "around")
    none = marked.select("cid", "row", "word", "n", F.lit(None).cast("int").alias("side"), F.lit(None).cast("binary").alias("around"))
    drops = ws.keep(got.unionByName(none), "drops")
    ws.drop(occ, firsts, marked, told)
    return drops


def repeated_passages(docs: DataFrame, num: int = 4, den: int = 5, bands: int = 4, block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, text and rest (docs' other columns in a struct), one row per row of docs.

    Lines link with a Jaccard of at least num/den of their 5-word shingles (hashes of 32 bits), anchored paragraphs if they are equal, both in lower
    case. Of a component that stands in two documents or more, the first (smallest doc_id, null last) keeps
    its occurrences; in the others they are marked, and ends at which no other goes on move outward over the words that the kept
    occurrence has there too, 25 at most. Marked runs of 51 words or more are removed, with the white space after them.
    So every run of over 50 words that the first document of its paragraphs holds word for word goes,
    whatever stands around it. Repeats inside a single document, and of 50 words or fewer, stay.

    Null texts stay null and empty ones empty; null ids sort last; rows that repeat an id are
    documents of their own; an empty table gives no rows. Texts are read whole, in chunks of about half a megabyte, a longer text
    alone. Equal paragraphs are one from the start, so only different ones are compared; a band of over `block`
    different ones is compared in pairs of blocks.
    """
    ws = Workspace(docs.sparkSession, "passages")
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    chunks = chunked(ws, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest")))
    count = buckets_for(chunks)
    said = chunks.select("cid", "items").mapInArrow(_announce(bands, count), _SAID)
    answers = ws.keep(said.groupBy("bucket").applyInArrow(_repeated, _ANSWER), "answers", AT_ONCE)
    hits = ws.keep(beside(chunks, answers, _colliding(bands), HITS), "hits", AT_ONCE)
    ws.drop(answers)
    comp = components(ws, _links(ws, hits, bands, block, num, den))
    drops = _drops(ws, hits, comp)
    ws.drop(hits)
    schema = f"doc_id long, n_words long, n_removed long, n_spans long, text string, rest {chunks.schema['items'].dataType.elementType['rest'].dataType.simpleString()}"
    # Written a few chunks at a time, so that all else can go.
    out = ws.keep(beside(chunks, drops, _cut, schema), "result", AT_ONCE)
    ws.drop(chunks, drops)
    return out
