"""Exact substring removal by prefix-free parsing.

A rolling hash of 16 bytes triggers phrase ends. Where a string of the wanted length starts, it is
a dictionary suffix (the rest of its phrase, with the trigger) followed by what the parse goes on
with. Suffixes can be equal only if their first trigger agrees in its last 40 bytes, so the entries
of dictionary and parse are brought together by that; an entry is a phrase with as much of the parse
after it as the strings that start in it can reach. Equal entries are settled at once, however often
they occur. Entries that share a trigger but differ are cut where a string would begin far before it or near it, and
dealt out anew by the 120 bytes that all strings of such a part have. Of the parts that meet, those with a string that may be
another's are written behind each other, spelt out, and the suffix array of that text, cut at the wanted length, is
built by doubling ranks; strings that share a rank there are the repeats, byte for byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace
from vertexloom.llm.chunks import AT_ONCE, beside, bounds, bucket_of, buckets_for, chunked, items

TRIGGER, KEY, PERIOD = 16, 40, np.uint64(32)
#: Strings of one part of an entry begin within so many bytes of each other.
PART = 81


class Entries:
    """Dictionary entries of a chunk.

    Entry e stands for the strings that start in lo[e]..hi[e]; key[e] is its trigger's, sig[e] its content's.
    A string without a trigger in reach is an entry by itself.
    """

    def __init__(self, texts, length: int):
        from vertexloom.llm.textblocks import Hasher, mix, raw

        self.buf, self.off = raw(texts)
        n = len(self.buf)
        self.lo = self.hi = self.trigger = np.zeros(0, np.int64)
        self.key = self.sig = np.zeros(0, np.uint64)
        starts = np.ones(n + 1, bool)
        for a, b in zip(self.off[:-1], self.off[1:], strict=True):  # no string starts in the last length - 1 bytes of a document
            starts[max(a, b - length + 1) : b] = False
        starts[n:] = False
        i = np.flatnonzero(starts[:n])
        if not len(i):
            return
        self.hash = h = Hasher(self.buf, strong=True)
        ends = np.arange(TRIGGER, n + 1)
        triggers = ends[h.spans(ends - TRIGGER, ends) % PERIOD == 0]
        before = np.zeros(n + length + KEY + 2, np.int64)
        before[triggers + 1] = 1
        np.cumsum(before, out=before)  # before[x]: triggers at less than x
        triggers = np.append(triggers, n + 10 * length)
        first = triggers[before[i + KEY]]
        seen = first <= i + length
        first[~seen] = -1 - i[~seen]
        doc = np.searchsorted(self.off, i, side="right")
        cut = np.flatnonzero((np.diff(first) != 0) | (np.diff(doc) != 0)) + 1
        a, b = np.append(0, cut), np.append(cut, len(i)) - 1
        self.lo, self.hi, first = i[a], i[b], first[a]
        alone = first < 0
        self.trigger = first  # its end; negative without one
        self.sig = h.strong_spans(self.lo, self.hi + length)
        self.key = np.where(alone, mix(self.sig), h.spans(np.where(alone, self.lo, first - KEY), np.where(alone, self.lo, first)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct (key, sig) in order: first entry, count; and the place of each entry among them."""
        order = np.lexsort((self.sig, self.key))
        k, s = self.key[order], self.sig[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return order[at], np.diff(np.append(at, len(order))), place


def _announce(length: int, count: int):
    def run(batches):
        import pyarrow as pa

        for cid, docs, _ in items(batches):
            e = Entries(docs.field("text"), length)
            first, times, _ = e.distinct()
            key, sig, many = e.key[first], e.sig[first], (times > 1).astype(np.uint8)
            got = bounds(bucket_of(key, count))
            blob = lambda x: pa.array([x[a:b].tobytes() for _, a, b in got], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([cid] * len(got), pa.int64()), blob(key), blob(sig), blob(many)], ["bucket", "cid", "key", "sig", "many"])

    return run


def _settle(t):
    """For each entry of a bucket: 1 if it is repeated as a whole, plus 2 if it stands for its kind in the suffix order."""
    import pyarrow as pa

    join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    key, sig, many = join("key", np.uint64), join("sig", np.uint64), join("many", np.uint8)
    order = np.lexsort((sig, key))
    k, s = key[order], sig[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    kind = np.cumsum(new) - 1
    times = np.bincount(kind, weights=1 + many[order])
    kinds_key = k[new]
    same = np.zeros(len(kinds_key), bool)
    if len(kinds_key) > 1:
        eq = kinds_key[1:] == kinds_key[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    flags = np.empty(len(order), np.uint8)
    flags[order] = (times[kind] > 1) + 2 * (same[kind] & new)
    size = [len(x) // 8 for x in t.column("key").to_pylist()]
    cuts = np.append(0, np.cumsum(size))
    return pa.table({"cid": t.column("cid"), "bucket": t.column("bucket"), "flags": pa.array([flags[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _flags(answers) -> np.ndarray:
    got = sorted((b, x) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True) if x is not None)
    return np.frombuffer(b"".join(x for _, x in got), np.uint8)


def _parts(e: Entries, entry: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(entry, first and last start, key) of the parts of entries that have a trigger; the key is of what all strings of a part hold."""
    from vertexloom.llm.textblocks import mix

    if not len(entry):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    found = []
    for z in range(-(-(length - KEY + 1) // PART)):
        t = e.trigger[entry] - KEY - z * PART  # the last place where a string of this part can begin
        lo, hi = np.maximum(e.lo[entry], t - PART + 1), np.minimum(e.hi[entry], t)
        live = lo <= hi
        t = t[live]
        key = mix(e.hash.spans(t, np.maximum(t, t - PART + 1 + length)) ^ np.uint64(z))
        found.append((np.flatnonzero(live), lo[live], hi[live], key))
    which, lo, hi, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key, kind="stable")
    return which[order], lo[order], hi[order], key[order]


def _contexts(length: int, count: int):
    def work(cid, docs, answers):
        import pyarrow as pa

        e = Entries(docs.field("text"), length)
        first, _, _ = e.distinct()
        send = np.flatnonzero(_flags(answers) & 2)
        entry = first[send]
        send, entry = send[e.trigger[entry] >= 0], entry[e.trigger[entry] >= 0]
        which, lo, hi, key = _parts(e, entry, length)
        rows = [[], [], [], [], [], []]
        for bucket, a, b in bounds(bucket_of(key, count)):
            text = [e.buf[x : y + length].tobytes() for x, y in zip(lo[a:b], hi[a:b], strict=True)]
            begins = (lo - e.lo[entry[which]])[a:b]
            for column, x in zip(rows, (bucket, cid, send[which[a:b]].astype(np.uint32).tobytes(), begins.astype(np.uint32).tobytes(), (hi - lo + 1)[a:b].astype(np.uint32).tobytes(), b"".join(text)), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["bucket", "cid", "place", "begin", "starts", "data"])

    return work


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Of each place of a byte string the rank of the next length bytes in the order of its suffixes cut there; equal bytes, equal rank.

    Ranks of eight bytes are doubled until two that overlap cover the length. Places with fewer bytes behind them have ranks of no meaning.
    """
    n, step = len(text), min(8, length)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(step):
        word = (word << np.uint64(8)) | padded[k : k + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while step < length:
        by = min(step, length - step)
        after = np.concatenate([rank[by:], np.zeros(min(by, n), np.int64)])[:n]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step += by
    return rank


def _may_repeat(data: np.ndarray, at: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which parts hold a string whose hash another string of the bucket has; hashed in pieces of about a megabyte."""
    from vertexloom.llm.textblocks import Hasher

    size = starts + length - 1
    part = np.repeat(np.arange(len(starts)), starts)
    hashes, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), 1 << 20, side="right")) + lo)
        here = at[lo:hi] - at[lo]
        begin = np.repeat(here - np.append(0, np.cumsum(starts[lo:hi])[:-1]), starts[lo:hi]) + np.arange(int(starts[lo:hi].sum()))
        hashes.append(Hasher(data[at[lo] : at[hi - 1] + size[hi - 1]]).spans(begin, begin + length))
        lo = hi
    _, kind, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    return np.bincount(part[times[kind] > 1], minlength=len(starts)) > 0


def _suffix_order(length: int):
    def run(t):
        """Of each part, a bit for each string that starts in it: whether another string of the bucket is equal."""
        import pyarrow as pa

        starts = np.frombuffer(b"".join(t.column("starts").to_pylist()), np.uint32).astype(np.int64)
        data = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8)
        size = starts + length - 1
        at = np.append(0, np.cumsum(size))[:-1]
        hits = np.zeros(int(starts.sum()), np.uint8)
        first = np.append(0, np.cumsum(starts))
        live = np.flatnonzero(_may_repeat(data, at, starts, length)) if len(starts) else []
        if len(live):
            text = np.concatenate([data[at[x] : at[x] + size[x]] for x in live])
            places = np.concatenate([np.arange(first[x], first[x + 1]) for x in live])
            moved = np.append(0, np.cumsum(size[live]))[:-1]
            begin = np.concatenate([np.arange(a, a + n) for a, n in zip(moved, starts[live], strict=True)])
            rank = prefix_ranks(text, length)[begin]
            hits[places] = (np.bincount(rank)[rank] > 1).astype(np.uint8)
        bits = [np.packbits(hits[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        cuts = np.append(0, np.cumsum([len(x) // 4 for x in t.column("starts").to_pylist()]))
        return pa.table({**{c: t.column(c) for c in ("cid", "place", "begin", "starts")}, "bits": pa.array([b"".join(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def _remove(length: int, with_text: bool):
    def work(cid, docs, answers):
        import hashlib

        import pyarrow as pa

        e = Entries(docs.field("text"), length)
        first, _, place = e.distinct()
        flags = _flags(answers)
        turn = np.zeros(len(e.buf) + 1, np.int64)
        whole = np.flatnonzero(flags[place] & 1) if len(place) else []
        np.add.at(turn, e.lo[whole], 1)
        np.add.at(turn, e.hi[whole] + length, -1)
        for told in zip(*(answers.column(c).to_pylist() for c in ("place", "begin", "starts", "bits")), strict=True):
            if told[0] is None:
                continue
            used, bits = 0, told[3]
            for x, begin, n in zip(*(np.frombuffer(y, np.uint32).astype(np.int64) for y in told[:3]), strict=True):
                at = e.lo[first[x]] + begin + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, -(-n // 8), used), count=n))
                used += -(-n // 8)
                np.add.at(turn, at, 1)
                np.add.at(turn, at + length, -1)
        gone = np.cumsum(turn[:-1]) > 0
        removed, spans, digests, texts = [], [], [], []
        for a, b in zip(e.off[:-1], e.off[1:], strict=True):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            left = e.buf[a:b][~g].tobytes()
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left)
        columns = {"doc_id": docs.field("doc_id"), "n_bytes": pa.array(np.diff(e.off), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept"] = pa.array(texts, pa.binary())
        return pa.table(columns)

    return work


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes), one row per row of docs.

    Removed is every byte that lies in a string of `length` bytes which also starts anywhere
    else, in the same text or another; strings don't cross texts and are judged on the input.
    Null is empty. Null and repeated ids keep their rows, which count as texts of their own; an
    empty table gives no rows; other columns are not read. Texts are read whole; memory is a chunk of about
    half a megabyte, or one longer text, and a bucket. Entries that a chunk holds often are sent once. Whole entries are
    equal by two hashes of 64 and 31 bits together, one modulo a prime; all other strings are compared byte for byte.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    chunks = chunked(ws, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    count = buckets_for(chunks)
    said = chunks.mapInArrow(_announce(length, count), "bucket long, cid long, key binary, sig binary, many binary")
    settled = ws.keep(said.groupBy("bucket").applyInArrow(_settle, "cid long, bucket long, flags binary"), "settled", AT_ONCE)
    sent = beside(chunks, settled, _contexts(length, count), "bucket long, cid long, place binary, begin binary, starts binary, data binary")
    ordered = ws.keep(sent.groupBy("bucket").applyInArrow(_suffix_order(length), "cid long, place binary, begin binary, starts binary, bits binary"), "ordered", AT_ONCE)
    answers = settled.unionByName(ordered, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    # Written a few chunks at a time, so that all else can go.
    out = ws.keep(beside(chunks, answers, _remove(length, with_text), schema), "result", AT_ONCE)
    ws.drop(chunks, settled, ordered)
    return out
