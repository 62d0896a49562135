"""Packing token sequences: cut, encode, and fill bins by best fit and swap-based local search."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, size: int):
    def run(batches):
        import zlib

        import pyarrow as pa

        from vertexloom.llm.pretokens import encoder

        e, tail = encoder(path), end_id.to_bytes(4, "little")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = e.ids(text or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into lengths, each of at most size in sum: best fit in decreasing order."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by room left
    levels = 0  # bit r set: a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = levels >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                levels &= ~(1 << room)
        else:
            b, room = len(bins), size
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            by_room[room].append(b)
            levels |= 1 << room
    return bins


class _Swaps:
    """Underfull bins, looked up by what they could give back: for each length of one item, or sum of two, the most room of a bin that holds such.

    Key 0 of the single items stands for giving nothing back. Entries of bins that have changed are recognised by
    their version and dropped when they come up.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.keys: list[tuple[list[int], list[int]]] = [([], [])] * len(bins)
        self.heaps = [[[] for _ in range(size + 1)] for _ in range(2)]
        self.reach = [np.zeros(size + 1, np.int64) for _ in range(2)]  # key plus the most room

    def sums(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """An item of each length in a bin, and two items of each sum."""
        one: dict[int, tuple[int, ...]] = {}
        two: dict[int, tuple[int, ...]] = {}
        again = {}
        for i in self.bins[b]:
            n = self.lengths[i]
            if n in one:
                again.setdefault(n, (one[n][0], i))
            else:
                one[n] = (i,)
        two.update({2 * n: x for n, x in again.items()})
        kinds = sorted(one)
        for x, n in enumerate(kinds):
            for m in kinds[x + 1 :]:
                two.setdefault(n + m, (one[n][0], one[m][0]))
        return one, two

    def _refresh(self, kind: int, key: int) -> None:
        heap = self.heaps[kind][key]
        while heap and heap[0][2] != self.version[heap[0][1]]:
            heapq.heappop(heap)
        self.reach[kind][key] = key - heap[0][0] if heap else 0

    def remove(self, b: int) -> None:
        self.version[b] += 1
        old, self.keys[b] = self.keys[b], ([], [])
        for kind in (0, 1):
            for key in old[kind]:
                self._refresh(kind, key)

    def put(self, b: int) -> None:
        self.remove(b)
        room = self.size - self.fill[b]
        if room and self.bins[b]:
            one, two = self.sums(b)
            self.keys[b] = [0, *one], list(two)
            for kind in (0, 1):
                for key in self.keys[b][kind]:
                    heapq.heappush(self.heaps[kind][key], (-room, b, self.version[b]))
                    self._refresh(kind, key)

    def step(self, source: int) -> bool:
        """The exchange that takes most out of source: one or two of its items, for nothing, one or two of another bin."""
        one, two = self.sums(source)
        best = (0, None, None, None)
        tops = [np.maximum.accumulate(x) for x in self.reach]
        for give, kind in ((one, 0), (two, 0), (one, 1)):
            if give:
                n = np.fromiter(give, np.int64, len(give))
                key = np.searchsorted(tops[kind], n)
                gain = np.where(key < n, n - key, 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (int(gain[at]), give[int(n[at])], kind, int(key[at]))
        gain, items, kind, key = best
        if not gain:
            return False
        target = self.heaps[kind][key][0][1]
        back = () if key == 0 else self.sums(target)[kind][key]
        self.bins[source] = [i for i in self.bins[source] if i not in items] + list(back)
        self.bins[target] = [i for i in self.bins[target] if i not in back] + list(items)
        self.fill[source] -= gain
        self.fill[target] += gain
        self.put(target)
        return True


def swap_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search by exchanges between underfull bins until no exchange raises the sum of squared fills, or no bin less can do.

    In a pass bins give in order of their fill, to bins at least as full, one item or two for nothing, one or two smaller
    ones. So each exchange raises the sum of squares, and passes end when one brings none. Bins that become empty go.
    """
    total = sum(lengths)
    while len(bins) > -(-total // size):
        full = [b for b in bins if sum(lengths[i] for i in b) == size]
        swaps = _Swaps([b for b in bins if sum(lengths[i] for i in b) < size], lengths, size)
        for b in range(len(swaps.bins)):
            swaps.put(b)
        waiting = [(f, b) for b, f in enumerate(swaps.fill)]
        heapq.heapify(waiting)
        stepped = False
        while waiting:
            fill, source = heapq.heappop(waiting)
            if fill != swaps.fill[source]:  # it has been given something since
                heapq.heappush(waiting, (swaps.fill[source], source))
                continue
            swaps.remove(source)
            while swaps.bins[source] and swaps.step(source):
                stepped = True
        bins = full + [b for b in swaps.bins if b]
        if not stepped:
            break
    return bins


def fill(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into lengths, each of at most size in sum: best fit, then swap-based local search."""
    return swap_search(best_fit(lengths, size), lengths, size)


def _fill_group(size: int):
    def run(t):
        import pyarrow as pa

        n = t.column("length").to_pylist()
        bins = fill(n, size)
        at, where, seq = [0] * len(n), [0] * len(n), t.column("grp")[0].as_py() if len(n) else 0
        for k, b in enumerate(bins):
            used = 0
            for i in b:
                where[i], at[i] = (seq << 32) + k, used
                used += n[i]
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(where, pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, group_rows: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids then end_id; only a document of over size ids is cut, every size ids.
    Null text is the end id alone. Pieces are dealt at random into groups of about group_rows,
    each packed by one task in memory that group_rows bounds, by best fit and then by exchanges until none helps or the
    volume allows no bin less; full-size pieces need no packing
    and get a sequence each where they stand. With that many pieces a group, the sequences lost to
    group borders are at most one in a few thousand. Null and repeated ids keep their rows; an
    empty table gives no rows; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "pack")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    p = ws.keep(d.mapInArrow(_pieces(tokenizer_path, end_id, size), PIECE_SCHEMA), "pieces")
    n = p.where(F.col("length") < size).count()
    groups = max(1, math.ceil(n / group_rows))
    part = p.withColumn("grp", F.when(F.col("length") < size, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)) + 1))
    schema = PIECE_SCHEMA + ", sequence_id long, offset long"
    packed = part.where("grp is not null").groupBy("grp").applyInArrow(_fill_group(size), schema)
    whole = p.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
