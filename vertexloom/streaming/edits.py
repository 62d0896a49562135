"""Fewest edits so far, kept up to date as vertices arrive.

The recurrence consumes the observation one vertex at a time and carries one number per reference
vertex, so the state of a key is that column, the reference, and the vertices that still wait for the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.session import ship

_STATE = "best array<long>, seen long, waiting array<struct<ts:long,seq:long,p:array<double>>>, ref array<array<double>>"
_OUT = "key string, seen long, last_ts long, cost long"
_FAR = 1 << 40


def advance(best: list[int], near: list[bool]) -> list[int]:
    """The column after one more observed vertex, deletions only."""
    out, k = [best[0] + 1], _FAR
    for i, close in enumerate(near):
        k = min(k, best[i], best[i + 1]) if close else _FAR
        out.append(min(k, best[i + 1] + 1, _FAR))
    return out


def running_deletions(vertices: DataFrame, references: DataFrame, delta: float, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, seen, last_ts in ms, cost) after each trigger in which vertices of key were released.

    vertices: stream of key string, ts timestamp, seq long, p array<double>; references: static key, ref. Vertices are
    held until the watermark passes them, then taken in order of (ts, seq); later ones are dropped, as is usual for
    watermarks. cost is null while no subsequence fits.
    """
    ship(vertices.sparkSession)
    joined = vertices.withWatermark("ts", late).join(references.select("key", "ref"), "key")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        from vertexloom.kernels.exact import closeness

        best, seen, waiting, ref = state.get if state.exists else ([], 0, [], [])
        best, waiting, ref = list(best), [(w[0], w[1], list(w[2])) for w in waiting], [list(p) for p in ref]
        for f in frames:
            for r in f.itertuples(index=False):
                ref = ref or [[float(x) for x in p] for p in r.ref]
                waiting.append((r.ts.value // 1_000_000, int(r.seq), [float(x) for x in r.p]))
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda w: w[:2])
        ready = [w for w in waiting if w[0] <= mark]
        rest = waiting[len(ready) :]
        best = best or [0] + [_FAR] * len(ref)
        known = np.array(ref, np.float64)
        for _, _, p in ready:
            best = advance(best, closeness(known, np.array(p, np.float64), delta).tolist())
        seen += len(ready)
        state.update((best, seen, rest, ref))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0], mark + 1))
        if ready:
            yield pd.DataFrame({"key": [key[0]], "seen": [seen], "last_ts": [ready[-1][0]], "cost": pd.array([best[-1] if best[-1] < _FAR else None], dtype="Int64")})

    return joined.select("key", "ts", "seq", "p", "ref").groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", "EventTimeTimeout")


def batch_deletions(vertices: DataFrame, references: DataFrame, delta: float) -> DataFrame:
    """The same cost over a finished table, by expressions: what the stream must come to."""
    from vertexloom.functions import curves as C

    row = F.struct("ts", "seq", "p")
    obs = vertices.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"]).alias("obs"))
    return obs.join(references, "key").select("key", F.size("obs").cast("long").alias("seen"), C.edit_cost(F.col("ref"), F.col("obs"), delta, "delete").cast("long").alias("cost"))
