"""Measures and edit costs over tables of curve pairs, computed for a batch of pairs at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.operators.edits import check_options
from vertexloom.session import ship

MEASURES = ("frechet", "dtw", "dtw_normalized", "edr", "lcss", "lcss_distance", "erp")
_WHOLE = ("edr", "lcss")


def curves(column) -> list[np.ndarray | None]:
    """Curves of an Arrow column of array<array<double>>; None for a null one. A curve without vertices has no dimension."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    points = column.flatten()
    values = points.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.diff(np.asarray(points.offsets))
    counts = np.asarray(column.value_lengths().fill_null(0))
    ends = np.cumsum(counts)
    cut = np.append(0, np.cumsum(sizes))
    none = np.asarray(column.is_null())
    out: list[np.ndarray | None] = []
    for n, end, absent in zip(counts.tolist(), ends.tolist(), none.tolist(), strict=True):
        if absent:
            out.append(None)
            continue
        lo, hi = int(cut[end - n]), int(cut[end])
        dim = (hi - lo) // n if n else 0
        if n and (dim == 0 or (sizes[end - n : end] != dim).any()):
            raise ValueError("the vertices of a curve must have one dimension")
        out.append(values[lo:hi].reshape(n, dim))
    return out


def check(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape[1] != b.shape[1]:
        raise ValueError("both curves of a pair must have one dimension")
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("coordinates must be finite")


def _solver(kernel, empty, dtype):
    """An Arrow function that adds kernel's value of each pair; empty(a, b) gives it where a curve has no vertex."""

    def run(batches):
        import pyarrow as pa

        from vertexloom.kernels import batch as B

        for b in batches:
            left, right = curves(b.column("_a")), curves(b.column("_b"))
            out: list = [None] * b.num_rows
            full = []
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                if x is None or y is None:
                    continue
                if len(x) and len(y):
                    check(x, y)
                    full.append(k)
                else:
                    out[k] = empty(x, y)
            for some in B.groups([left[k] for k in full], [right[k] for k in full]) if full else ():
                at = [full[k] for k in some]
                got = kernel([left[k] for k in at], [right[k] for k in at])
                for k, v in zip(at, got, strict=True):
                    out[k] = v
            keep = [n for n in b.schema.names if n not in ("_a", "_b")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(out, pa.int64() if dtype == "long" else pa.float64())], [*keep, "_value"])

    return run


def _apply(pairs: DataFrame, a: str, b: str, name: str, run, dtype: str) -> DataFrame:
    ship(pairs.sparkSession)
    schema = T.StructType([*pairs.schema.fields, T.StructField("_value", T.LongType() if dtype == "long" else T.DoubleType())])
    kind = "array<array<double>>"
    return pairs.withColumns({"_a": F.col(a).cast(kind), "_b": F.col(b).cast(kind)}).mapInArrow(run, schema).withColumnRenamed("_value", name)


def measure(pairs: DataFrame, a: str, b: str, kind: str, name: str | None = None, eps: float | None = None, gap: list[float] | None = None) -> DataFrame:
    """pairs with the measure `kind` of curves a and b (array<array<double>>), one of MEASURES.

    Null where a curve is null. Of a curve without vertices the Frechet distance is infinite, or 0 to another such; the other
    measures aren't defined there and are null.
    """
    if kind not in MEASURES:
        raise ValueError(f"unknown measure {kind!r}")
    needs = kind in ("edr", "lcss", "lcss_distance")
    if needs and (eps is None or isinstance(eps, bool) or not np.isfinite(eps) or eps < 0):
        raise ValueError("eps must be a finite non-negative number")

    def kernel(x, y):
        from vertexloom.kernels import batch as B

        p = B.Pairs(x, y)
        made = getattr(B, kind)
        return (made(p, eps) if needs else made(p, gap) if kind == "erp" else made(p)).tolist()

    dtype = "long" if kind in _WHOLE else "double"
    empty = (lambda x, y: 0.0 if len(x) == len(y) else float("inf")) if kind == "frechet" else (lambda x, y: None)
    return _apply(pairs, a, b, name or kind, _solver(kernel, empty, dtype), dtype)


def edit_cost(pairs: DataFrame, ref: str, obs: str, delta: float, mode: str, name: str = "cost", ambiguous: int | None = None, rounded: bool = False) -> DataFrame:
    """pairs with the fewest edits of obs that bring it within delta of ref in the discrete measure; null if none do, or a curve is null.

    Closeness is decided exactly at the limit, in any dimension (insertion: up to 8). A reference without vertices is reached
    by deleting all of obs; an observation without vertices by insertions alone. Balls that only the exact kernel
    could tell from the limit, and only at great cost, give `ambiguous`, as discrete_edits gives numerically_ambiguous.
    rounded (deletion only) takes distances as double precision gives them, as SQL does: 0.01 and 100.01 are then 100 apart.
    """
    check_options(delta, mode)
    if rounded and mode != "delete":
        raise ValueError("rounded distances are for deletion only")

    def kernel(x, y):
        from vertexloom.kernels import batch as B
        from vertexloom.kernels.ball import reach
        from vertexloom.kernels.exact import Ambiguous

        if mode != "delete" and x[0].shape[1] > 8:
            raise ValueError("insertion is defined for up to 8 dimensions")
        known: dict[bytes, list[int] | None] = {}
        for c in x if mode != "delete" else ():
            if c.tobytes() not in known:
                try:
                    known[c.tobytes()] = reach(c, delta)
                except Ambiguous:
                    known[c.tobytes()] = None
        rows = [known[c.tobytes()] for c in x] if mode != "delete" else None
        open_ = [r is None for r in rows] if rows else [False] * len(x)
        got = B.edit_cost(B.Pairs(x, y), delta, mode, [r or list(range(len(c))) for r, c in zip(rows, x, strict=True)] if rows else None, rounded)
        return [ambiguous if o else None if v >= B.NEVER else int(v) for v, o in zip(got, open_, strict=True)]

    def empty(x, y):
        if not len(x):
            return 0 if not len(y) else len(y) if mode != "insert" else None
        if mode == "delete":
            return None
        from vertexloom.kernels.ball import reach

        i, n, first = len(x) - 1, 0, reach(x, delta)
        while i >= 0:
            i, n = first[i] - 1, n + 1
        return n

    return _apply(pairs, ref, obs, name, _solver(kernel, empty, "long"), "long")
