"""Edit distances, witnesses and their verification over a table of curve pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import curves as C
from vertexloom.session import ship

RESULT = (
    "status string, cost int, witness_status string, edited_curve array<array<double>>, "
    "edits array<struct<op:string,index:int,gap:int,ord:int,point:array<double>>>, coupling array<struct<r:int,e:int>>, detail string, counters map<string,bigint>"
)


def check_options(delta: float, mode: str, policy: str = "certified", most: int | None = None) -> None:
    if isinstance(delta, bool) or not np.isfinite(delta) or delta <= 0:
        raise ValueError("delta must be a positive finite number")
    if mode not in ("delete", "insert", "both"):
        raise ValueError(f"unknown operations {mode!r}")
    if policy not in ("certified", "fast"):
        raise ValueError(f"unknown numeric policy {policy!r}")
    if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 0):
        raise ValueError("max_deletions must be a non-negative integer")


_INPUT = ("_ref_in", "_obs_in", "_cap_in")
#: Results that a task keeps for pairs of the same curves.
MOST_KEPT = 4096


def _rows(solve):
    keys = ("status", "cost", "witness_status", "edited_curve", "edits", "coupling", "detail", "counters")

    def run(batches):
        import pyarrow as pa

        known: dict[tuple, dict] = {}
        for b in batches:
            got = []
            for ref, obs, cap in zip(*[b.column(c).to_pylist() for c in _INPUT], strict=True):
                r, o = np.array(ref, np.float64), np.array(obs, np.float64)
                if r.ndim != 2 or o.ndim != 2 or r.shape[1] != o.shape[1] or not (np.isfinite(r).all() and np.isfinite(o).all()):
                    raise ValueError("curves must be non-empty, finite and of one dimension")
                pair = (r.tobytes(), o.tobytes(), r.shape[1], cap)
                if pair not in known:
                    if len(known) >= MOST_KEPT:
                        known.pop(next(iter(known)))
                    known[pair] = solve(r, o, cap)
                got.append(known[pair])
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n not in _INPUT]
            names = [n for n in b.schema.names if n not in _INPUT]
            edit = pa.list_(pa.struct([("op", pa.string()), ("index", pa.int32()), ("gap", pa.int32()), ("ord", pa.int32()), ("point", pa.list_(pa.float64()))]))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.float64())), edit, pa.list_(pa.struct([("r", pa.int32()), ("e", pa.int32())])), pa.string(), pa.map_(pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([list(g[k].items()) if k == "counters" else g[k] for g in got], t) for k, t in zip(keys, kinds, strict=True)], names + list(keys))

    return run


def _apply(pairs: DataFrame, ref: str, obs: str, solve, cap=None) -> DataFrame:
    ship(pairs.sparkSession)
    from pyspark.sql import types as T

    schema = T.StructType(pairs.schema.fields + T._parse_datatype_string(RESULT).fields)
    # Work is the product of the lengths: deal pairs out evenly before the kernel.
    limit = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    return pairs.withColumns(dict(zip(_INPUT, (F.col(ref), F.col(obs), limit.cast("int")), strict=True))).mapInArrow(_rows(solve), schema)


def discrete_edits(pairs: DataFrame, ref: str, obs: str, delta: float, mode: str = "both", witness: bool = False, policy: str = "certified") -> DataFrame:
    """pairs with status, cost and, if asked, a certified edit script. Exact at the boundary, in any dimension (insertion: up to 8)."""
    check_options(delta, mode, policy)

    def solve(r, o, cap):
        from vertexloom.kernels.discrete import solve as kernel

        if mode != "delete" and r.shape[1] > 8:
            raise ValueError("insertion is defined for up to 8 dimensions")
        return kernel(r, o, delta, mode, witness, policy)

    return _apply(pairs, ref, obs, solve)


def continuous_edits(pairs: DataFrame, ref: str, obs: str, delta: float, mode: str = "delete", witness: bool = False, max_deletions: int | str | None = None) -> DataFrame:
    """pairs with the fewest deletions for the continuous measure; max_deletions may name a column."""
    check_options(delta, mode, most=None if isinstance(max_deletions, str) else max_deletions)
    if mode != "delete":
        raise NotImplementedError("the continuous measure supports deletion only")

    def solve(r, o, cap):
        from vertexloom.kernels.continuous import fewest_deletions

        return fewest_deletions(r, o, delta, cap, witness)

    return _apply(pairs, ref, obs, solve, max_deletions)


def _coupled(pairs: DataFrame, ref: str, curve: str, coupling: str, delta: float, open_: str, name: str) -> DataFrame:
    """pairs with name: whether every pair of the coupling is exactly within delta, for rows where open_ holds."""
    kind = "array<array<double>>"

    @F.pandas_udf("boolean")
    def decide(x: pd.Series, y: pd.Series, c: pd.Series) -> pd.Series:
        from vertexloom.kernels.exact import within

        near = lambda p, q, rows: all(within(p[r["r"]], q[r["e"]], delta) for r in rows)
        return pd.Series([None if p is None else near(p, q, rows) for p, q, rows in zip(x, y, c, strict=True)], dtype="object")

    # Only rows left open carry their curves to Python.
    only = lambda c, t: F.when(F.col(open_), F.col(c)).cast(t)
    return pairs.withColumn(name, decide(only(ref, kind), only(curve, kind), only(coupling, "array<struct<r:int,e:int>>")))


def verify(results: DataFrame, ref: str, obs: str, delta: float, mode: str) -> DataFrame:
    """results of discrete_edits with ok: the script replays to the edited curve, counts to the cost, and couples within delta.

    Retained vertices keep their order, as the replay only leaves out and puts in. Columns that share no code with the solver;
    where a distance is too near to delta for floating point, the coupling is decided in rationals. NULL without a witness.
    """
    ship(results.sparkSession)
    allowed = {"delete": ["delete"], "insert": ["insert"], "both": ["delete", "insert"]}[mode]
    replayed = C.replay(F.col(obs), F.col("edits")) == F.col("edited_curve")
    counted = F.size("edits") == F.col("cost")
    kinds = F.forall("edits", lambda e: e["op"].isin(*allowed))
    script = C.edits_valid(F.col(obs), F.col("edits")) & replayed & counted & kinds
    tier = C.coupling_valid(F.col(ref), F.col("edited_curve"), F.col("coupling"), delta)
    certified = F.col("witness_status") == "certified"
    d = results.withColumns({"_script": F.when(certified, script), "_tier": F.when(certified, tier)}).withColumn("_open", certified & F.col("_tier").isNull())
    d = _coupled(d, ref, "edited_curve", "coupling", delta, "_open", "_exact")
    # The steps of a coupling whose distances are open are judged with distances left out.
    steps = C.coupling_valid(F.col(ref), F.col("edited_curve"), F.col("coupling"), 1e150)
    ok = F.col("_script") & F.when(F.col("_open"), F.col("_exact") & steps).otherwise(F.col("_tier"))
    return d.withColumn("ok", ok).drop("_script", "_tier", "_open", "_exact")
