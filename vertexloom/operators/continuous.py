"""The continuous distance and its decision over tables of pairs, and independent checks of deletion scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import curves as C
from vertexloom.session import ship


def _curve(x):
    import numpy as np

    return np.array([list(p) for p in x], dtype=np.float64)


def distance(pairs: DataFrame, a: str, b: str, name: str = "distance", tol: float = 1e-9) -> DataFrame:
    """pairs with the continuous distance to within tol; NULL where a curve is null or empty."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def solve(x: pd.Series, y: pd.Series) -> pd.Series:
        from vertexloom.kernels import floatfrechet

        rows = zip(x, y, strict=True)
        return pd.Series([floatfrechet.distance(_curve(p), _curve(q), tol) if p is not None and q is not None and len(p) and len(q) else None for p, q in rows], dtype="float64")

    return pairs.withColumn(name, solve(F.col(a), F.col(b)))


def _decided(pairs: DataFrame, a: str, b: str, name: str, decide) -> DataFrame:
    ship(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def solve(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = zip(x, y, strict=True)
        return pd.Series([decide(_curve(p), _curve(q)) if p is not None and q is not None and len(p) and len(q) else None for p, q in rows], dtype="object")

    return pairs.withColumn(name, solve(F.col(a), F.col(b)))


def within(pairs: DataFrame, a: str, b: str, delta: float, name: str = "within") -> DataFrame:
    """pairs with the exact decision whether the continuous distance is at most delta; NULL where a curve is null or empty.

    It is the solver's own: no deletion at all brings b within delta of a.
    """

    def decide(p, q):
        from vertexloom.kernels.continuous import within_budget

        return within_budget(p, q, delta, 0) is not None

    return _decided(pairs, a, b, name, decide)


def checked(pairs: DataFrame, a: str, b: str, delta: float, name: str = "checked") -> DataFrame:
    """The same decision by the independent checker."""

    def decide(p, q):
        from vertexloom.kernels import checker

        return checker.continuous_within(p, q, delta)

    return _decided(pairs, a, b, name, decide)


def verify(results: DataFrame, ref: str, obs: str, delta: float) -> DataFrame:
    """results of continuous_edits with ok: deletions only, they replay to the edited curve and count to the cost, and that curve is within delta. NULL without a witness."""
    d = checked(results, ref, "edited_curve", delta, "_within")
    kinds = F.forall("edits", lambda e: e["op"] == "delete")
    script: Column = C.edits_valid(F.col(obs), F.col("edits")) & kinds & (C.replay(F.col(obs), F.col("edits")) == F.col("edited_curve")) & (F.size("edits") == F.col("cost"))
    return d.withColumn("ok", F.when(F.col("witness_status") == "certified", script & F.col("_within"))).drop("_within")
