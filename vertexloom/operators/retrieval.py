"""Tie-aware retrieval metrics over (query_id, method, template_id, score) rows.

Infinite scores are infeasible and rank after all finite ones; null scores are ambiguous and
never count as found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def tie_groups(scored: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, method, score, size, rel, before: groups of equal scores in rank order."""
    hit = scored.join(relevant.select("query_id", "template_id", F.lit(1).alias("is_rel")), ["query_id", "template_id"], "left")
    groups = hit.groupBy("query_id", "method", "score").agg(F.count("*").alias("size"), F.sum(F.coalesce("is_rel", F.lit(0))).alias("rel"), F.min("template_id").alias("first_id"))
    return ranked(groups)


def ranked(groups: DataFrame) -> DataFrame:
    """groups of equal scores with before: how many templates rank before each."""
    w = W.partitionBy("query_id", "method").orderBy(F.col("score").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))


def _miss(size: Column, rel: Column, take: Column) -> Column:
    """Chance that `take` of `size` drawn without return hold none of `rel`."""
    one = F.lit(1.0)
    return F.when(take <= 0, one).when(take > size - rel, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("long"), take - 1), one, lambda a, i: a * (size - rel - i) / (size - i))
    )


def outcomes(scored: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row per query and method: counts, abstained, top-1, and strict, expected and optimistic hit@k and reciprocal rank."""
    return outcomes_of(tie_groups(scored, relevant), ks)


def outcomes_of(groups: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """outcomes() from the groups of equal scores."""
    first = groups.where("rel > 0").groupBy("query_id", "method").agg(F.min_by(F.struct("score", "size", "rel", "before"), F.struct(F.col("score").isNull(), "score")).alias("g"))
    finite = F.col("score").isNotNull() & (F.col("score") < float("inf"))
    best = F.struct(F.col("score").isNull(), "score")
    base = groups.groupBy("query_id", "method").agg(
        F.sum(F.when(finite, F.col("size")).otherwise(0)).alias("n_scored"),
        F.sum(F.when(F.col("score") == float("inf"), F.col("size")).otherwise(0)).alias("n_infeasible"),
        F.sum(F.when(F.col("score").isNull(), F.col("size")).otherwise(0)).alias("n_ambiguous"),
        F.min_by(F.struct("first_id", "size", "score"), best).alias("top"),
    )
    return judged(base.join(first, ["query_id", "method"], "left"), ks)


def _reciprocals(b: Column, n: Column) -> Column:
    """1/(b+1) + ... + 1/(b+n), by the expansion of harmonic numbers from 1/33 on."""

    def upto(x: Column) -> Column:
        x, y = x.cast("double"), 1 / (x.cast("double") * x)
        return F.log(x) + 1 / (2 * x) - y * (F.lit(1.0) / 12 - y * (F.lit(1.0) / 120 - y / 252))

    def summed(end: Column) -> Column:
        return F.when(end <= b, 0.0).otherwise(F.aggregate(F.sequence(b + 1, F.greatest(end, b + 1)), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i))

    last, from_ = b + n, F.greatest(b, F.lit(32))
    return summed(F.least(last, F.lit(32))) + F.when(last > from_, upto(last) - upto(from_)).otherwise(0.0)


def judged(found: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """outcomes() from counts of each query and method: the group of the best relevant score g (score, size, rel, before), and the best group top (first_id, size, score)."""
    out = found.withColumn("abstained", F.col("n_scored") == 0)
    found = F.col("g").isNotNull() & F.col("g.score").isNotNull()
    b, n, r = F.col("g.before"), F.col("g.size"), F.col("g.rel")
    cols = {"top1": F.when(~F.col("abstained"), F.col("top.first_id")), "top1_score": F.when(~F.col("abstained"), F.col("top.score")), "top1_tied": ~F.col("abstained") & (F.col("top.size") > 1)}
    for k in ks:
        room = k - b
        cols[f"hit{k}_strict"] = F.when(found & (b + n - r + 1 <= k), 1.0).otherwise(0.0)
        cols[f"hit{k}_expected"] = F.when(found & (room > 0), 1 - _miss(n, r, F.least(room, n))).otherwise(0.0)
        cols[f"hit{k}_optimistic"] = F.when(found & (b + 1 <= k), 1.0).otherwise(0.0)
    ways = F.sequence(F.lit(1).cast("long"), n - r + 1)
    # miss: chance that the first i - 1 drawn of the group hold no relevant one.
    start = F.struct(F.lit(1.0).alias("miss"), F.lit(0.0).alias("sum"))
    drawn = lambda s, i: F.struct((s["miss"] * (n - r - i + 1) / (n - i + 1)).alias("miss"), (s["sum"] + s["miss"] * r / (n - i + 1) / (b + i)).alias("sum"))
    # One relevant template is equally likely at each place of its group, which may be large.
    mean = F.when(r == 1, _reciprocals(b, n) / n).otherwise(F.aggregate(ways, start, drawn, lambda s: s["sum"]))
    cols |= {"rr_strict": F.when(found, 1 / (b + n - r + 1)).otherwise(0.0), "rr_expected": F.when(found, mean).otherwise(0.0), "rr_optimistic": F.when(found, 1 / (b + 1)).otherwise(0.0)}
    return out.withColumns(cols).drop("g", "top")


def aggregate(outcome: DataFrame) -> DataFrame:
    """Per method: means over all queries and over those answered, and coverage."""
    return outcome.groupBy("method").agg(*_means(outcome))


def _means(outcome: DataFrame) -> list[Column]:
    metrics = [c for c in outcome.columns if c.startswith(("hit", "rr_"))]
    answered = lambda c: F.when(~F.col("abstained"), F.col(c))
    means = [F.avg(c).alias(c) for c in metrics] + [F.avg(answered(c)).alias(f"{c}_answered") for c in metrics]
    return [F.count("*").alias("n_queries"), F.avg((~F.col("abstained")).cast("double")).alias("coverage"), *means]


def thresholds(outcome: DataFrame, q: float = 0.95) -> DataFrame:
    """Acceptance threshold of each method: exact interpolated quantile of its best scores."""
    return outcome.where("not abstained").groupBy("method").agg(F.percentile("top1_score", F.lit(q)).alias("threshold"))


def summary(outcome: DataFrame, q: float = 0.95) -> DataFrame:
    """aggregate() with the threshold of each method that answered a query, in one pass over the outcomes."""
    limit = F.percentile(F.when(~F.col("abstained"), F.col("top1_score")), F.lit(q))
    return outcome.groupBy("method").agg(*_means(outcome), limit.alias("threshold")).where("threshold is not null")
