"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vertexloom.llm.base import Workspace
from vertexloom.llm.quality import words

#: The golden ratio's part of 2^62, in two halves of 31 bits.
GOLDEN = divmod(2850178192232086377, 1 << 31)
#: Fixed cycle of weights, by the place of a source in code point order.
WEIGHTS = (3, 1, 2)


def _targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target. Targets share the total by weight; what exceeds most times a
    source's size is shared again among the rest. Sources in order of capacity for their weight
    fill up first, so one ordered pass over the (few) sources finds the level of the rest.
    """
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(n)) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_ = W.partitionBy()
    before = up.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"total": share * F.sum("source_size").over(all_), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "ws": F.sum("w").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))})
    s = s.withColumn("level", (F.col("total") - F.col("caps")) / F.col("ws"))
    full = F.col("cap") <= F.col("w") * F.col("level")
    s = s.withColumn("rest", F.max(F.when(~full, F.col("level"))).over(all_))
    target = F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("rest"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: str) -> DataFrame:
    """before: sum of value over earlier rows within keys, order by (bucket, order...).

    Two levels, so that a key with a third of all rows is summed by many tasks: sums by bucket
    first, then inside each bucket.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    head = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_s").over(head), F.lit(0)).alias("_head"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.alias("o").join(sums.alias("s"), [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, bucket)])
    return out.select("o.*", (F.col("_head") + F.col("_in")).alias("before")).drop("_in")


def golden_points(slot: Column) -> Column:
    """frac((slot + 1) * phi) for slots below 2^61: multiplied in whole numbers modulo 2^62, so points stay evenly spread at any length."""
    high, low = GOLDEN
    mask = (1 << 31) - 1
    x1, x0 = F.shiftright(slot + 1, 31), (slot + 1).bitwiseAND(F.lit(mask))
    middle = (x0 * F.lit(high) + x1 * F.lit(low)).bitwiseAND(F.lit(mask))
    return (x0 * F.lit(low) + F.shiftleft(middle, 31)).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, source, k (block within an epoch), take (words of the block), epoch.

    Slot s is the golden-ratio point frac((s + 1) * phi), mapped through the cumulative targets to
    a source; the r-th slot of a source is block r of its shuffled stream, repeated in epochs. The
    points are spread so evenly that most sources have their slots after a few more than the total
    needs. A source needs a slot per block and one for the short last block of every epoch; those the
    points left out come after them, counted in whole numbers. Slots past a source's target are
    dropped and the last one is trimmed to it.
    """
    spark = targets.sparkSession
    t = targets.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).where("goal > 0")
    order = W.orderBy(F.col("source").asc_nulls_last())
    t = t.withColumns({"hi": F.sum("goal").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "all": F.sum("goal").over(W.partitionBy())})
    whole = lambda x, by: F.expr(f"({x}) div {by}")
    t = t.withColumns({"lo": F.col("hi") - F.col("goal"), "needed": whole("goal", "source_size") * whole(f"source_size + {block - 1}", block) + whole(f"goal % source_size + {block - 1}", block)})
    total, n = t.agg(F.max("all"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, source string, epoch long, k long, take long")
    # A few more points than the total needs; what a source still misses then is made up after them.
    slots = int(total / block) + 64 + 8 * n + int(total / block) // 16
    grid = 4096
    u = golden_points(F.col("slot"))
    s = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", u * F.lit(float(total))).withColumn("cell", F.floor(F.col("x") * grid / total).cast("long"))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid / total).cast("long"), F.floor(F.col("hi") * grid / total).cast("long"))))
    s = s.join(cells.select("cell", "source", "lo", "hi", "goal", "source_size"), "cell").where("x >= lo and x < hi")
    drawn = s.groupBy("source").agg(F.count("*").alias("drawn"))
    short = t.alias("t").join(drawn.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source")), "left")
    short = short.select("t.source", "lo", "hi", "goal", "source_size", "needed", F.coalesce("drawn", F.lit(0)).alias("drawn")).where("drawn < needed")
    short = short.withColumn("behind", F.sum(F.col("needed") - F.col("drawn")).over(order) - F.col("needed"))
    more = short.withColumn("r", F.explode(F.sequence(F.col("drawn"), F.col("needed") - 1))).withColumn("slot", slots + F.col("behind") + F.col("r"))
    s = s.withColumns({"one": F.lit(1).cast("long"), "run": F.shiftright("slot", 14)})
    s = _running(s, ["source"], ["slot"], "one", "run").withColumnRenamed("before", "r")
    s = s.select("slot", "source", "goal", "source_size", "r").unionByName(more.select("slot", "source", "goal", "source_size", "r"))
    blocks = F.ceil(F.col("source_size") / block)
    s = s.withColumns({"epoch": F.floor(F.col("r") / blocks).cast("long"), "k": F.pmod("r", blocks).cast("long")})
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("k") * block)
    take = F.least(length, F.col("goal") - F.col("epoch") * F.col("source_size") - F.col("k") * block)
    return s.withColumn("take", take).where("take > 0").select("slot", "source", "epoch", "k", "take")


def mix(docs: DataFrame, block: int = 256, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    A source's documents form a stream shuffled by md5(doc_id) and are cut into blocks of block words;
    taken is what the schedule's blocks take of a document, repeats counted. Every source takes its
    target to the word. Null sources are one source, last in order; documents without words take
    nothing; carry names columns of docs to return in a struct doc; null ids and repeated rows keep their rows (ties in the order are settled by size).
    An empty table gives no rows. Texts are read whole, however long; one longer than a block has a row a block while it is placed.
    """
    ws = Workspace(docs.sparkSession, "mix")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"), *([F.struct(*carry).alias("doc")] if carry else []))
    d = d.withColumns({"h": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "uid": F.monotonically_increasing_id()})
    base = ws.keep(d.withColumn("cell", F.substring("h", 1, 3)), "sizes")  # written, so uids stay
    d = base.drop("doc")
    targets = ws.keep(_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    used = schedule(targets, block).groupBy("source", "k", "take").agg(F.count("*").alias("uses"))
    placed = ws.keep(_running(d, ["source"], ["h", "doc_id", "size"], "size", "cell").drop("cell", "h"), "placed")
    spans = placed.where("size > 0").withColumn("k", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("size") - 1) / block))))
    hit = spans.alias("d").join(used.alias("u"), F.col("d.source").eqNullSafe(F.col("u.source")) & (F.col("d.k") == F.col("u.k")))
    lo = F.greatest(F.col("before"), F.col("d.k") * block)
    hi = F.least(F.col("before") + F.col("size"), F.col("d.k") * block + F.col("take"))
    taken = hit.select("uid", (F.greatest(F.lit(0), hi - lo) * F.col("uses")).alias("t")).groupBy("uid").agg(F.sum("t").alias("taken"))
    out = placed.join(taken, "uid", "left").alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    out = out.select("uid", "doc_id", "d.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    if carry:
        out = base.select("uid", "doc").join(out.hint("shuffle_hash"), "uid")
    return out.drop("uid")
