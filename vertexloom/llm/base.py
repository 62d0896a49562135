"""Shared plumbing of the training-data operators: inputs, written intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import ship

#: White space that separates words: space and the ASCII controls from tab to carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vertexloom-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Workspace:
    """Written tables that cut lineage, in the shared folder.

    A lost executor costs only the tasks that ran on it: what is written stays readable.
    """

    live: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, what: str, lasting: bool = False):
        self.spark = ship(spark)
        self.root = f"{shared_dir(spark)}/vertexloom-{what}-{uuid.uuid4().hex}"
        self.made = 0
        if not lasting:
            Workspace.live.append(self)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write df as Parquet and read it back. batch: rows that readers and Arrow functions in it take at once, fewer for large rows."""
        path = self.path(name)
        with writing(self.spark, batch):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for df in tables:
            if path := getattr(df, "_kept_at", None):
                remove(self.spark, path)

    def clear(self) -> None:
        """Delete the folder with all that is left in it."""
        remove(self.spark, self.root)
        if self in Workspace.live:
            Workspace.live.remove(self)


def sweep() -> None:
    """Delete the intermediate tables of all operators run so far, once their results are written elsewhere."""
    for ws in list(Workspace.live):
        ws.clear()


@contextmanager
def writing(spark: SparkSession, rows: int | None):
    """Settings while a table is written: shuffle files go, on every executor, as soon as it is; Parquet readers and Arrow functions take at most so many rows at once."""
    at_once = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {name: spark.conf.get(name) for name in (*at_once, cleanup)}
    spark.conf.set(cleanup, "true")
    for name in at_once if rows is not None else ():
        spark.conf.set(name, min(rows, int(before[name])))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about most_bytes of text (a single longer row stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges: (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps, which keep the number of edges linear and need
    about log(n) rounds; each round is two combinable minima and two equi-joins, and is written,
    so no lineage grows and no component or link is gathered anywhere.
    """
    e = ws.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written first: a join whose sides both are shuffles can split a vertex that very many edges meet in.
        low = ws.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.keep(large.where("a <> b").distinct(), "large")
        ws.drop(low)
        low = ws.keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = ws.keep(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _digest(new)
        ws.drop(e, large, low)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _digest(e: DataFrame) -> tuple[int, int]:
    n, h = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(h or 0)
