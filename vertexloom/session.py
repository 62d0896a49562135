"""Making the package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_vertexloom_shipped"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors once per SparkContext.

    Spark's own file server distributes the archive, so nothing depends on a folder that
    the driver and the executors would have to share.
    """
    sc = spark.sparkContext
    if not getattr(sc, _SHIPPED, False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="vertexloom")) / "vertexloom_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        setattr(sc, _SHIPPED, True)
    return spark


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """rows spread by keys over a fixed number of partitions, for kernels whose rows are small and costly.

    Adaptive execution merges small partitions, as it judges them by bytes; it leaves a stated number alone.
    """
    spark = rows.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(number, *keys)


def settle(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed here, once a row.

    The optimizer otherwise puts costly array columns in wherever they are named: into filters that it moves down, and into
    lambdas, which compute them again for each element. Nothing is moved or put in across a row number that is looked at.
    """
    return rows.withColumn("_settled", F.monotonically_increasing_id()).where("_settled >= 0").drop("_settled")
