"""Token counts through a digest cache.

A count is stored under (digest of the content, digest of the tokenizer's file). A run joins its
texts' digests to the stored counts, encodes each distinct miss once and appends the new counts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        from vertexloom.llm.pretokens import encoder

        e = encoder(path)
        for b in batches:
            counts = [e.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids keep their rows, equal
    texts share one encoding, an empty table gives no rows, and other columns are not read. Texts
    are encoded whole, however long. The cache at cache_path may not exist yet; it is appended to.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "counts")
    version = tokenizer_digest(tokenizer_path)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    slim = ws.keep(d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = _stored(spark, cache_path, version)
    # One row stands for each distinct miss; only that row's text is sent to be encoded.
    miss = slim.groupBy("digest").agg(F.min("doc_id").alias("owner")).join(stored, "digest", "left_anti")
    miss = miss.select(F.col("digest").alias("m"), F.col("owner").alias("o")).hint("shuffle_hash")
    texts = d.join(miss, (d.digest == F.col("m")) & d.doc_id.eqNullSafe(F.col("o")), "left_semi").select("digest", "text")
    fresh = texts.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    # Repeated rows (same id, same text) give the same count twice.
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(version))
    fresh.select("digest", "tokenizer", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    # Written first: a join whose sides both are shuffles can split a text that very many documents hold.
    known = ws.keep(_stored(spark, cache_path, version), "known")
    return slim.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, path: str, version: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
    # Runs that overlap may append a digest twice.
    return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
