"""A corpus from raw documents: clean, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs. So a stage begins by deleting what the operators of
the stages before it left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import mixing, near_dedup, packing, paragraph_dedup, quality
from vertexloom.llm.base import Workspace, sweep
from vertexloom.llm.queries import tokenizer_file


def _documents(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The columns of documents from the struct doc, with a new text and n_chars brought up to date with it."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go from the texts, and documents that the rules reject go."""
    sweep()
    judged = quality.quality(docs, carry=docs.columns)
    return _documents(judged.where("kept"), F.col("clean_text"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates, from a similarity of 0.8 on: of each component the document with the smallest id stays.

    Of rows that repeat an id, which are judged together, one stays: the one whose text comes first.
    """
    sweep()
    kept = near_dedup.near_duplicates(docs, num=80, den=100).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    # Written: ids that stand once, nearly all, need no text to be compared.
    kept = Workspace(spark, "kept").keep(kept, "kept")
    once = docs.join(kept.where("_rows = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    again = docs.join(kept.where("_rows > 1").select("doc_id"), "doc_id", "left_semi")
    row = F.struct(F.col("text").isNull().alias("_null"), "text", F.struct(*docs.columns).alias("_row"))
    again = again.groupBy("doc_id").agg(F.min(row).alias("_x")).select("_x._row.*").select(*docs.columns)
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages go from the texts; a document left without a word goes."""
    sweep()
    got = paragraph_dedup.repeated_passages(docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")))
    got = got.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select("text", "rest.doc")
    return _documents(got, F.col("text"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document is repeated as often as its source's target takes it, to the nearest whole."""
    sweep()
    taken = mixing.mix(docs, carry=docs.columns)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return taken.where("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where("_copy > 0").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece, with its sequence and its place there."""
    sweep()
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", clean), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("mixing", mix_sources), ("packing", pack)]

#: Near-duplicates and token ids aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline", lasting=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done, docs = docs, ws.keep(stage(spark, docs, sf_dir), name)
        ws.drop(done)
    sweep()
    return docs
