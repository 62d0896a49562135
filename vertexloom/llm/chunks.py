"""Chunks of documents, and a compact exchange of 64-bit keys between them.

A chunk is one row that holds about half a megabyte of documents. Keys of its content go out in
blobs, eight bytes each, to buckets that see all equal keys; a few bits a key come back to the chunk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.llm.base import Workspace, slices

CHUNK_BYTES = 1 << 19
#: Chunks, or answers of a bucket, that a function gets at once.
AT_ONCE = 8
BUCKET_BYTES = 12 << 20


def _pack(batches):
    import os

    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for b in slices(batch, "text", CHUNK_BYTES):
            n = b.num_rows
            items = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.to_struct_array())
            cid = int.from_bytes(os.urandom(8), "little") >> 1
            size = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([size], pa.int64()), items], ["cid", "size", "items"])


def chunked(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(cid, size, items array<struct of docs' columns>) of docs, which must have a column text; written once, so cids stay."""
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("items", T.ArrayType(docs.schema))])
    return ws.keep(docs.mapInArrow(_pack, schema), "chunks", 512)


def buckets_for(chunks: DataFrame) -> int:
    return max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))


def items(batches):
    """(cid, items as a struct array, other columns) of each chunk row."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            yield b.column("cid")[i].as_py(), b.column("items")[i].values, {n: b.column(n)[i] for n in names if n not in ("cid", "size", "items")}


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Ascending with the key, so sorted keys are grouped by bucket."""
    with np.errstate(over="ignore"):
        return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def bounds(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run."""
    if not len(sorted_buckets):
        return []
    cut = np.flatnonzero(np.diff(sorted_buckets)) + 1
    edges = [0, *cut.tolist(), len(sorted_buckets)]
    return [(int(sorted_buckets[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def beside(chunks: DataFrame, answers: DataFrame, work, schema) -> DataFrame:
    """work(cid, documents of a chunk as a struct array, table of its answers) for each chunk, one at a time; it gives a table."""

    def each(left, right):
        # Every answer is one to a chunk, so the left side always has its row.
        return work(left.column("cid")[0].as_py(), left.column("items").combine_chunks().flatten(), right)

    return chunks.select("cid", "items").groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(each, schema)
