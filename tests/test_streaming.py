import json

from vertexloom.streaming import edits

SCHEMA = "key string, ts timestamp, seq long, p array<double>"


def test_stream_comes_to_the_batch_cost(spark, tmp_path):
    ref = spark.createDataFrame([("a", [[0.0], [1.0], [2.0]]), ("b", [[0.0], [5.0]])], "key string, ref array<array<double>>")
    # The second file brings a vertex that belongs before ones of the first; the last moves the watermark on.
    files = [
        [("a", "2024-01-01T00:00:00Z", 0, [0.0]), ("a", "2024-01-01T00:00:20Z", 2, [50.0]), ("b", "2024-01-01T00:00:05Z", 0, [0.0])],
        [("a", "2024-01-01T00:00:10Z", 1, [1.0]), ("a", "2024-01-01T00:00:30Z", 3, [2.0]), ("b", "2024-01-01T00:00:40Z", 1, [9.0])],
        [("a", "2024-01-01T03:00:00Z", 4, [7.0])],
    ]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        text = "\n".join(json.dumps(dict(zip(("key", "ts", "seq", "p"), r, strict=True))) for r in rows)
        (tmp_path / "in" / f"{i}.json").write_text(text)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = edits.running_deletions(source, ref, 0.5)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seen").collect():
        last[r.key] = (r.seen, r.cost)
    done = spark.read.schema(SCHEMA).json(str(tmp_path / "in")).where("ts < '2024-01-01 01:00:00'")
    want = {r.key: (r.seen, r.cost) for r in edits.batch_deletions(done, ref, 0.5).collect()}
    assert last == want == {"a": (4, 1), "b": (2, None)}
