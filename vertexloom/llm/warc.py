"""WARC archives: one gzip member per record, written and read by byte ranges."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace, remove
from vertexloom.session import ship

MAGIC = b"\x1f\x8b\x08"
RECORD_SCHEMA = "path string, at long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8


def member(data: bytes, level: int = 4) -> bytes:
    """data as gzip that ends with a zero byte: the high byte of its length, or that of an empty member after it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    out = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def render(record_id: str, kind: str, uri: str, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(x: str) -> str:
    return re.sub(r"[\r\n]+", " ", x)


def parse(data: bytes) -> dict | None:
    """Fields of a record, or None if data isn't one."""
    if not data.startswith(b"WARC/1."):
        return None
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    if not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    if "application/http" in fields.get("content-type", ""):
        block = block.partition(b"\r\n\r\n")[2]
    return fields | {"_payload": block}


def _members(level: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                kind, payload = r["record_type"], (r["payload"] or "").encode() if r["record_type"] != "revisit" else b""
                page = "" if r["id"] is None else str(r["id"])
                refers = None if r["refers_to"] is None else str(r["refers_to"])
                # The writer adds the zero byte that each member ends with.
                out.append(member(render(page, kind, r["uri"] or "", r["digest"], r["size"], refers, payload), level)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["blob"])

    return run


def write_warc(pages: DataFrame, path: str, least: int = 1000, level: int = 4, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row of pages under path, by Spark's own committed file writer.

    Of rows with equal payloads of at least least bytes, that with the largest id is a response
    and the others are revisits of it; all smaller ones are responses. Payloads are UTF-8, null
    ones empty. Only ids and digests are compared, with a combinable maximum; what is found is joined
    to the payloads by id, so copies of one payload don't meet in one task. A payload of any length is one record,
    held by the task that writes it; columns other than id, uri and payload are not read.
    """
    ws = Workspace(pages.sparkSession, "warc-copies")
    p = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    slim = ws.keep(p.where(F.col("size") >= least).select("id", "digest"), "digests")
    # Written, so that the join's sides both are shuffles, which can be split where a payload is very common.
    last = ws.keep(slim.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last"), "last")
    # A repeated row of the largest id is a response too: it can't revisit itself.
    again = slim.join(last, "digest").where(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))).select("id", "digest", "last").distinct()
    again = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "last")
    p = p.join(again, p.id.eqNullSafe(F.col("_id")) & (p.digest == F.col("_digest")), "left").withColumn("revisit", F.col("last").isNotNull())
    p = p.withColumns({"record_type": F.when(F.col("revisit"), "revisit").otherwise("response"), "refers_to": F.when(F.col("revisit"), F.col("last"))})
    p = p.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    blobs = p.select("id", "uri", "payload", "digest", "size", "record_type", "refers_to").mapInArrow(_members(level), "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    ws.clear()


def _open(path: str):
    """A seekable reader of a file, wherever it is."""
    if path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")  # noqa: SIM115
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def scan(f, size: int, begin: int, end: int, window: int = 1 << 20):
    """(offset, record bytes) of members that start in [begin, end).

    A candidate is any gzip magic; it counts only if its deflate stream decodes to its own CRC
    and length. A valid member's bytes are skipped, so magic inside it is no candidate; a magic
    that the range's start cuts off from its member fails its check. Memory is one window and one
    decoded record.
    """
    at, buf, base = begin, b"", begin

    def fetch(to: int) -> None:
        nonlocal buf
        while base + len(buf) < to and base + len(buf) < size:
            f.seek(base + len(buf))
            got = f.read(max(window, to - base - len(buf)))
            if not got:
                break
            buf += got

    while at < end:
        if at - base > window:
            buf, base = buf[at - base :], at
        fetch(at + window)
        k = buf.find(MAGIC, at - base)
        if k < 0:
            at = max(at, base + len(buf) - 2)
            if base + len(buf) >= size:
                return
            if base + len(buf) >= end + 3:
                return
            continue
        at = base + k
        if at >= end:
            return
        got = _decode(f, size, at, memoryview(buf)[k:])
        if got is None:
            at += 1
            continue
        data, used = got
        if data:
            yield at, data
        at += used
        if at > base + len(buf):
            buf, base = b"", at


def _decode(f, size: int, at: int, ahead, piece: int = 1 << 16):
    """(data, length of the member), or None if no valid member starts at at.

    Compressed bytes are fed in small pieces, so no more than one of them is copied beyond the member's end.
    """
    z = zlib.decompressobj(31)
    ahead = memoryview(ahead)
    fed, out, checked = 0, [], False
    try:
        while not z.eof:
            part = ahead[fed : fed + piece]
            if not len(part):
                f.seek(at + fed)
                part = f.read(1 << 20)
                if not part:
                    return None
            fed += len(part)
            out.append(z.decompress(part))
            if not checked and out[-1]:
                checked = True
                if not b"WARC/1.".startswith(out[-1][:7]) and not out[-1].startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    return b"".join(out), fed - len(z.unused_data)


def _read(batches):
    import pyarrow as pa

    names = ["path", "at", "record_type", "record_id", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def plain(x):
        return re.sub("^<(?:urn:page:)?|>$", "", x) if x is not None else None

    for b in batches:
        for r in b.to_pylist():
            rows, held = [], 0
            with _open(r["path"]) as f:
                for at, data in scan(f, r["length"], r["begin"], r["end"]):
                    x = parse(data)
                    if x is None:
                        continue
                    digest = x.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = int(x.get("x-payload-length") or len(x["_payload"]))
                    rows.append((r["path"], at, x.get("warc-type"), plain(x.get("warc-record-id")), x.get("warc-target-uri"), plain(x.get("warc-refers-to")), digest, n, x["_payload"]))
                    held += len(data)
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def read_warc(spark: SparkSession, path: str, split: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Records of all files under path, one row each (RECORD_SCHEMA).

    Files are listed by Spark without being read and cut into ranges of split bytes; a task
    owns the records that start in its ranges, wherever they end. The ranges are dealt to a stated number of tasks, so
    that adaptive execution, which judges them by their few bytes, doesn't merge them: one for
    task_bytes of archives, or more for few archives. Local paths and stores that pyarrow knows are opened at an offset.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.where("length > 0").select("path", "length", begin.alias("begin")).withColumn("end", F.least(F.col("begin") + split, F.col("length")))
    n, total = ranges.agg(F.count("*"), F.sum(F.col("end") - F.col("begin"))).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(total or 0) // task_bytes))))
    return ranges.repartition(tasks, "path", "begin").mapInArrow(_read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read from archives just written.

    Null and repeated ids keep their records (a null id reads back null); an empty table gives none.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    at = f"{ws.root}/archives"
    write_warc(pages, at, **options)
    back = read_warc(spark, at)
    slim = back.select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"),
        "payload_bytes",
        # What a response holds is digested anew; a revisit's digest is what its header says.
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )
    out = ws.keep(slim, "records")
    remove(spark, at)
    return out
