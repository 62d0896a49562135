"""Readers and writers of tracks: GPX, GeoJSON, CSV and PLT files to one row per fix."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vertexloom.session import ship

MOST_FIXES = 50_000
FIX = "path string, idx int, lat double, lon double, time string"
#: Fixed header synonyms of CSV columns.
LAT, LON, TIME = {"lat", "latitude", "y"}, {"lon", "lng", "long", "longitude", "x"}, {"time", "timestamp", "datetime", "date_time"}


def _fix(lat, lon, time=None) -> tuple[float, float, str | None]:
    lat, lon = float(lat), float(lon)
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError("coordinates out of range")
    return lat, lon, (time.strip()[:40] or None) if time else None


def gpx(text: str) -> list[tuple]:
    """Track points, or route points if there are none, in document order. Documents with a DTD are refused."""
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("a GPX file may not declare a document type or entities")
    name = lambda e: e.tag.rpartition("}")[2]
    root = ET.fromstring(text)
    for kind in ("trkpt", "rtept"):
        found = [e for e in root.iter() if name(e) == kind]
        if found:
            return [_fix(e.get("lat"), e.get("lon"), next((c.text for c in e if name(c) == "time"), None)) for e in found]
    raise ValueError("no track or route points")


def geojson(text: str) -> list[tuple]:
    """The first line of a document, depth first; parts of a multi-line are joined."""

    def line(x):
        kind = x.get("type") if isinstance(x, dict) else None
        if kind == "LineString":
            return x["coordinates"]
        if kind == "MultiLineString":
            return [p for part in x["coordinates"] for p in part]
        inner = {"Feature": [x.get("geometry")] if kind else [], "FeatureCollection": x.get("features", []) if kind else [], "GeometryCollection": x.get("geometries", []) if kind else []}.get(kind, [])
        return next((got for y in inner if (got := line(y))), None)

    points = line(json.loads(text))
    if not points:
        raise ValueError("no line in this document")
    return [_fix(p[1], p[0]) for p in points]


#: Columns of a delimited file that may hold coordinates or times.
_CELLS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def _degrees(x: Column, most: float, strict: bool) -> Column:
    """A coordinate within range; otherwise an error, or NULL."""
    value = x.try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= most)
    return F.when(fine, value).otherwise(F.raise_error(F.concat(F.lit("no coordinate: "), F.coalesce(x, F.lit("(none)")))).cast("double") if strict else F.lit(None).cast("double"))


def _delimited(files: DataFrame) -> DataFrame:
    """Fixes of CSV texts by header names; without known names, the first two columns. Blank rows are skipped, bad ones are errors."""
    schema = ", ".join(f"c{i} string" for i in range(_CELLS))
    cells = F.array(*[F.col("row")[f"c{i}"] for i in range(_CELLS)])
    rows = files.select("path", F.posexplode(F.filter(_lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, ",", "")) != "")).alias("at", "line"))
    rows = rows.withColumn("row", F.from_csv("line", schema, {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})).select("path", "at", cells.alias("c"))
    head = F.transform(F.col("c"), lambda x: F.lower(F.trim(x)))
    place = lambda names: (F.array_position(F.transform(head, lambda x: F.coalesce(x.isin(*names), F.lit(False))), True) - 1).cast("int")
    heads = rows.where("at = 0").select("path", place(LAT).alias("lat_at"), place(LON).alias("lon_at"), place(TIME).alias("time_at"))
    named = (F.col("lat_at") >= 0) & (F.col("lon_at") >= 0)
    d = rows.join(heads, "path").where(~named | (F.col("at") > 0))
    cell = lambda at, otherwise: F.get("c", F.when(named, F.col(at)).otherwise(otherwise))
    time = F.when(named & (F.col("time_at") >= 0), F.get("c", F.col("time_at")))
    return d.select("path", (F.col("at") - F.when(named, 1).otherwise(0)).cast("int").alias("idx"), _degrees(cell("lat_at", 0), 90.0, True).alias("lat"), _degrees(cell("lon_at", 1), 180.0, True).alias("lon"), _time(time).alias("time"))


def _time(x: Column) -> Column:
    return F.nullif(F.substring(F.trim(x), 1, 40), F.lit(""))


def _logged(files: DataFrame) -> DataFrame:
    """Fixes of PLT texts: six header lines, then lat,lon,...; bad rows are skipped."""
    rows = files.select("path", F.posexplode(F.slice(_lines(F.col("text")), F.lit(7), F.lit(1 << 30))).alias("at", "line")).withColumn("c", F.split("line", ","))
    d = rows.select("path", "at", _degrees(F.get("c", F.lit(0)), 90.0, False).alias("lat"), _degrees(F.get("c", F.lit(1)), 180.0, False).alias("lon")).where("lat is not null and lon is not null")
    place = W.partitionBy("path").orderBy("at")
    return d.select("path", (F.row_number().over(place) - 1).cast("int").alias("idx"), "lat", "lon", F.lit(None).cast("string").alias("time"))


def _marked_up(batches):
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())
    for b in batches:
        rows = [(p, i, *f) for p, t, k in zip(*(b.column(c).to_pylist() for c in ("path", "text", "kind")), strict=True) for i, f in enumerate({"gpx": gpx, "geojson": geojson}[k](t))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "idx", "lat", "lon", "time"])


def _members(batches):
    """Files of zip archives, by name, as path!member."""
    import zipfile

    import pyarrow as pa

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{path}!{name}"], pa.string()), pa.array([z.read(name)], pa.binary())], ["path", "content"])


def kind_of(path: Column, text: Column) -> Column:
    """gpx, geojson, csv or plt: by extension, else by how the text begins; NULL if unknown."""
    low, start = F.lower(path), F.substring(F.ltrim(text), 1, 1)
    by_name = F.when(low.endswith(".gpx"), "gpx").when(low.endswith(".geojson") | low.endswith(".json"), "geojson").when(low.endswith(".csv") | low.endswith(".txt"), "csv").when(low.endswith(".plt"), "plt")
    return F.coalesce(by_name, F.when(start == "<", "gpx").when(start == "{", "geojson"))


def read_tracks(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per fix (FIX) of all track files under path and in zip archives there.

    CSV and PLT are read by expressions; GPX and GeoJSON by one task a file, as their order counts. Unknown formats and files of
    more than MOST_FIXES fixes are errors.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    zipped = F.lower("path").endswith(".zip")
    files = files.where(~zipped).unionByName(files.where(zipped).mapInArrow(_members, "path string, content binary"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    texts = files.select("path", text.alias("text")).withColumn("kind", kind_of(F.col("path"), F.col("text")))
    known = F.coalesce("kind", F.raise_error(F.concat(F.lit("unknown track format: "), F.col("path"))).cast("string"))
    texts = texts.withColumn("kind", known)
    parsed = texts.where("kind in ('gpx', 'geojson')").mapInArrow(_marked_up, FIX)
    fixes = parsed.unionByName(_delimited(texts.where("kind = 'csv'"))).unionByName(_logged(texts.where("kind = 'plt'")))
    many = F.raise_error(F.concat(F.lit(f"more than {MOST_FIXES} points: "), F.col("path"))).cast("int")
    return fixes.withColumn("idx", F.when(F.col("idx") < MOST_FIXES, F.col("idx")).otherwise(many))


def _joined(fixes: DataFrame, key: str, point: Column, by: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", point.alias("p")))), lambda x: x["p"]), by)
    return fixes.groupBy(key).agg(body.alias("b"))


def csv_text(fixes: DataFrame, key: str = "path") -> DataFrame:
    """key, csv: time,lat,lon lines under a header, coordinates to 7 decimals; expressions only."""
    quoted = F.when(F.col("time").rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col("time"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce("time", F.lit("")))
    point = F.concat(quoted, F.format_string(",%.7f,%.7f", "lat", "lon"))
    return _joined(fixes, key, point, "\n").select(key, F.concat(F.lit("time,lat,lon\n"), F.col("b"), F.lit("\n")).alias("csv"))


def geojson_text(fixes: DataFrame, key: str = "path") -> DataFrame:
    """key, geojson: a Feature with one LineString, coordinates to 7 decimals; expressions only."""
    name = F.to_json(F.struct(F.col(key).cast("string").alias("name")))
    line = _joined(fixes, key, F.format_string("[%.7f,%.7f]", "lon", "lat"), ",")
    return line.select(key, F.concat(F.lit('{"type":"Feature","properties":'), name, F.lit(',"geometry":{"type":"LineString","coordinates":['), F.col("b"), F.lit("]}}")).alias("geojson"))


def gpx_text(fixes: DataFrame, key: str = "path") -> DataFrame:
    """key, gpx: one GPX 1.1 document per track, coordinates to 7 decimals; expressions only."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    time = F.when(F.col("time").isNotNull(), F.concat(F.lit("<time>"), escape(F.col("time")), F.lit("</time>"))).otherwise("")
    point = F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', "lat", "lon"), time, F.lit("</trkpt>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="vertexloom" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return _joined(fixes, key, point, "\n").select(key, F.concat(F.lit(head), escape(F.col(key)), F.lit("</name><trkseg>\n"), F.col("b"), F.lit("\n</trkseg></trk></gpx>\n")).alias("gpx"))
