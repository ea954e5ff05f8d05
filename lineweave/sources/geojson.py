"""GeoJSON in and out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g

_GEOMETRY = "struct<type:string,coordinates:string>"
_SCHEMA = f"crs struct<properties:struct<name:string>>, features array<struct<type:string,properties:string,geometry:{_GEOMETRY}>>"
_FEATURE = f"type string, properties string, geometry {_GEOMETRY}"
#: Files of these kinds hold a feature a line, so one file is read by many tasks.
LINES = (".geojsonl", ".geojsons", ".ndjson", ".jsonl")
_KINDS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}
#: Features of one file that are numbered in a row.
_ROOM = 1 << 40


def read_geojson(spark: SparkSession, path: str, by_line: bool | None = None) -> DataFrame:
    """fid, props (JSON text), gtype, parts: one list of points per part, crs (as named in the file).

    fid follows the files by name and the features in each; with a feature a line, the order of reading. Only LineString and MultiLineString have parts; further
    ordinates are dropped; a position of fewer than two makes the parts null, as does any other broken geometry.
    """
    if by_line if by_line is not None else path.endswith(LINES):
        raw = spark.read.schema(_FEATURE).json(path)
        f = raw.select(F.lit(0).cast("long").alias("place"), F.monotonically_increasing_id().alias("at"), F.struct("type", "properties", "geometry").alias("f"), F.lit(None).cast("string").alias("crs"))
    else:
        raw = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).select("*", "_metadata.file_path")
        f = raw.select("file_path", F.posexplode("features").alias("at", "f"), F.col("crs.properties.name").alias("crs"))
        places = raw.select("file_path").distinct().withColumn("place", F.row_number().over(Window.orderBy("file_path")).cast("long") - 1)  # a row for each file
        f = f.join(places, "file_path") if len(raw.inputFiles()) > 1 else f.withColumn("place", F.lit(0).cast("long"))
    c = F.col("f.geometry.coordinates")
    lists = F.when(F.col("f.geometry.type") == "LineString", F.array(F.from_json(c, "array<array<double>>"))).when(F.col("f.geometry.type") == "MultiLineString", F.from_json(c, "array<array<array<double>>>"))
    whole = F.forall(lists, lambda line: F.forall(line, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()))
    parts = F.transform(lists, lambda line: F.transform(line, lambda p: g.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    return f.select((F.col("place") * _ROOM + F.col("at")).alias("fid"), F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("gtype"), F.when(whole, parts).alias("parts"), "crs")


def _fields(schema: str) -> list[tuple[str, str]]:
    """The top fields of OBJECT<name: TYPE, ...> and their types."""
    inner, out, depth, quoted, at = schema[len("OBJECT<") : -1], [], 0, False, 0
    cuts = []
    for i, ch in enumerate(inner):
        if ch == "`":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "<") - (ch == ">") + (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                cuts.append(i)
    for end in [*cuts, len(inner)]:
        piece = inner[at:end].strip()
        at = end + 1
        if piece.startswith("`"):
            name, kind = piece[1:].rsplit("`: ", 1)
            out.append((name.replace("``", "`"), kind))
        elif piece:
            out.append(tuple(piece.split(": ", 1)))
    return out


def typed(features: DataFrame, props: str = "props", into: str = "attrs") -> DataFrame:
    """The properties as one struct with a typed field each: text, whole numbers, numbers and flags; what is anything else, or mixed, is text."""
    schema = features.select(F.schema_of_variant_agg(F.try_parse_json(props)).alias("s")).first()["s"]
    names = _fields(schema) if schema and schema.startswith("OBJECT<") else []
    kind = lambda t: _KINDS.get(t, T.DoubleType() if t.startswith("DECIMAL") else T.StringType())
    struct = T.StructType([T.StructField(n, kind(t)) for n, t in names])
    if not names:
        return features.drop(props).withColumn(into, F.struct(F.lit(None).cast("string").alias("_none")))
    return features.withColumn(into, F.coalesce(F.from_json(F.col(props), struct), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields]))).drop(props)


def _feature(lines: DataFrame) -> Column:
    """A line's or (gtype, parts) feature's JSON text; attributes that begin with _ are left out, attrs is spread."""
    plain = [c for c in lines.columns if c not in ("pts", "parts", "gtype", "attrs") and not c.startswith("_")]
    values = [F.col(f"`{c}`").alias(c) for c in plain if "attrs" not in lines.columns]
    if "attrs" in lines.columns:
        values = [F.col("attrs")[f.name].alias(f.name) for f in lines.schema["attrs"].dataType.fields if not f.name.startswith("_")]
    properties = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if values else F.lit("{}")
    place = lambda pts: F.transform(pts, lambda p: F.array(p["x"], p["y"]))
    if "parts" in lines.columns:
        coordinates = F.when(F.col("gtype") == "LineString", F.to_json(place(F.element_at("parts", 1)))).otherwise(F.to_json(F.transform("parts", place)))
        kind = F.col("gtype")
    else:
        coordinates, kind = F.to_json(place(F.col("pts"))), F.lit("LineString")
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))


def write_features(lines: DataFrame, path: str) -> None:
    """A folder of files with one feature per line, written by all tasks."""
    lines.select(_feature(lines).alias("value")).write.text(path)


def write_geojson(lines: DataFrame, path: str, crs: str = "EPSG:4326") -> None:
    """One FeatureCollection in one file, in the order of fid; the driver holds one partition of it at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = lines.select("fid", _feature(lines).alias("value")).orderBy("fid").select("value").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","crs":' + json.dumps({"type": "name", "properties": {"name": crs}}) + ',"features":[')
        for i, r in enumerate(rows):
            f.write(("," if i else "") + "\n" + r["value"])
        f.write("\n]}\n")
