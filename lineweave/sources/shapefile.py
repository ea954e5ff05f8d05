"""Shapefiles in: the published .shp and .dbf layouts, read by the task that holds the file."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

# Fixed values of the format: shape types of lines, without and with further ordinates
_LINES = (3, 13, 23)
_ROOM = 1 << 40


def shapes(body: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """Each record's parts; None for a shape that is no line."""
    out, at = [], 100
    while at + 8 <= len(body):
        size = struct.unpack(">i", body[at + 4 : at + 8])[0] * 2
        record, at = body[at + 8 : at + 8 + size], at + 8 + size
        if len(record) < 44 or struct.unpack("<i", record[:4])[0] not in _LINES:
            out.append(None)
            continue
        n_parts, n_points = struct.unpack("<ii", record[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", record[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", record[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        out.append([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])
    return out


def records(body: bytes, encoding: str = "utf-8") -> list[dict]:
    """Each row of a .dbf table; blank fields are null."""
    n, head, size = struct.unpack("<IHH", body[4:12])
    fields, at = [], 32
    while body[at] != 0x0D:
        name, kind, length, decimals = body[at : at + 11].split(b"\0")[0].decode(), chr(body[at + 11]), body[at + 16], body[at + 17]
        fields.append((name, kind, length, decimals))
        at += 32

    def value(raw: bytes, kind: str, decimals: int):
        text = raw.decode(encoding, "replace").strip(" \0")
        if not text or set(text) == {"*"}:
            return None
        if kind in "NF":
            return int(text) if kind == "N" and not decimals and "." not in text else float(text)
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        return text

    out = []
    for i in range(n):
        row, at, values = body[head + i * size : head + (i + 1) * size], 1, {}
        for name, kind, length, decimals in fields:
            values[name] = value(row[at : at + length], kind, decimals)
            at += length
        out.append(values)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """fid, props (JSON text), gtype, parts, crs (null), as read_geojson gives them. path: a .shp file or a folder of them; tables are found by name."""
    ship(spark)
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    stem = path[:-4] if path.lower().endswith(".shp") else None
    one = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(f"{stem}.{kind}" if stem else path).select(base(F.col("path")).alias("base"), F.col("content").alias(kind))
    files = one("shp").join(one("dbf"), "base", "left")
    places = files.select("base").distinct()
    numbered = files.join(places.withColumn("place", F.row_number().over(Window.orderBy("base")) - 1), "base").select("place", "shp", "dbf")  # a row for each file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                parts = shapes(bytes(r.shp))
                rows = records(bytes(r.dbf)) if r.dbf is not None else [{}] * len(parts)
                yield pd.DataFrame({
                    "fid": [r.place * _ROOM + i for i in range(len(parts))],
                    "props": [json.dumps(x) for x in rows[: len(parts)]],
                    "gtype": [None if p is None else "LineString" if len(p) == 1 else "MultiLineString" for p in parts],
                    "parts": [None if p is None else [[{"x": x, "y": y} for x, y in line] for line in p] for p in parts],
                    "crs": None,
                })

    return numbered.mapInPandas(run, "fid long, props string, gtype string, parts array<array<struct<x:double,y:double>>>, crs string")
