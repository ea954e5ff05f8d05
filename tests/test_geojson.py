import json
import struct

from lineweave.operators import network as net
from lineweave.sources import geojson, shapefile


def _feature(properties, kind, coordinates):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def _write(path, *features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def test_read_explode_write(spark, tmp_path):
    _write(
        tmp_path / "in.geojson",
        _feature({"name": "a", "fid": 7, "lanes": 2, "way,s": True, "mix": 1}, "MultiLineString", [[[0, 0], [1, 1]], [[2, 2, 9], [3, 3, 9]]]),
        _feature({"lanes": 3, "wide": 1.5, "mix": "x", "_own": "no"}, "LineString", [[5, 5], [6, 7]]),
        _feature(None, "Point", [5, 5]),
        _feature({"name": "broken"}, "LineString", [[5], [6, 7]]),
    )
    raw = geojson.read_geojson(spark, str(tmp_path / "in.geojson"))
    assert [(r.fid, r.gtype, r.parts is None) for r in raw.orderBy("fid").collect()] == [(0, "MultiLineString", False), (1, "LineString", False), (2, "Point", True), (3, "LineString", True)]
    typed = geojson.typed(raw)
    assert {f.name: f.dataType.simpleString() for f in typed.schema["attrs"].dataType.fields} == {"name": "string", "fid": "bigint", "lanes": "bigint", "way,s": "boolean", "mix": "string", "wide": "double", "_own": "string"}
    lines = net.explode_parts(typed.filter("parts IS NOT NULL")).drop("gtype", "crs", "part")
    geojson.write_geojson(lines, str(tmp_path / "new" / "out.geojson"))
    back = json.loads((tmp_path / "new" / "out.geojson").read_text())
    assert back["type"] == "FeatureCollection" and [f["geometry"]["coordinates"][0][0] for f in back["features"]] == [0.0, 2.0, 5.0]
    assert back["features"][0]["properties"] == {"name": "a", "fid": 7, "lanes": 2, "way,s": True, "mix": "1", "wide": None}
    assert back["features"][2]["properties"] == {"name": None, "fid": None, "lanes": 3, "way,s": None, "mix": "x", "wide": 1.5}
    geojson.write_features(lines, str(tmp_path / "features"))
    again = geojson.read_geojson(spark, str(tmp_path / "features"), by_line=True)
    assert again.count() == again.select("fid").distinct().count() == 3


def test_features_of_many_files_keep_apart(spark, tmp_path):
    for k in range(3):
        _write(tmp_path / f"f{k}.geojson", *[_feature({"k": 10 * k + i}, "LineString", [[k, i], [k + 1, i]]) for i in range(2)])
    got = geojson.typed(geojson.read_geojson(spark, str(tmp_path))).orderBy("fid").collect()
    assert [r.attrs.k for r in got] == [0, 1, 10, 11, 20, 21] and len({r.fid for r in got}) == 6


def test_shapefile(spark, tmp_path):
    def record(n, parts):
        points = [p for line in parts for p in line]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">2i", n, len(body) // 2) + body

    lines = [[[(0.0, 0.0), (1.5, 2.0)]], [[(5.0, 5.0), (6.0, 6.0)], [(7.0, 7.0), (8.0, 9.0), (9.0, 9.0)]]]
    (tmp_path / "net.shp").write_bytes(b"\0" * 100 + record(1, lines[0]) + record(2, lines[1]) + struct.pack(">2i", 3, 2) + struct.pack("<i", 0))
    fields = [(b"name", b"C", 8, 0), (b"lanes", b"N", 3, 0), (b"wide", b"N", 5, 2)]
    rows = [b" " + b"alpha   " + b"  2" + b" 1.50", b" " + b"        " + b"  *" + b"     ", b" " + b"gamma   " + b" 10" + b"12.00"]
    head = 32 + 32 * len(fields) + 1
    described = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([a, d]) + b"\0" * 14 for n, k, a, d in fields)
    (tmp_path / "net.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 3, head, 17) + b"\0" * 20 + described + b"\r" + b"".join(rows))
    got = geojson.typed(shapefile.read_shapefile(spark, str(tmp_path / "net.shp"))).orderBy("fid").collect()
    assert [r.gtype for r in got] == ["LineString", "MultiLineString", None]
    assert [[[tuple(p) for p in line] for line in r.parts] for r in got[:2]] == lines
    assert [(r.attrs.name, r.attrs.lanes, r.attrs.wide) for r in got] == [("alpha", 2, 1.5), (None, None, None), ("gamma", 10, 12.0)]
