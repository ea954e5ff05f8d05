import dataclasses
import json

import pytest

from lineweave import cli
from lineweave.plans import clean as plans
from lineweave.plans.config import SAVED, CleanConfig, load_config, save_config, validated


def _line(k, *p, kind="LineString"):
    return {"type": "Feature", "properties": {"highway": f"h{k}", "lanes": k}, "geometry": {"type": kind, "coordinates": [list(x) for x in p] if kind == "LineString" else [[list(x) for x in p]]}}


CROSS = (_line(0, (16.37, 48.20), (16.38, 48.20)), _line(1, (16.375, 48.195), (16.375, 48.205)), _line(2, (16.37, 48.20), (16.38, 48.20)), {**_line(3), "geometry": {"type": "Point", "coordinates": [1, 1]}}, _line(4, (1, 1), (1, 1)))


@pytest.fixture
def cross(tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": CROSS}))
    return path


def test_a_file_is_cleaned_from_the_command_line(spark, tmp_path, cross):
    (tmp_path / "c.json").write_text(json.dumps({"snap_precision": 1.0, "preserve_fields": ["highway"], "pairing_batch_size": 5}))
    cli.main(["clean", str(cross), str(tmp_path / "out.geojson"), "--config", str(tmp_path / "c.json"), "--report", str(tmp_path / "r.json")])
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["processing_crs"] == "EPSG:32633" and r["original_crs"] == "EPSG:4326" and r["config"]["snap_precision"] == 1.0
    assert (r["input_count"], r["features_of_other_types"], r["invalid_features"], r["split_count"], r["duplicates_removed"], r["duplicate_rows_removed"]) == (5, 1, 1, 3, 4, 2)
    assert r["output_connected_components"] == 1 and r["snapped_vertex_changes"] == 6 and r["vertices_removed"] == 0 and r["length_change"] < 0
    out = json.loads((tmp_path / "out.geojson").read_text())["features"]
    assert len(out) == r["output_count"] == 4 and all(16.3 < x < 16.4 and 48.1 < y < 48.3 for f in out for x, y in f["geometry"]["coordinates"])
    assert sorted(f["properties"]["highway"] for f in out) == ["h0", "h0", "h1", "h1"] and all(set(f["properties"]) == {"highway"} for f in out)


def test_steps_and_their_reports(spark, tmp_path, cross):
    out = str(tmp_path / "out.geojson")
    r = cli.run(["split", str(cross), out, "--metric-crs", "EPSG:32633"])
    assert r["operation"] == "split" and r["split_count"] == 3 and r["output_count"] == 6
    r = cli.run(["deoverlap", out, str(tmp_path / "o2.geojson"), "--dedup-policy", "keep-first"])
    assert r["duplicates_removed"] == 4 and r["output_count"] == 4
    r = cli.run(["snap", str(tmp_path / "o2.geojson"), out, "--snap-precision", "2"])
    assert r["snapped_vertex_changes"] > 0 and r["config"]["snap_precision"] == 2.0
    chain = tmp_path / "chain.geojson"
    chain.write_text(json.dumps({"type": "FeatureCollection", "features": [_line(0, (16.0, 48.0), (16.001, 48.0)), _line(1, (16.001, 48.0), (16.002, 48.00001), (16.003, 48.0)), _line(2, (16.5, 48.5), (16.50001, 48.5)), _line(3, (16.1, 48.0), (16.2, 48.0), kind="MultiLineString")]}))
    r = cli.run(["explode", str(chain), out])
    assert (r["exploded_count"], r["input_multilinestring_count"], r["output_count"]) == (0, 1, 4)
    r = cli.run(["merge-degree2", str(chain), out, "--merge-policy", "concatenate"])
    assert (r["degree2_nodes_found"], r["degree2_merges_performed"], r["output_count"]) == (1, 1, 2)
    assert "h0; h1" in {f["properties"]["highway"] for f in json.loads((tmp_path / "out.geojson").read_text())["features"]}
    r = cli.run(["remove-components", str(chain), out, "--min-features", "1"])
    assert (r["small_components_removed"], r["small_component_features_removed"], r["output_count"], r["output_connected_components"]) == (1, 1, 2, 1)
    r = cli.run(["simplify", str(chain), out, "--simplify-tolerance", "3"])
    assert r["vertices_before_simplify"] == 7 and r["vertices_removed"] == 1 and r["pruned_segments"] == 0


def test_validation(spark, tmp_path, cross, capsys):
    got = cli.run(["validate", str(cross), "-v"])
    assert got["features"] == 5 and any("invalid" in x for x in got["issues"]) and "bbox diagonal" in capsys.readouterr().out
    with pytest.raises(ValueError, match="other geometry types"):
        cli.run(["clean", str(cross), str(tmp_path / "o"), "--strict"])
    empty = tmp_path / "empty.geojson"
    empty.write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(SystemExit):
        cli.main(["clean", str(empty), str(tmp_path / "o")])


def test_tolerances_are_held_to_the_data():
    m = {"p05": 1.0, "p50": 10.0, "l50": 50.0, "diagonal": 1000.0}
    got, issues = validated(CleanConfig(prune_epsilon=5.0), m)
    assert got.snap_precision == 0.25 and got.overlap_tolerance == 0.125 and got.prune_epsilon == 0.125 and len(issues) == 1
    with pytest.raises(ValueError):
        validated(CleanConfig(prune_epsilon=5.0, strict_validation=True), m)
    assert validated(CleanConfig(), None) == (CleanConfig(), [])


@pytest.mark.parametrize("wrong", [{"dedup_policy": "other"}, {"merge_attribute_policy": "x"}, {"snap_precision": 0}, {"overlap_tolerance": 0}, {"prune_epsilon": -1}, {"pairing_overlap_alpha": 2}, {"pairing_length_ratio_min": 3.0}])
def test_parameters_out_of_range(wrong):
    with pytest.raises(ValueError):
        CleanConfig(**wrong)


def test_configuration_files(tmp_path):
    for kind in ("json", "yaml"):
        if kind == "yaml":
            pytest.importorskip("yaml")
        path = str(tmp_path / f"c.{kind}")
        cli.run(["config", path, "--format", kind])
        assert load_config(path) == CleanConfig() and len(SAVED) == 16
        save_config(dataclasses.replace(CleanConfig(), preserve_fields=["a"], verbose=1), path, kind)
        assert load_config(path).preserve_fields == ["a"]
    for name, text in (("c.txt", ""), ("d.json", '{"unknown": 1}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            load_config(str(tmp_path / name))


def test_features_with_parts(spark):
    rows = [(0, [[(0.0, 0.0), (100.0, 0.0)], [(100.0, 0.0), (100.0, 100.0)]], "a"), (1, [[(50.0, -50.0), (50.0, 50.0)]], "b"), (2, None, "c")]
    f = spark.createDataFrame([(i, p and [[{"x": x, "y": y} for x, y in line] for line in p], n) for i, p, n in rows], "fid long, parts array<array<struct<x:double,y:double>>>, name string")
    lines, r = plans.clean_network(f, "EPSG:3857", CleanConfig(metric_crs="EPSG:3857", snap_precision=1.0))
    assert (r["exploded_count"], r["invalid_features"], r["split_count"]) == (2, 1, 2) and r["output_count"] == lines.count()
