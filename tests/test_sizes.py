"""Forms of the pair queries that larger tables need, and rows of larger tables on which they differed from their SQL."""

import duckdb
import pytest

from lineweave.operators import spatial as sp
from lineweave.plans import demo

SCHEMA = "fid long, highway string, pts array<struct<x:double,y:double>>"


def _lines(spark, *rows):
    return spark.createDataFrame([(i, f"h{i}", [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rows)], SCHEMA)


def _same_as_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        want = c.execute(demo.ORACLES[name]).fetchall()
    got = [tuple(r) for r in demo.QUERIES[name](spark, str(folder)).collect()]
    assert sorted(got) == sorted(want) and want
    return want


def _customers(spark, folder, name, *keys):
    return _same_as_sql(spark, folder, name, "customer", [(k, f"s{k % 3}", f"n{k}") for k in keys], "c_custkey long, c_mktsegment string, c_name string")


def test_segments_of_a_cell_are_paired_only_if_their_boxes_meet(spark):
    d = _lines(spark, *[[(k % 20 + 1, k // 20 + 1), (k % 20 + 1.5, k // 20 + 1.5)] for k in range(400)], [(0.5, 3.2), (39, 3.3)])
    assert sp._met(sp.segments(d), 40.0).filter("a_fid <> b_fid").count() == 20
    assert sp.intersections(d, 40.0).count() == 40


def test_pieces_of_a_long_segment_name_a_cell_once(spark):
    cells = sp.dealt(sp.segments(_lines(spark, [(0, 0), (900, 700)], [(900, 50), (-30, 50)], [(7, 0), (7, -333)])), 10.0)
    assert cells.count() == cells.distinct().count() > 200


def test_split_points_round_as_their_sql_does(spark, tmp_path):
    assert len(_customers(spark, tmp_path, "split_points", 168, 50018, 356, 23973)) == 4


def test_an_end_on_a_line_but_for_rounding_is_a_near_miss_to_the_sql_alone(spark, tmp_path):
    keys = (21, 59825, 143, 35185)
    assert len(_customers(spark, tmp_path, "near_misses", *keys)) == 2
    assert sp.near_misses(demo.crossing(spark, str(tmp_path)), 0.5, 40.0).count() == 0


def test_lines_of_one_box_are_compared_as_one_and_lose_no_pair(spark, monkeypatch):
    one, other, short = [(0, 0), (10, 0)], [(0, 0.4), (10, 0.4)], [(0, 0), (2, 0)]
    d = _lines(spark, *[(one, other, short)[k % 3] for k in range(60)], [(-500, -3), (900, 3)])
    boxes = []
    met = sp.box_pairs
    monkeypatch.setattr(sp, "box_pairs", lambda b, cell: (boxes.append(b.count()), met(b, cell))[1])
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a % 3 == 2) == (b % 3 == 2)}
    for most, least in ((1024, 3), (7, 6)):
        monkeypatch.setattr(sp, "_ALIKE", most)
        for bearing in (None, 10.0):
            got = [tuple(r) for r in sp.overlap_pairs(d, 0.5, 4.0, bearing=bearing).collect()]
            assert len(got) == len(want) and set(got) == want
            assert least < boxes[-1] <= 13
    assert len(sp.overlap_pairs(d, 0.5, 4.0, ratio_min=0.0).collect()) == 61 * 60 // 2


def test_overlap_pairs_are_made_from_lists_without_a_look_at_each_pair(spark, monkeypatch):
    rows = [(False, [1, 5, 9, 5], [5, 2, 7]), (False, [4, 8], [6]), (True, [3, 12, 10, 3, 11], [3, 12, 10, 3, 11]), (True, [20], [20]), (False, [30], [30])]
    want = sorted((min(p, q), max(p, q)) for one, ps, qs in rows for i, p in enumerate(ps) for j, q in enumerate(qs) if p != q and (i < j or not one))
    for most in (1, 6, 1 << 16):
        monkeypatch.setattr(sp, "_ROW_PAIRS", most)
        got = sp._each(spark.createDataFrame(rows, "one boolean, ps array<long>, qs array<long>"))
        assert sorted(tuple(r) for r in got.collect()) == want
    plan = sp.overlap_pairs(_lines(spark, [(0, 0), (9, 0)], [(1, 0), (9, 0)]), 0.5, 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[: plan.index("Generate explode")]


def test_lines_without_a_fid_are_in_no_overlap_pair(spark):
    line = lambda *p: [{"x": float(x), "y": 0.0} for x in p]
    d = spark.createDataFrame([(None, "a", line(0, 7)), (None, "b", line(0, 7)), (1, "c", line(0, 9)), (2, "d", line(0, 9)), (3, "e", None), (4, "f", line(0))], SCHEMA)
    assert [tuple(r) for r in sp.overlap_pairs(d, 0.5, 4.0).collect()] == [(1, 2)]


def test_split_pieces_round_as_their_sql_does(spark, tmp_path):
    assert len(_customers(spark, tmp_path, "split_pieces", 168, 50018, 356, 23973)) == 8


def test_pieces_keep_vertices_between_cuts_and_lines_without_cuts(spark):
    rows = [[(0, 0), (2, 0), (4, 0), (4, 0), (6, 0)], [(1, -1), (1, 1)], [(5, -1), (5, 1)], [(50, 50), (50, 50), (60, 50)], [(2, -1), (2, 1)]]
    got = sp.split_at_intersections(_lines(spark, *rows), 3.0).orderBy("fid", "piece").collect()
    pts = lambda fid: [(r.piece, [tuple(p) for p in r.pts]) for r in got if r.fid == fid]
    assert pts(0) == [(0, [(0, 0), (1, 0)]), (1, [(1, 0), (2, 0)]), (2, [(2, 0), (4, 0), (5, 0)]), (3, [(5, 0), (6, 0)])]
    assert pts(3) == [(0, [(50, 50), (50, 50), (60, 50)])] and len(got) == 11 and {r.highway for r in got if r.fid == 4} == {"h4"}
