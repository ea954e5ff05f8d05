import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave import rows as rows_
from lineweave.functions import geometry as g
from lineweave.graph import connected_components
from lineweave.operators import network as net
from lineweave.plans import demo

SF = "/root/testdata/sf0.001"


def _lines(spark, *rows):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rows)], "fid long, pts array<struct<x:double,y:double>>")


def test_snap_goes_to_cell_centres(spark):
    d = _lines(spark, [(7.9, -3.1), (4.0, 12.2)], [(-0.4, -9.6), (2.0, 6.0)])
    got = [[tuple(p) for p in r.pts] for r in net.snap_vertices(d, 4.0).orderBy("fid").collect()]
    assert got == [[(6.0, -2.0), (6.0, 14.0)], [(-2.0, -10.0), (2.0, 6.0)]]
    assert [r[0] for r in d.orderBy("fid").select(g.moved(F.col("pts"), 4.0)).collect()] == [2, 1]


def test_dedup_policies(spark):
    d = _lines(spark, [(0, 0), (5, 9), (9, 0)], [(9, 0), (0, 0)], [(0, 0), (9, 0)])
    for keep, fid in (("shortest", 1), ("first", 0), ("longest", 0)):
        assert [r.fid for r in net.dedup_edges(d, 1.0, keep).collect()] == [fid]
    with pytest.raises(ValueError):
        net.dedup_edges(d, 1.0, "other")


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_components_over_many_tasks(spark):
    """No task holds enough of the edges to settle them by itself, so rounds are needed."""
    r = random.Random(3)
    path = r.sample(range(1000, 1200), 200)
    edges = [*zip(path, path[1:], strict=False), *((r.randrange(150), r.randrange(150)) for _ in range(90)), *((2000, 2000 + r.randrange(99)) for _ in range(60))]
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "13"), strict=True):
        spark.conf.set(n, v)
    try:
        got = [tuple(x) for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()]
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    up = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert sorted(got) == sorted(up.items())


def _brute_components(rows, precision):
    """fid -> least fid in reach, by union-find over end cells."""
    up, at = {r.fid: r.fid for r in rows}, {}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in rows:
        for p in (r.pts[0], r.pts[-1]):
            cell = (math.floor(p["x"] / precision), math.floor(p["y"] / precision))
            a, b = top(r.fid), top(at.setdefault(cell, r.fid))
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def test_line_components_equal_brute_force(spark):
    rng = random.Random(4)
    d = _lines(spark, *[[(rng.randrange(12) * 5 + 1, rng.randrange(12) * 5 + 1) for _ in range(2)] for _ in range(60)])
    want = _brute_components(d.collect(), 5.0)
    assert len(set(want.values())) > 5
    assert {r.fid: r.component for r in net.components(net.snap_vertices(d, 5.0)).collect()} == want


def test_component_labels_cover_the_whole_network(spark):
    want = _brute_components(demo.lines(spark, SF).collect(), demo.P)
    rows = demo.QUERIES["component_labels"](spark, SF).collect()
    assert len(rows) == len(want) and {r.fid: r.component for r in rows} == want


def test_ends_in_one_cell_that_do_not_meet_are_two_components(spark):
    d = _lines(spark, [(0, 0), (4, 0)], [(4.4, 0), (9, 0)], [(9, 0), (9, 5)])
    assert {r.fid: r.component for r in net.components(d).collect()} == {0: 0, 1: 1, 2: 1}
    assert [(r.component, r.n) for r in net.small_components(d, 2, 0.0).collect()] == [(0, 1)]


def test_attributes_are_quoted_and_ordered(spark):
    rows = [(9, 1, "Quay, north side", 2.5), (3, 1, "Mill Lane", 1.0), (7, 1, None, None), (4, 1, "Mill Lane", 2.5), (5, 2, None, None)]
    d = spark.createDataFrame(rows, "fid long, k int, name string, width double")
    assert {r.k: r.name for r in net.merge_attribute(d, "k", "name").collect()} == {1: 'Mill Lane,"Quay, north side"', 2: None}
    assert {r.k: r.width for r in net.merge_attribute(d, "k", "width").collect()} == {1: "1.0,2.5", 2: None}


def _alike(a, b, tol):
    """Brute force: points at equal shares of both lines."""
    size = lambda p: sum(math.dist(u, v) for u, v in zip(p, p[1:], strict=False))
    if abs(size(a) - size(b)) > 2 * tol:
        return False
    n = min(10, max(3, int(min(size(a), size(b)) / tol)))

    def at(p, f):
        goal = f * size(p)
        for u, v in zip(p, p[1:], strict=False):
            d = math.dist(u, v)
            if goal <= d and d:
                return (u[0] + goal / d * (v[0] - u[0]), u[1] + goal / d * (v[1] - u[1]))
            goal -= d
        return p[-1]

    return all(math.dist(at(a, i / (n - 1)), at(b, i / (n - 1))) <= tol + 1e-9 for i in range(n))


def test_paths_between_one_pair_of_nodes(spark):
    rng = random.Random(6)
    rows = [[(0, 0), (20, rng.choice((0.0, 0.4, 9.0, 9.3, -9.0))), (40, rng.choice((0.0, 0.3)))] for _ in range(25)] + [[(40, 0), (20, 9), (0, 0)]]
    want, lead = {}, []
    for i, r in enumerate(rows):
        first = next((j for j in lead if _alike(rows[j], r, 1.0)), None)
        if first is None:
            lead.append(i)
        want[i] = i if first is None else first
    assert len(lead) > 3
    d = _lines(spark, *rows)
    assert {r.fid: r.path for r in net.path_groups(d, 1.0, 1.0).collect()} == want
    assert {r.fid for r in net.dedup_edges(d, 1.0, "first", 1.0).collect()} == set(lead)


def test_numbers_and_quantiles_at_both_sides_of_their_limits(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.choice((rng.random() * 1e6, 5.0, rng.random())) for _ in range(3000)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    want = [float(np.quantile(values, f)) for f in (0.0, 0.05, 0.5, 0.99, 1.0)]
    for few, bins in ((10, 7), (4096, 2048)):
        monkeypatch.setattr(rows_, "_FEW", few)
        monkeypatch.setattr(rows_, "_BINS", bins)
        assert rows_.quantiles(d, "v", (0.0, 0.05, 0.5, 0.99, 1.0)) == pytest.approx(want, abs=1e-9)
    assert rows_.quantiles(d.limit(0), "v", (0.5,)) is None
    monkeypatch.setattr(rows_, "_ROOM", 3)
    sparse = spark.createDataFrame([(x, k) for x in (900, 5, 3, 1 << 50, 4) for k in (1, 0)], "fid long, k int")
    got = {(r.fid, r.k) for r in rows_.renumbered(sparse, "fid", "k").collect()}
    assert sorted(x for x, _ in got) == list(range(10)) and all(x % 2 == k for x, k in got)


@pytest.mark.parametrize("name", ["edge_dedup_shortest", "topology_summary", "vertex_spacing_bounds", "degree2_nodes", "edge_table", "overlap_pairs", "split_pieces", "degree2_merge", "simplify_3pt", "interpolate_points", "reproject_utm", "reproject_equal_area"])
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(demo.ORACLES[name]).df()
    got = demo.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(repr, d[sorted(want.columns)].values.tolist()))
    assert key(got) == key(want)
