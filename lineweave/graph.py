"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .storage import written

#: Edges that a task brings together before the first round.
_LOCAL = 1 << 19


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u > v, so many of a task at a time, as edges to the least node that they lead to: a path is one step long in the first round."""

    def stars(u: list[int], v: list[int]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(i: int) -> int:
            at = i
            while (to := up.get(at, at)) != at:
                at = to
            while i != at:
                up[i], i = at, up.get(i, i)
            return at

        for a, b in zip(u, v, strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(i) for i in nodes], pa.int64())], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _LOCAL:
            yield stars(*(np.concatenate([x.column(i).to_numpy() for x in held]).tolist() for i in (0, 1)))
            held, n = [], 0
    if held:
        yield stars(*(np.concatenate([x.column(i).to_numpy() for x in held]).tolist() for i in (0, 1)))


def _labels(edges: DataFrame) -> DataFrame:
    """id, lo, hi: of each node the least and the greatest of its lesser neighbours, and of itself if it has a greater one."""
    ends = F.array(F.struct(F.col("u").alias("id"), "v"), F.struct(F.col("v").alias("id"), "v"))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the least id in reach.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): rounds grow
    with the logarithm of the longest path, which each task shortens among its own edges,
    so that a remainder which one task holds is done at once. It ends when every node has
    one label, its own or that of its only neighbour. Loops, nulls and repeated edges are
    ignored; ids are whole numbers.
    """
    ship(edges.sparkSession)
    local = lambda d: d.distinct().mapInArrow(lambda x: _local(x), "u long, v long")
    both = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v")
    now = written(local(both.mapInArrow(lambda x: _local(x), "u long, v long")))
    for _ in range(most_rounds):
        # tables that meet are written, so that both sides of a join are exchanged and a hub's rows can be dealt to several tasks
        labels = written(_labels(now))
        if labels.filter("lo <> hi").isEmpty():
            return labels.select("id", F.col("lo").alias("component"))
        # large star: a node's greater neighbours go to the least of its neighbours and itself
        large = written(now.join(labels, now["v"] == labels["id"]).select("u", F.col("lo").alias("v")).distinct())
        # small star: a node and its lesser neighbours go to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(local(small.union(least.select("u", F.col("m").alias("v")))))
    raise RuntimeError("components did not settle")
