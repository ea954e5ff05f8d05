"""Line geometry as column expressions; a line is an ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def nearest(v: Column, digits: int) -> Column:
    """A double to so many decimals, as SQL engines that scale it do: halves away from zero. F.round goes by the decimal digits, at many times the cost."""
    scale = F.lit(10.0**digits)
    up = F.abs(v) * scale
    return F.when(up < F.lit(2.0**52), F.signum(v) * ((F.floor(up) + F.when(up - F.floor(up) >= 0.5, F.lit(1)).otherwise(F.lit(0))) / scale)).otherwise(v)


def start(pts: Column) -> Column:
    return F.element_at(pts, 1)


def end(pts: Column) -> Column:
    return F.element_at(pts, -1)


def spacings(pts: Column) -> Column:
    """Distances between consecutive vertices."""
    n = F.size(pts)
    return F.zip_with(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))


def length(pts: Column) -> Column:
    return F.aggregate(spacings(pts), F.lit(0.0), lambda s, d: s + d)


def snap_point(p: Column, precision: float) -> Column:
    """The centre of the grid cell that holds the point."""
    size = F.lit(float(precision))
    return point((F.floor(p["x"] / size) + F.lit(0.5).cast("double")) * size, (F.floor(p["y"] / size) + F.lit(0.5).cast("double")) * size)


def snap(pts: Column, precision: float) -> Column:
    return F.transform(pts, lambda p: snap_point(p, precision))


def moved(pts: Column, precision: float) -> Column:
    """How many vertices snapping moves by more than 1e-10."""
    return F.size(F.filter(F.zip_with(pts, snap(pts, precision), lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))), lambda d: d > 1e-10))


def cell(p: Column, precision: float) -> Column:
    return F.struct(F.floor(p["x"] / F.lit(float(precision))).alias("ix"), F.floor(p["y"] / F.lit(float(precision))).alias("iy"))


def is_valid(pts: Column) -> Column:
    """Two distinct points or more, and every ordinate a finite number."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce((F.size(F.array_distinct(pts)) >= 2) & F.forall(pts, lambda p: fine(p["x"]) & fine(p["y"])), F.lit(False))


def bounds(pts: Column) -> Column:
    """x0, y0, x1, y1 as a struct."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rounded(p: Column, digits: int = 8) -> Column:
    return F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))


def along(pts: Column) -> Column:
    """The length from the start to each vertex."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(spacings(pts), zero, lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def interpolate(pts: Column, fractions: Column) -> Column:
    """The points at an array of fractions of the length, each held to [0, 1]."""

    def between(k: Column, goal: Column, i: Column) -> Column:
        a, b, lo, hi = F.element_at(k["pts"], i), F.element_at(k["pts"], i + 1), F.element_at(k["at"], i), F.element_at(k["at"], i + 1)
        return let(F.when(hi > lo, (goal - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(0.0)), lambda t: point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))

    def place(k: Column, f: Column) -> Column:
        # the last vertex but one whose length does not pass the goal
        last = lambda goal: F.greatest(F.least(F.size(F.filter(k["at"], lambda d: d <= goal)), F.size(k["at"]) - 1), F.lit(1))
        return let(F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)) * F.element_at(k["at"], -1), lambda goal: let(last(goal), lambda i: between(k, goal, i)))

    return let(F.struct(pts.alias("pts"), along(pts).alias("at"), fractions.alias("f")), lambda k: F.transform(k["f"], lambda f: place(k, f)))


def pairs(pts: Column) -> Column:
    """The segments of a line: k, ax, ay, bx, by."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    made = F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.transform(made, lambda s, k: F.struct(k.alias("k"), s["ax"], s["ay"], s["bx"], s["by"]))


def foot(p: Column, s: Column) -> Column:
    """t in [0, 1] and the distance of the point of a segment that is nearest to p."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["ax"]) * dx + (p["y"] - s["ay"]) * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    return F.struct(t.alias("t"), F.hypot(p["x"] - s["ax"] - t * dx, p["y"] - s["ay"] - t * dy).alias("d"))


def point_line_distance(p: Column, pts: Column) -> Column:
    return F.array_min(F.transform(pairs(pts), lambda s: foot(p, s)["d"]))


def crosses(s: Column, r: Column) -> Column:
    """Whether two segments meet, by the sides on which their ends lie."""
    side = lambda a, x, y: F.signum((a["bx"] - a["ax"]) * (y - a["ay"]) - (a["by"] - a["ay"]) * (x - a["ax"]))
    within = lambda a, x, y: (F.least(a["ax"], a["bx"]) <= x) & (x <= F.greatest(a["ax"], a["bx"])) & (F.least(a["ay"], a["by"]) <= y) & (y <= F.greatest(a["ay"], a["by"]))
    o1, o2, o3, o4 = side(s, r["ax"], r["ay"]), side(s, r["bx"], r["by"]), side(r, s["ax"], s["ay"]), side(r, s["bx"], s["by"])
    touch = ((o1 == 0) & within(s, r["ax"], r["ay"])) | ((o2 == 0) & within(s, r["bx"], r["by"])) | ((o3 == 0) & within(r, s["ax"], s["ay"])) | ((o4 == 0) & within(r, s["bx"], s["by"]))
    return ((o1 * o2 < 0) & (o3 * o4 < 0)) | touch


def is_simple(pts: Column) -> Column:
    """Whether no two segments meet that are not neighbours; a ring's first and last are neighbours."""
    every, n = pairs(pts), F.size(pts) - 1
    closed = start(pts) == end(pts)
    near = lambda s, r: (r["k"] <= s["k"] + 1) | (closed & (s["k"] == 0) & (r["k"] == n - 1))
    return ~F.exists(every, lambda s: F.exists(every, lambda r: ~near(s, r) & crosses(s, r)))
