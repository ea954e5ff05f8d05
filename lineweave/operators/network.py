"""Cleaning steps on a table of lines: fid, pts and any attributes. fid is the input's order.

Nodes come in two kinds. A cell of the snap grid is the node of edges and of duplicates; an end rounded to eight digits
is the node of degree-2 merges and of components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..graph import connected_components
from ..rows import quantiles
from ..storage import written


def explode_parts(features: DataFrame, parts_col: str = "parts") -> DataFrame:
    """One row per part of a multi-part line, with the attributes and `part`."""
    return features.select("*", F.posexplode(parts_col).alias("part", "pts")).drop(parts_col)


def snap_vertices(lines: DataFrame, precision: float) -> DataFrame:
    return lines.withColumn("pts", g.snap(F.col("pts"), precision))


def edges(lines: DataFrame, precision: float) -> DataFrame:
    """Adds u <= v, the cells of a line's two ends."""
    a, b = g.cell(g.start(F.col("pts")), precision), g.cell(g.end(F.col("pts")), precision)
    return lines.withColumn("u", F.least(a, b)).withColumn("v", F.greatest(a, b))


def dedup_edges(lines: DataFrame, precision: float, keep: str = "shortest", path_tolerance: float | None = None) -> DataFrame:
    """One line for each pair of end cells; ties go to the least fid. With path_tolerance, one for each path between them."""
    size = g.length(F.col("pts"))
    order = {"shortest": [size, F.col("fid")], "longest": [F.desc(size), F.col("fid")], "first": [F.col("fid")]}
    if keep not in order:
        raise ValueError(f"keep must be one of {sorted(order)}")
    keyed, by = edges(lines, precision), ["u", "v"]
    if path_tolerance is not None:
        keyed, by = keyed.join(path_groups(lines, precision, path_tolerance), "fid"), ["path"]
    w = Window.partitionBy(*by).orderBy(*order[keep])
    return keyed.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "path")


def similar(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two lines run alike: lengths within twice the tolerance, and 3 to 10 points at equal shares of them within it. A reversed copy is not alike."""
    tol = F.lit(float(tolerance))
    count = lambda k: F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.least(k["la"], k["lb"]) / tol).cast("int")))
    shares = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / (n - 1))
    near = lambda s: F.forall(F.zip_with(g.interpolate(a, s), g.interpolate(b, s), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])), lambda d: d <= tol)
    return g.let(F.struct(g.length(a).alias("la"), g.length(b).alias("lb")), lambda k: F.when(F.abs(k["la"] - k["lb"]) > 2 * tol, F.lit(False)).otherwise(g.let(count(k), lambda n: g.let(shares(n), near))))


def path_groups(lines: DataFrame, precision: float, tolerance: float) -> DataFrame:
    """fid, path: lines of one pair of end cells that run like the least of them, which names the path.

    In rounds: the least line left of each pair of cells leads, those like it follow; as many rounds as a pair has paths.
    """
    left, done = written(edges(lines, precision).select("fid", "u", "v", "pts")), None
    while not left.isEmpty():
        leaders = written(left.groupBy("u", "v").agg(F.min_by(F.struct("fid", "pts"), "fid").alias("lead")))
        met = left.join(leaders, ["u", "v"]).withColumn("like", (F.col("fid") == F.col("lead.fid")) | similar(F.col("lead.pts"), F.col("pts"), tolerance))
        met = written(met.select("fid", "u", "v", "pts", "like", F.col("lead.fid").alias("path")))
        found = met.filter("like").select("fid", "path")
        done = found if done is None else done.union(found)
        left = met.filter("NOT like").select("fid", "u", "v", "pts")
    return done if done is not None else lines.select("fid", F.col("fid").alias("path")).limit(0)


def nodes(lines: DataFrame, precision: float) -> DataFrame:
    """Each end cell and its degree, counted over distinct edges; a loop counts once."""
    e = edges(lines, precision).select("u", "v").distinct()
    ends = e.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).select("node.ix", "node.iy", "degree")


def node_id(cell: Column, crs: str, precision: float) -> Column:
    return F.concat_ws(":", cell["ix"].cast("string"), cell["iy"].cast("string"), F.lit(crs), F.lit(str(float(precision))))


def centre(cell: Column, precision: float) -> Column:
    """The point that a cell's node stands at."""
    return g.point((cell["ix"] + F.lit(0.5).cast("double")) * F.lit(float(precision)), (cell["iy"] + F.lit(0.5).cast("double")) * F.lit(float(precision)))


def node_table(lines: DataFrame, precision: float, crs: str = "EPSG:4326") -> DataFrame:
    """node_id, ix, iy, precision, degree, point: a row for each end cell."""
    cell = F.struct("ix", "iy")
    return nodes(lines, precision).select(node_id(cell, crs, precision).alias("node_id"), "ix", "iy", F.lit(float(precision)).alias("precision"), "degree", centre(cell, precision).alias("point"))


def edge_table(lines: DataFrame, precision: float, crs: str = "EPSG:4326") -> DataFrame:
    """edge_key, node_a, node_b, their points, feature_count, feature_indices, and the geometry and attributes of the first line of each pair of end cells."""
    rest = [c for c in lines.columns if c != "fid"]
    grouped = edges(lines, precision).groupBy("u", "v").agg(F.count("*").alias("feature_count"), F.array_sort(F.collect_list("fid")).alias("feature_indices"), F.min_by(F.struct(*rest), "fid").alias("first"))
    a, b = node_id(F.col("u"), crs, precision), node_id(F.col("v"), crs, precision)
    named = grouped.select(F.concat(a, F.lit(" <-> "), b).alias("edge_key"), a.alias("node_a"), b.alias("node_b"), centre(F.col("u"), precision).alias("point_a"), centre(F.col("v"), precision).alias("point_b"), "feature_count", "feature_indices", "first")
    return named.select(*named.columns[:-1], "first.*")


def incident_edges(lines: DataFrame, precision: float, ix: int, iy: int) -> DataFrame:
    """u, v of the edges that touch one node."""
    cell = F.struct(F.lit(ix).cast("long").alias("ix"), F.lit(iy).cast("long").alias("iy"))
    return edges(lines, precision).filter((F.col("u") == cell) | (F.col("v") == cell)).select("u", "v").distinct()


def duplicates(lines: DataFrame, precision: float) -> DataFrame:
    """u, v, feature_count of the pairs of end cells that more than one line has."""
    return edges(lines, precision).groupBy("u", "v").agg(F.count("*").alias("feature_count")).filter("feature_count > 1")


def topology(lines: DataFrame, precision: float) -> DataFrame:
    """One row; the edges are made once, and the nodes from them."""
    groups = edges(lines, precision).groupBy("u", "v").agg(F.count("*").alias("k"))
    ends = groups.select("k", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), (F.col("u") == F.col("v")).alias("loop"))
    e = groups.agg(F.count("*").alias("edges"), F.count_if(F.col("k") > 1).alias("duplicate_edges"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("duplicate_features"))
    n = ends.groupBy("node").agg(F.count("*").alias("degree")).agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 1).alias("degree_1"), F.count_if(F.col("degree") == 2).alias("degree_2"), F.count_if(F.col("degree") >= 3).alias("degree_3_plus"), F.max("degree").alias("max_degree"))
    return e.crossJoin(n)  # one row each


def spacing_bounds(lines: DataFrame) -> dict[str, float] | None:
    """Percentiles of vertex spacings (zeros left out) and line lengths, and the bounds that follow from them; None without a spacing."""
    spacings = quantiles(lines.select(F.explode(g.spacings(F.col("pts"))).alias("d")).filter("d > 0"), "d", (0.05, 0.5))
    if spacings is None:
        return None
    (p05, p50), (l50,) = spacings, quantiles(lines.select(g.length(F.col("pts")).alias("len")), "len", (0.5,))
    return {"p05": p05, "p50": p50, "l50": l50, "snap_min": p05 * 0.25, "snap_max": p50 * 0.75, "prune_max": p50 * 0.1}


def components(lines: DataFrame, digits: int = 8) -> DataFrame:
    """fid, component: lines that meet at ends, rounded, named by the least fid."""
    ends = lines.select("fid", F.explode(F.array_distinct(F.array(g.rounded(g.start(F.col("pts")), digits), g.rounded(g.end(F.col("pts")), digits)))).alias("node"))
    first = ends.groupBy("node").agg(F.min("fid").alias("b"))
    found = connected_components(ends.join(first, "node").select(F.col("fid").alias("a"), "b"))
    return lines.select("fid").join(found, F.col("fid") == F.col("id"), "left").select("fid", F.coalesce("component", "fid").alias("component"))


def small_components(lines: DataFrame, features: int = 1, min_length: float = 5.0, digits: int = 8) -> DataFrame:
    """component, n, len of the components that have too few lines or too little length."""
    labelled = lines.select("fid", g.length(F.col("pts")).alias("len")).join(components(lines, digits), "fid")
    return labelled.groupBy("component").agg(F.count("*").alias("n"), F.sum("len").alias("len")).filter((F.col("n") < features) | (F.col("len") < min_length))


def remove_small_components(lines: DataFrame, features: int = 1, min_length: float = 5.0, digits: int = 8) -> DataFrame:
    """Lines of components with enough lines and enough length."""
    labelled = written(components(lines, digits))
    sizes = lines.select("fid", g.length(F.col("pts")).alias("len")).join(labelled, "fid").groupBy("component").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    kept = labelled.join(sizes.filter((F.col("n") >= features) & (F.col("len") >= min_length)), "component", "left_semi")
    return lines.join(kept, "fid", "left_semi")


def prune_short(lines: DataFrame, epsilon: float) -> DataFrame:
    return lines.filter(g.length(F.col("pts")) >= epsilon) if epsilon > 0 else lines


def degree2_nodes(lines: DataFrame, digits: int = 8) -> DataFrame:
    """Ends, rounded, at which exactly two line ends meet: x, y, fids."""
    r = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    ends = lines.select("fid", F.explode(F.array(r(g.start(F.col("pts"))), r(g.end(F.col("pts"))))).alias("p"))
    return ends.groupBy("p").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"), F.max("fid").alias("last_fid")).filter("n = 2").select("p.x", "p.y", "first_fid", "last_fid")


def merge_attribute(lines: DataFrame, key: str, field: str) -> DataFrame:
    """For each key the distinct values of a field in input order, joined by commas; a value that holds one is quoted, but for numbers.

    Values are made distinct before they are gathered, so a key's list is as long as its distinct values.
    """
    v = F.col(field).cast("string")
    once = lines.select(key, "fid", v.alias("_v")).groupBy(key, "_v").agg(F.min("fid").alias("_first"))
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_first", "_v")))), lambda s: s["_v"])
    quote = dict(lines.dtypes)[field] == "string"
    quoted = F.transform(F.col("vs"), lambda x: F.when(x.contains(",") & F.lit(quote), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return once.groupBy(key).agg(values.alias("vs")).select(key, F.when(F.size("vs") == 1, F.col("vs")[0]).when(F.size("vs") > 1, F.array_join(quoted, ",")).alias(field))
