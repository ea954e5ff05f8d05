"""Mixing sources to target weights by systematic sampling.

Every document expects `target / source_size` copies. Within its source the
expected copies are summed up along an order of documents, one random offset is
added, and a document is emitted once for each whole number that the sum
crosses on it. The order goes by size class, so short and long documents are
taken evenly and a source's words come near its target.

The running sum is the document's place times the expected copies. The place
comes from counts of small slices of a source (size class, hash of the id and the text)
plus the place within the slice, so a source that holds most rows is spread over
all tasks, also where many rows share an id or have none; no window spans a source.

Defined results: a null text has size 0; a source of size 0 has target 0 and
nothing is taken; a null source is one source, weighed last; equal documents and
repeated ids are separate rows, ordered by (size, hash, id); an empty table
gives an empty result. The same input gives the same mix: the offset depends on
the seed and the source's name alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, session, unused, written

#: Slices of each (source, size class); a slice is what one task orders.
SLICES = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Targets stop at this many times their source's size.
MOST = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sources: source, source_size, one row each. Adds target.

    Shares of the whole by weight, none above `most` times its source's size: the
    sources are ordered by that bound per weight; the first k are held at their
    bounds and the rest share what remains, for the least k that breaks no bound.
    One row per source, so the windows here are small.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    by_bound = Window.orderBy("bound_per_weight", F.col("source").isNull(), "source")
    before, after = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("bound", F.lit(float(most)) * F.col("source_size")).withColumn("bound_per_weight", F.col("bound") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("bound_per_weight"), F.col("level")))
    share = F.first("fits", ignorenulls=True).over(by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("share", share).select("source", "source_size", F.least("bound", F.coalesce(F.col("share") * F.col("weight"), F.col("bound"))).alias("target"))


def _offset(seed: int):
    """In [0, 1), a multiple of 2 ** -20, so that whole sums stay exact."""
    return F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _sliced(docs: DataFrame, source_col: str, text_col: str, id_col: str, seed: int, own: list[str]) -> DataFrame:
    """doc_id, source, size, h, class, slice of each document, and the columns `own`."""
    # written, as three steps follow from it and the words of a text are counted once
    sized = written(docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"),
        *own,
    ))
    # eight classes an octave
    return sized.select("*", F.floor(F.log2(F.col("size") + 1) * 8).cast("int").alias("class"), F.pmod("h", F.lit(SLICES)).cast("int").alias("slice"))


def copies(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: int = 1, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per document. row_col: a unique column to keep, which orders rows that share an id."""
    own = [row_col] if row_col else []
    session(docs)
    sized = _sliced(docs, source_col, text_col, id_col, seed, own)
    slices = sized.groupBy("source", "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    classes = slices.groupBy("source", "class").agg(F.sum("n").alias("class_n"), F.sum("size").alias("class_size"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = classes.withColumn("class_before", F.coalesce(F.sum("class_n").over(before(Window.partitionBy("source").orderBy("class"))), F.lit(0)))
    goals = targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights)
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    per_class = first.alias("f").join(goals.alias("g"), F.expr("f.source <=> g.source")).select("f.source", "f.class", "class_before", "source_size", "target")
    s = slices.withColumn("slice_before", F.coalesce(F.sum("n").over(before(Window.partitionBy("source", "class").orderBy("slice"))), F.lit(0)))
    places = s.alias("s").join(per_class.alias("c"), F.expr("s.source <=> c.source AND s.class = c.class")).select("s.source", "s.class", "s.slice", (F.col("class_before") + F.col("slice_before")).alias("before"), "source_size", "target")
    placed = sized.alias("d").join(places.alias("p"), F.expr("d.source <=> p.source AND d.class = p.class AND d.slice = p.slice")).select("d.*", "p.before", "p.source_size", "p.target")
    within = Window.partitionBy("source", "class", "slice").orderBy("size", "h", "doc_id", *own)
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    numbered = placed.withColumn("place", F.col("before") + F.row_number().over(within)).withColumn("each", per_doc)
    crossed = F.floor(F.col("place") * F.col("each") + _offset(seed)) - F.floor((F.col("place") - 1) * F.col("each") + _offset(seed))
    return numbered.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.ceil("each")).cast("long").alias("copies"), *own)


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as often as it is taken, with all their columns, whatever their names.

    Rows are matched by a private key, so null and repeated ids are rows of their own.
    """
    numbered, key = keyed(docs)
    at, times, copy = unused(numbered, "taken_key"), unused(numbered, "copies"), unused(numbered, "copy")
    taken = copies(numbered, id_col=id_col, row_col=key, **options).filter("copies > 0").select(F.col(key).alias(at), F.col("copies").cast("int").alias(times))
    joined = numbered.join(taken, F.col(key) == F.col(at))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
