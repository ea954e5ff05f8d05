"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct shingles of five lower-cased words. Two
documents link when their sets' Jaccard similarity is at least THRESHOLD percent.

1. Every shingle's document count comes from the corpus (`lookup.answers`).
2. A pair that links shares one of the rarest shingles of each: with n
   shingles, one of the first n - ceil(t n) + 1 in the order (count, hash). A
   document whose first ones all stand in it alone links with nothing; the others
   keep their shared shingles and enter their rarest ones in inverted lists.
   Documents of one set are one class from here on.
3. Documents that share a list, directly or through others, are a family; no
   link leaves one. A family's documents are searched against each other by
   T-occurrence search (DivideSkip): of a query's inverted lists the longest are
   probed by binary search and the rest merged, and the documents that reach the
   overlap that their sizes require are links.
4. A family of more than BLOCK documents is first searched from the least
   document of each list; the links make components, and then only blocks of
   different components meet, pair by pair, each pair of blocks in a task.

Links make components; step 4 is for these alone, and `join` returns every link. Nothing here holds a whole family or all pairs of one.

Defined results: fewer than five words make one shingle, the whole sequence; no
words, or a null text, make the empty set, which links with nothing; equal
texts link; a null or repeated doc_id is a row of its own, and rows that share an
id share its component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from . import lookup
from . import textscan as ts
from .common import written

WORDS, THRESHOLD = 5, 75
#: Documents of a block, and candidates of one query that a task takes at once.
BLOCK = 256


def doc_sets(s: ts.Scan, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each text's distinct shingles, by text, then shingle."""
    at, h = s.windows(words)
    doc = s.doc[at]
    count = np.diff(s.first)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, np.array([s.whole(i) for i in few.tolist()], np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def required(n, m, threshold: int = THRESHOLD):
    """Least overlap of sets of n and m that reaches the threshold: o / (n + m - o) >= t."""
    return -(-threshold * (n + m) // (100 + threshold))


_SETS = "doc_id long, n long, a long, b long, shared binary, prefix array<bigint>"


def shared_sets(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Each document: n shingles, a fingerprint (a, b) of the set, and for those that may link the shared shingles and the rarest of them."""

    def respond(total: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.where(total < 128, total, np.minimum(255, 100 + 4 * np.log2(np.maximum(total, 1)).astype(np.int64)))

    def finish(rows: pa.RecordBatch, rank: np.ndarray) -> pa.Table:
        doc, h = doc_sets(ts.scan(rows.column(1), lower=True), words)
        n_docs = rows.num_rows
        bounds = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.diff(bounds)
        sums = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(ts.mix(h ^ np.uint64(salt)), out=total[1:])
            sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        alone = np.zeros(len(h) + 1, np.int64)
        np.cumsum(rank <= 1, out=alone[1:])
        alone = alone[bounds[1:]] - alone[bounds[:-1]]
        first = n + (-threshold * n // 100) + 1  # n - ceil(t n) + 1
        shared, prefix = [None] * n_docs, [None] * n_docs
        for i in np.flatnonzero((n > 0) & (alone < first)).tolist():
            mine, r = h[bounds[i] : bounds[i + 1]], rank[bounds[i] : bounds[i + 1]]
            known = r > 1
            mine, r = mine[known], r[known]
            shared[i] = mine.tobytes()
            prefix[i] = mine[np.lexsort((mine, r))[: first[i] - alone[i]]].view(np.int64)
        return pa.Table.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(shared, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "a", "b", "shared", "prefix"])

    return lookup.answers(docs, lambda s: doc_sets(s, words)[1], respond, np.uint8, finish, _SETS, lower=True)


class Lists:
    """Inverted lists over some sets of shingles, for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.which = flat[order], which[order]  # each list in order of the sets
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.token, self.n = flat[first], len(sets)
        self.bounds = np.concatenate([first, [len(flat)]])

    def search(self, query: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The sets i that share at least need[i] shingles with the query, by DivideSkip.

        The query's lists are divided: so many of the longest are left out that a set
        which reaches its need must still stand in one of the others often enough. Those
        are merged; for the sets that then may still reach it the long lists are probed.
        """
        at = np.searchsorted(self.token, query)
        inside = at < len(self.token)
        at, query = at[inside], query[inside]
        at = at[self.token[at] == query]
        lo, hi = self.bounds[at], self.bounds[at + 1]
        length = hi - lo
        order = np.argsort(length, kind="stable")
        least = int(need.min())
        longest = int(length[order[-1]]) if len(order) else 0
        n_long = min(max(0, least - 1), int(least / (0.01 * np.log2(max(2, longest)) + 1)), int((length > 64).sum()))
        short = order[: len(order) - n_long]
        sizes = length[short]
        ends = np.cumsum(sizes)
        places = np.repeat(lo[short] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        count = np.bincount(self.which[places], minlength=self.n)
        open_ = np.flatnonzero(count >= np.maximum(1, need - n_long))
        for t in order[len(order) - n_long :].tolist():
            if not len(open_):
                break
            posting = self.which[lo[t] : hi[t]]
            place = np.minimum(np.searchsorted(posting, open_), len(posting) - 1)
            count[open_] += posting[place] == open_
        return open_[count[open_] >= need[open_]]


class Unions:
    """Components of numbered things; equal labels are one to begin with."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b) of ids that link. sets: doc_id, n, shared."""
    load = written(pairs.groupBy("a").agg(F.count("*").alias("load")))
    salted = written(pairs.join(load, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("load") / BLOCK)).cast("int")).select("a", "salt", "b"))
    asked = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("doc_id")).select("a", "salt", "n", "shared")
    given = salted.join(sets, F.col("b") == F.col("doc_id"))
    given = given.select(*[F.col(c).alias(c) for c in ("a", "salt", "b", "n", "shared")])  # new columns, apart from those of asked

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query, n = np.frombuffer(left.column("shared")[0].as_buffer(), np.uint64), left.column("n")[0].as_py()
        m, ids = right.column("n").to_numpy(), right.column("b").to_numpy()
        got = Lists([np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("shared")]).search(query, required(n, m, threshold))
        return pa.Table.from_arrays([pa.array(np.full(len(got), left.column("a")[0].as_py(), np.int64)), pa.array(ids[got])], ["a", "b"])

    return asked.groupBy("a", "salt").cogroup(given.groupBy("a", "salt")).applyInArrow(search, "a long, b long")


def _search_blocks(threshold: int, every: bool = False):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links of the rows of block i with those of block j; without every, only those that join two components."""
        table = table.sort_by([("doc", "ascending")])
        doc, n, comp, block = (table.column(c).to_numpy() for c in ("doc", "n", "comp", "block"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shared")]
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        known = Unions(comp)
        lists = Lists([sets[k] for k in right.tolist()])
        found: list[tuple[int, int]] = []
        for k in left.tolist() if len(right) else ():
            need = required(n[k], n[right], threshold)
            for y in right[lists.search(sets[k], need)].tolist():
                if doc[k] != doc[y] if every else known.join(k, y):
                    found.append((doc[k], doc[y]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def family_links(rows: DataFrame, total: int, threshold: int, every: bool = False) -> DataFrame:
    """Links (a, b) between different components of one family; with every, all of them, for rows that are a component each.

    rows: doc, n, shared, comp, family, m (the family's size); total of them. A document may be in several families.
    """
    # small families are searched many at a time, large ones block by block, but for blocks within one component
    groups = max(1, total // (4 * BLOCK))
    small = rows.filter(F.col("m") <= BLOCK).select((-1 - F.pmod(F.xxhash64("family"), F.lit(groups))).alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), "doc", "n", "shared", "comp", F.lit(0).alias("block"))
    big = written(rows.filter(F.col("m") > BLOCK))
    counts = written(big.groupBy("family", "comp").agg(F.count("*").alias("c")))
    # a component that fills blocks has its own; the rest of a family shares blocks
    home = F.when(F.col("c") >= BLOCK, F.col("comp"))
    block = F.pmod(F.xxhash64("doc"), F.ceil(F.coalesce(F.when(F.col("c") >= BLOCK, F.col("c")), "m") / BLOCK))
    own = big.join(counts, ["family", "comp"]).withColumn("home", home).withColumn("block", F.pmod(F.xxhash64("home", block), F.lit(1 << 30)).cast("int"))
    own = written(own.select("family", "doc", "n", "shared", "comp", "home", "block"))
    blocks = written(own.select("family", "home", "block").distinct())
    again = blocks.select(F.col("family").alias("f"), F.col("home").alias("h"), F.col("block").alias("k"))
    meets = blocks.join(again, F.expr("family = f AND block <= k AND NOT (home IS NOT NULL AND home <=> h)")).select("family", F.col("block").alias("i"), F.col("k").alias("j")).distinct()
    sides = written(meets.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    dealt = own.join(sides, ["family", "block"]).select(F.col("family").alias("bucket"), "i", "j", "doc", "n", "shared", "comp", "block")
    found = small.union(dealt).groupBy("bucket", "i", "j").applyInArrow(_search_blocks(threshold, every), "a long, b long")
    return written(found)


def join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, class_id; links: a, b between class ids).

    A class is the documents of one set, named by its least id. The links are all pairs of
    classes that link, once each, a < b. With every=False a link within a component may be
    left out, which is enough for the components and spares a large family most of its pairs.
    """
    sets = written(shared_sets(docs, words, threshold))
    may = sets.filter("shared IS NOT NULL")
    classes = written(may.groupBy("a", "b", "n").agg(F.min("doc_id").alias("class_id")))
    named = sets.filter("n > 0").join(classes, ["a", "b", "n"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    named = named.union(sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id")))
    # where ids repeat, an id may name several sets: it is then one node with each of them
    chosen = classes.select(F.col("class_id").alias("doc_id"), "a", "b", "n")
    heads = may.join(chosen, ["doc_id", "a", "b", "n"], "left_semi").dropDuplicates(["doc_id", "a", "b", "n"])
    lists = heads.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("doc"))
    pivots = lists.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("m")).filter("m > 1").select("key", "pivot")
    candidates = written(lists.join(pivots, "key").filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())

    # a family shares lists, directly or not, so every link lies within one
    family = written(connected_components(candidates))
    size = written(family.groupBy("component").agg(F.count("*").alias("m")))
    family = written(family.join(size, "component").select("id", F.col("component").alias("family"), "m"))
    bodies = written(heads.select("doc_id", "n", "shared").join(family, F.col("doc_id") == F.col("id")).select("doc_id", "n", "shared", "family", "m"))

    if every:
        rows = bodies.select(F.col("doc_id").alias("doc"), "n", "shared", F.col("doc_id").alias("comp"), "family", "m")
        return named, family_links(rows, family.count(), threshold, every=True).distinct()

    # large families: each list's least document is searched against the list, which makes most of the components
    large = family.filter(F.col("m") > BLOCK).select(F.col("id").alias("a"))
    stars = written(verified(candidates.join(large, "a", "left_semi"), bodies.filter(F.col("m") > BLOCK).select("doc_id", "n", "shared").dropDuplicates(["doc_id"]), threshold))
    comps = written(connected_components(stars))
    rows = bodies.join(comps, F.col("doc_id") == F.col("id"), "left").select(F.col("doc_id").alias("doc"), "n", "shared", F.coalesce("component", "doc_id").alias("comp"), "family", "m")

    return named, stars.union(family_links(rows, family.count(), threshold))


def components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    named, links = join(docs, words, threshold, every=False)
    comps = written(connected_components(links))
    # rows that share an id are one node
    same = named.filter("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    found = named.join(comps, F.col("class_id") == F.col("id"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return components(docs)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS x FROM w),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, least(s.doc_id, min(r.c))::BIGINT AS component_id FROM s LEFT JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, x
"""
