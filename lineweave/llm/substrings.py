"""Removal of passages that repeat, by MinHash banding of paragraphs.

A paragraph is a line of LEAST words or more; it has a set of five-word shingles,
and eight bands of two MinHash values make pairs of 0.75 collide with probability
0.998. Paragraphs that collide are joined, the exact Jaccard similarity decides, and
components of what links are removed but for their first paragraph.

A passage that repeats inside longer lines, or over several, is no paragraph of its
own. It is found by its stretches of SPAN words, which start where a five-word hash
is the least among REACH neighbours, a choice that depends on these words alone.
Stretches that stand elsewhere too are put together where no more than GAP words part
them, as a changed word does; together they are a passage if it reaches over LEAST
words. So every passage of LEAST + 2 * (REACH - 1) words or more that stands
elsewhere word for word is found, less at most REACH - 1 words at either end, and
nothing shorter than LEAST words is touched. Of a stretch the first occurrence, in
the order in which the documents are read, stays.

Every band key and every stretch is first counted in the whole corpus, packed by
chunk (`lookup.answers`), by its whole 64-bit hash; the answer says too whether a
chunk is the first to hold it, so stretches never become rows. Paragraphs that stand
alone in all their keys can link with nothing and are left out; only the rest become
rows. Equal paragraphs are one to begin with, as are buckets of equal members. Small
buckets are searched many at a time; in a large one the least paragraph meets the
others first, and then only blocks of different components meet.

Defined results: a null text has no passages; one row for each occurrence, the first
included (removed is false), also for repeated or null ids, as rows are known by
their place in the input; offsets are in bytes, end exclusive; passages and
paragraphs of one text may overlap, and `clean` takes away what any removed one
covers; an empty table gives an empty result; other columns are ignored by `repeats`
and carried by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import connected_components
from . import lookup
from . import textscan as ts
from .common import session, unused, written
from .jaccard import BLOCK, family_links, verified

WORDS, LEAST, BANDS, ROWS, THRESHOLD = 5, 36, 8, 2, 75
SPAN, REACH, GAP = 12, 8, 16
_RNG = np.random.Generator(np.random.PCG64(11))
_SALTS = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64) | np.uint64(1)
_COEF = _RNG.integers(1, 2**63, SPAN).astype(np.uint64) | np.uint64(1)
ALONE, HERE, ELSEWHERE = 0, 1, 2


def _slide(x: np.ndarray, k: int, op: np.ufunc) -> np.ndarray:
    """op over each k neighbours of x."""
    have = 1
    while 2 * have <= k:
        x, have = op(x[:-have], x[have:]), 2 * have
    return op(x[: len(x) - (k - have)], x[k - have :]) if have < k else x


def _anchors(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some REACH neighbours of one text; of a run of equal hashes the first."""
    if len(h) < REACH:
        return np.zeros(0, np.int64)
    least = _slide(h, REACH, np.minimum)
    least[doc[: len(least)] != doc[REACH - 1 :]] = 0
    rim = np.zeros(REACH - 1, np.uint64)
    chosen = _slide(np.concatenate([rim, least, rim]), REACH, np.maximum) == h
    chosen[1:] &= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(chosen)


class Marked:
    """Paragraphs and stretches of a scan: a, z (words), x, which (shingles and their paragraphs), bands; span (first words), span_hash."""

    def __init__(self, s: ts.Scan):
        at, h = s.windows(WORDS)
        cut = np.zeros(len(s.start) + 1, bool)
        cut[s.first] = True
        cut[np.searchsorted(s.start, np.flatnonzero(s.data == 10))] = True
        edges = np.flatnonzero(cut)
        good = np.diff(edges) >= LEAST
        self.a, self.z = edges[:-1][good], edges[1:][good]
        place = np.full(len(s.start) + 1, -1)
        place[at] = np.arange(len(at))
        size = self.z - self.a - WORDS + 1
        begin = np.cumsum(size) - size
        self.which = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(self.which)) - begin[self.which]
        self.x = h[place[self.a][self.which] + inside]
        low = [np.minimum.reduceat(self.x * v, begin) if len(begin) else np.zeros(0, np.uint64) for v in _SALTS]
        self.bands = np.stack([ts.mix(low[ROWS * k] * np.uint64(3) + low[ROWS * k + 1] + np.uint64(k)) for k in range(BANDS)], axis=1)
        self.inside, self.begin = inside, begin
        span = at[_anchors(h, s.doc[at])]
        span = span[span + SPAN <= len(s.start)]
        self.span = span[s.doc[span] == s.doc[span + SPAN - 1]]
        total = np.zeros(len(self.span), np.uint64)
        for j in range(SPAN):
            total += s.hash[self.span + j] * _COEF[j]
        self.span_hash = ts.mix(total)

    def keys(self) -> np.ndarray:
        return np.concatenate([self.bands.ravel(), self.span_hash])


def _passages(s: ts.Scan, m: Marked, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, hash of its first stretch, removed) of the passages made of stretches that repeat."""
    span, h, elsewhere = m.span[held != ALONE], m.span_hash[held != ALONE], held[held != ALONE] == ELSEWHERE
    if not len(span):
        return span, span, h, elsewhere
    # of those that no earlier chunk holds, the first in this one stays
    once = np.zeros(len(span), bool)
    once[np.unique(h, return_index=True)[1]] = True
    gone = elsewhere | ~once
    new = np.ones(len(span), bool)
    new[1:] = (s.doc[span[1:]] != s.doc[span[:-1]]) | (span[1:] - span[:-1] > SPAN + GAP)
    group = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:], len(span)) - 1
    long = (span[last] + SPAN - span[new] >= LEAST)[group]
    span, h, gone = span[long], h[long], gone[long]

    def covered(some: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(s.start) + 1, np.int64)
        np.add.at(edge, some, 1)
        np.add.at(edge, some + SPAN, -1)
        return np.cumsum(edge) > 0

    # what a kept stretch covers stays; runs of words of one state within one text
    state = np.where(covered(span[~gone]), 1, np.where(covered(span[gone]), 2, 0))
    words = np.flatnonzero(state)
    if not len(words):
        return span[:0], span[:0], h[:0], gone[:0]
    cut = np.ones(len(words), bool)
    cut[1:] = (words[1:] != words[:-1] + 1) | (state[words[1:]] != state[words[:-1]]) | (s.doc[words[1:]] != s.doc[words[:-1]])
    a = words[cut]
    z = words[np.append(np.flatnonzero(cut)[1:], len(words)) - 1] + 1
    named = h[np.minimum(np.searchsorted(span, a), len(span) - 1)]
    return a, z, named, state[a] == 2


_ROWS = "row long, doc_id long, first long, last long, fp long, removed boolean, n long, bands array<bigint>, shingles binary"


def marks(docs: DataFrame) -> DataFrame:
    """Paragraphs that share a band with another (fp, n, bands, shingles; removed is null), and passages of stretches (fp, removed).

    docs: row, doc_id, text.
    """
    last: list[tuple[ts.Scan, Marked]] = []

    def keys(s: ts.Scan) -> np.ndarray:
        m = Marked(s)
        last[:] = [(s, m)]
        return m.keys()

    def respond(total: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.where(total < 2, ALONE, np.where(first, HERE, ELSEWHERE))

    def finish(rows: pa.RecordBatch, held: np.ndarray) -> pa.Table:
        s, m = last.pop()
        lines = (held[: m.bands.size] != ALONE).reshape(-1, BANDS).any(axis=1)
        mine = lines[m.which]
        which, x = (np.cumsum(lines) - 1)[m.which[mine]], m.x[mine]
        n_lines = int(lines.sum())
        begin = np.searchsorted(which, np.arange(n_lines))
        fp = ts.mix(np.add.reduceat(ts.mix(x + m.inside[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)) if n_lines else np.zeros(0, np.uint64)
        order = np.lexsort((x, which))
        x, which = x[order], which[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (which[1:] != which[:-1])
        x, which = x[new], which[new]
        a, z, named, removed = _passages(s, m, held[m.bands.size :])
        bounds = np.concatenate([np.searchsorted(which, np.arange(n_lines + 1)), np.full(len(a), len(x))])
        a, z = np.concatenate([m.a[lines], a]), np.concatenate([m.z[lines], z])
        d = s.doc[a]
        ends = np.minimum(np.arange(len(a) + 1), n_lines) * BANDS
        cols = [
            rows.column(0).take(pa.array(d)),
            rows.column(2).take(pa.array(d)),
            pa.array(s.start[a] - s.off[d]),
            pa.array(s.end[z - 1] - s.off[d]),
            pa.array(np.concatenate([fp, named]).view(np.int64)),
            pa.array(np.concatenate([np.zeros(n_lines, bool), removed]), mask=np.arange(len(a)) < n_lines),
            pa.array(np.diff(bounds)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(m.bands[lines].view(np.int64).ravel())),
            pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]),
        ]
        return pa.Table.from_arrays(cols, ["row", "doc_id", "first", "last", "fp", "removed", "n", "bands", "shingles"])

    source = docs.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    return lookup.answers(source, keys, respond, np.uint8, finish, _ROWS, lower=True, wide=True, carry=("id",))


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id, first, last, component_id, removed, kept_row. docs: row, doc_id, text."""
    found = written(marks(docs))
    lines = found.filter("removed IS NULL")
    kinds = written(lines.groupBy("fp").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("shingles").alias("shared")))
    sets = kinds.select(F.col("fp").alias("doc_id"), "n", "shared")
    banded = kinds.select("fp", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("fp").alias("pivot"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("x"))
    pivots = written(buckets.filter("m > 1"))
    members = written(banded.join(pivots, ["band", "key"]).select(F.xxhash64("x", "m", "pivot").alias("family"), "fp", "pivot", "m").distinct())

    # large buckets: the least paragraph meets the others, which makes most of the components
    pairs = written(members.filter((F.col("m") > BLOCK) & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct())
    stars = written(verified(pairs, sets, THRESHOLD))
    comps = written(connected_components(stars))
    now = members.join(comps, F.col("fp") == F.col("id"), "left").select(F.col("fp").alias("doc"), F.coalesce("component", "fp").alias("comp"), "family", "m")
    bodies = written(now.join(sets, F.col("doc") == F.col("doc_id")).select("doc", "n", "shared", "comp", "family", "m"))
    links = stars.union(family_links(bodies, members.count(), THRESHOLD))
    comps = written(connected_components(links))
    named = kinds.select("fp", "copies").join(comps, F.col("fp") == F.col("id"), "left").select("fp", "copies", F.coalesce("component", "fp").alias("component_id"))
    sizes = named.groupBy("component_id").agg(F.sum("copies").alias("size")).filter("size > 1")
    kept = written(named.join(sizes, "component_id").select("fp", "component_id"))
    rows = lines.select("row", "doc_id", "first", "last", "fp").join(kept, "fp")
    head = written(rows.groupBy("component_id").agg(F.min(F.struct("row", "first", "doc_id")).alias("head")))
    near = rows.join(head, "component_id").select("row", "doc_id", "first", "last", "component_id", (F.struct("row", "first", "doc_id") != F.col("head")).alias("removed"), F.lit("paragraph").alias("kind"))
    exact = found.filter("removed IS NOT NULL").select("row", "doc_id", "first", "last", F.col("fp").alias("component_id"), "removed", F.lit("passage").alias("kind"))
    return near.union(exact)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, last, component_id, removed, kind: every passage that repeats. kind: paragraph (near copies, a component each) or passage (equal words)."""
    return _found(_keyed(docs, id_col, text_col)).drop("row")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without what `repeats` removes. A null text stays null."""
    session(docs)
    key = unused(docs, "row")
    numbered = docs.withColumn(key, F.monotonically_increasing_id())
    numbered = written(numbered)
    found = _found(numbered.select(F.col(key).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).filter("removed")
    cuts, joined = unused(docs, "cuts"), unused(docs, "cut_row")
    per_row = found.groupBy(F.col("row").alias(joined)).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(cuts))
    both = numbered.join(per_row, F.col(key) == F.col(joined), "left").drop(key, joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ts.pieces(batches, text_col):
            at = b.schema.get_field_index(text_col)
            texts = [without(t, c) for t, c in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return both.mapInArrow(run, T.StructType(docs.schema.fields))


def without(text: str | None, cuts: list[dict] | None) -> str | None:
    """The text less the given ranges of its bytes, which may overlap."""
    if text is None or not cuts:
        return text
    raw, at, out = text.encode(), 0, []
    for c in cuts:
        out.append(raw[at : max(at, c["first"])])
        at = max(at, c["last"])
    return b"".join([*out, raw[at:]]).decode()
