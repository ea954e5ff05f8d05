"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. Bit i of `failed` says that rule i
failed; the measurements stand beside it. A policy is a named, versioned mask
over the bits: applying one, or asking what each rule alone costs, needs no
second look at a text.

Defined results: a null text counts as empty (no words, no lines, fails
`few_words`); a null or repeated doc_id is carried as it is, one row per input
row; an empty table gives an empty ledger; other columns are ignored by
`ledger` and carried by `apply_policy`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .common import ids_and_text, session, unused

#: name, and the failure test as SQL over the measurements. All in whole numbers. A rule's bit is its place here.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


BASE = mask("few_words", "repeated_windows")
#: Policies never change once named; a new one gets a new version.
POLICIES = {"v1": BASE, "v2": mask(*BIT)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_RAW = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[hi] - total[lo]


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have the hash of another entry of the same text."""
    key = ts.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    s = ts.scan(column)
    n, lo, hi = len(s.off) - 1, s.off[:-1], s.off[1:]
    words = np.diff(s.first)
    chars = _sums(((s.data & 0xC0) != 0x80) & ~ts.SPACE[s.data], lo, hi)
    symbols = _sums(_SYMBOL[s.data], lo, hi)

    # lines that hold a word; equal lines of one text have one hash
    cut = np.flatnonzero(s.data == 10)
    starts = np.concatenate([lo, cut + 1])
    ends = np.concatenate([cut, hi])
    starts.sort()
    ends.sort()
    held = np.searchsorted(s.start, ends) > np.searchsorted(s.start, starts)
    starts, ends = starts[held], ends[held]
    doc = np.searchsorted(s.off, starts, side="right") - 1
    total = np.zeros(len(s.data) + 1, np.uint64)
    np.cumsum(_RAW[s.data] * ts._power(ts._BASE, len(s.data))[: len(s.data)], out=total[1:])
    line = ts.mix((total[ends] - total[starts]) * ts._power(ts._BASE_INV, len(s.data) + 1)[starts])
    lines = np.bincount(doc, minlength=n)
    _, first = np.unique(ts.mix(line + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    dup_lines = lines - np.bincount(doc[first], minlength=n)

    at, h = s.windows(3)
    again = at[_repeats(s.doc[at], h)] if len(at) else at
    covered = np.zeros(len(s.start), bool)
    for j in range(3):
        covered[again + j] = True
    repeat_words = np.bincount(s.doc[covered], minlength=n)
    return dict(zip(MEASURES, (words, chars, symbols, dup_lines, repeat_words, lines), strict=True))


_FIELDS = [T.StructField(m, T.LongType()) for m in MEASURES]


def _bits() -> Column:
    return F.expr(" | ".join(f"IF({test}, {1 << i}L, 0L)" for i, (_, test) in enumerate(RULES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`, the mask of the rules that failed. No shuffle."""
    session(docs)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ts.pieces(batches, "text"):
            got = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, schema).withColumn("failed", _bits())


def verdict(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows that a policy keeps, with all their columns; one pass, no join."""
    session(docs)
    names = [unused(docs, f"__{m}") for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ts.pieces(batches, text_col):
            got = measure(b.column(b.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], [*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    renamed = docs.mapInArrow(run, schema)
    named = dict(zip(MEASURES, names, strict=True))
    test = lambda t: re.sub(r"[a-z_]+", lambda m: f"`{named[m[0]]}`" if m[0] in named else m[0], t)
    bits = F.expr(" | ".join(f"IF({test(t)}, {1 << i}L, 0L)" for i, (_, t) in enumerate(RULES)))
    return renamed.filter(verdict(bits, policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (and so come back without it), and all that the policy rejects.

    The ledger is first summed by its mask, so at most 2 ** rules rows are shuffled.
    """
    bits = POLICIES[policy]
    sums = book.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("failed")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if bits >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")
    return (
        sums.select("failed", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
            F.sum(F.when(F.col("failed") != 0, F.col("n")).otherwise(0)).alias("rejected"),
        )
    )


def digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        verdict(F.col("failed"), policy).alias("kept"),
        "failed",
    )


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS rid FROM documents),
m AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM m LEFT JOIN c USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
