"""Stupid-backoff scores from corpus-wide bigram and unigram counts.

Counts are kept by hash shard and whole 64-bit hash (`lookup.answers`); each document meets the counts
of its own n-grams there. A document's own n-grams are not counted for it, so a
text is scored by the rest of the corpus: with c' for such counts, a word w
after v scores c'(v w) / c'(v) if the rest has the bigram, else ALPHA * (c'(w) + 1) /
(N' + 1). The score is the mean of the logs.

Defined results: words are lower-cased runs without white space; the first word
of a text backs off; a text without words, or null, has 0 words and a null
score; repeated rows count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookup
from . import textscan as ts

ALPHA = 0.4
_SALT = np.uint64(0xA24BAED4963EE407)


def _keys(s: ts.Scan) -> np.ndarray:
    """Every word, then every bigram."""
    return np.concatenate([s.hash, ts.mix(s.windows(2)[1] ^ _SALT)])


def scores(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_backed (words that backed off), score (mean natural log)."""
    words = docs.agg(F.sum(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0

    def finish(rows: pa.RecordBatch, total: np.ndarray) -> pa.Table:
        s = ts.scan(rows.column(1), lower=True)
        n, keys = len(s.hash), _keys(s)
        at, _ = s.windows(2)
        doc = np.concatenate([s.doc, s.doc[at]])
        _, same, own = np.unique(ts.mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        rest = total.astype(np.int64) - own[same]
        per_doc = np.diff(s.first)
        single, double = rest[:n], rest[n:]
        # by default a word backs off
        logs = np.log(alpha * (np.maximum(single, 0) + 1) / (np.maximum(words - per_doc[s.doc], 0) + 1)) if n else np.zeros(0)
        backed = np.ones(n, bool)
        good = (double > 0) & (single[at] > 0)
        logs[at[good] + 1] = np.log(double[good] / single[at[good]])
        backed[at[good] + 1] = False
        m = rows.num_rows
        sums = np.bincount(s.doc, logs, m)
        mean = pa.array(sums / np.maximum(per_doc, 1), mask=per_doc == 0)
        return pa.Table.from_arrays([rows.column(0), pa.array(per_doc.astype(np.int64)), pa.array(np.bincount(s.doc[backed], minlength=m)), mean], ["doc_id", "n_words", "n_backed", "score"])

    return lookup.answers(docs, _keys, lambda total, own, first: np.minimum(total, 2**32 - 1), np.uint32, finish, "doc_id long, n_words long, n_backed long, score double", lower=True, wide=True)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
t AS (SELECT doc_id, n, i, ws[i] AS x, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY doc_id, x) AS cx,
    count(*) OVER (PARTITION BY v, x) - count(*) OVER (PARTITION BY doc_id, v, x) AS cvx, count(*) OVER () - n AS rest FROM t),
l AS (SELECT c.*, lag(cx) OVER (PARTITION BY doc_id ORDER BY i) AS cv FROM c),
s AS (SELECT doc_id, v IS NULL OR cvx = 0 OR cv = 0 AS b, CASE WHEN v IS NULL OR cvx = 0 OR cv = 0 THEN ln(0.4 * (cx + 1) / (rest + 1)) ELSE ln(cvx / cv) END AS lg FROM l)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(sum(b::INT), 0)::BIGINT AS n_backed, round(avg(lg), 6) AS score FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, ws
"""


def digest(docs: DataFrame) -> DataFrame:
    return scores(docs).withColumn("score", F.round("score", 6))
