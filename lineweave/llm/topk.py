"""Exact top-k inner products on a bit-sliced index.

Rows are indexed in blocks. A block keeps each component as slices: bitmaps over
its rows, one for each bit of the component less the block's least value. Only the
KEPT highest bits are sliced; a sum of slices is then a bound, exact to the
query's largest possible remainder. For a query, every digit of every component
(signed digits, so few of them) asks for the slices of its component at its place;
the bitmaps of one place are added three at a time by full adders, whose carries
are bitmaps of the next place, until one slice of the scores is left at each place.
The top rows are selected from the most significant slice downward. Rows within
the remainder of the k-th bound are resolved exactly, in integers, as are ties.

Queries meet the index block by block: each pair of a block of rows and a block of
queries is a task's group, which holds these two alone, and only k rows a query and
block come back. The scores asked for are rows times queries, so the work grows with
both: where the queries are a fixed share of the rows, with the square of the rows.

Defined results: vectors that are null, or hold a null, a NaN or an infinity, and
rows with a null id take no part; whole components are exact whatever their size, and
a score beyond 64 bits is returned as the nearest 64-bit number; vectors of other
lengths than the query's are no candidates; ties go to the smaller id; repeated ids
are separate rows among the candidates; of query rows that share an id the least
vector is asked; no row is a candidate for its own id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session

#: Rows of a block of the index, queries of a block, and bits of a component that are sliced.
ROWS, QUERIES, KEPT = 1 << 15, 512, 6


def _digits(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, -1, 0 or 1 for each number) of the non-adjacent form."""
    v, j = v.astype(np.int64).copy(), 0
    while v.any():
        d = np.where(v & 1, 2 - (v & 3), 0)
        yield j, d
        v = (v - d) >> 1
        j += 1


class Block:
    """The index of some rows: ids (sorted) and whole components, [rows, components]."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kept: int = KEPT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.int64)
        n, self.dims = x.shape
        self.words = (n + 63) // 64
        above = self.x - self.x.min(axis=0) if self.x.size else self.x
        bits = int(above.max()).bit_length() if above.size else 0
        self.drop = max(0, bits - kept)
        self.bits = bits - self.drop
        above = above >> self.drop
        # slices[d * bits + b]: bit b of component d, a bitmap over rows
        slices = np.zeros((self.dims, self.bits, self.words), np.uint64)
        for b in range(self.bits):
            packed = np.packbits((above >> b & 1).astype(np.uint8), axis=0, bitorder="little")
            room = np.zeros((self.words * 8, self.dims), np.uint8)
            room[: len(packed)] = packed
            slices[:, b, :] = np.ascontiguousarray(room.T).view(np.uint64)
        self.slices = slices.reshape(-1, self.words)
        self.valid = np.zeros(self.words, np.uint64)
        whole = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.valid.view(np.uint8)[: len(whole)] = whole

    def sums(self, q: np.ndarray) -> np.ndarray:
        """Slices, [places, words], of sum(q * sliced bits) plus a number that is the same for every row.

        A negative digit asks for the complement of a slice, which is short of the negated slice by one for each row.
        """
        most = int(np.abs(q).sum()) << self.bits
        # signed digits may reach one place beyond the number's own, and their complements add as much again
        places: list[list[np.ndarray]] = [[] for _ in range(most.bit_length() + 3)]
        for j, d in _digits(q):
            plus, minus = np.flatnonzero(d == 1) * self.bits, np.flatnonzero(d == -1) * self.bits
            for b in range(self.bits):
                if len(plus):
                    places[j + b].append(self.slices[plus + b])
                if len(minus):
                    places[j + b].append(~self.slices[minus + b])
        out = np.zeros((len(places), self.words), np.uint64)
        for p, stacks in enumerate(places):
            if not stacks:
                continue
            rest = np.concatenate(stacks)
            while len(rest) > 1:
                k = len(rest) // 3
                if k:
                    a, b, c = rest[:k], rest[k : 2 * k], rest[2 * k : 3 * k]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    rest = np.concatenate([half ^ c, rest[3 * k :]])
                else:
                    carry = rest[:1] & rest[1:]
                    rest = rest[:1] ^ rest[1:]
                places[p + 1].append(carry)
            out[p] = rest[0]
            stacks.clear()
        return out

    def _select(self, slices: np.ndarray, k: int) -> np.ndarray:
        """Rows that hold the k highest sums, with all rows tied to the k-th, as a bitmap; from the most significant slice down."""
        sure, open_ = np.zeros(self.words, np.uint64), self.valid.copy()
        for s in slices[::-1]:
            high = open_ & s
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                open_ = high
            else:
                sure |= high
                open_ &= ~s
                if n == k:
                    return sure
        return sure | open_

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)])

    def _from(self, slices: np.ndarray, least: int) -> np.ndarray:
        """Rows whose sum is `least` or more, as a bitmap: a comparison from the most significant slice down."""
        above, equal = np.zeros(self.words, np.uint64), self.valid.copy()
        for b in range(len(slices) - 1, -1, -1):
            if least >> b & 1:
                equal &= slices[b]
            else:
                above |= equal & slices[b]
                equal &= ~slices[b]
        return above | equal

    @staticmethod
    def _values(slices: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w, b = rows >> 6, (rows & 63).astype(np.uint64)
        return sum(((s[w] >> b & np.uint64(1)).astype(np.int64) << i for i, s in enumerate(slices)), np.zeros(len(rows), np.int64))

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's id, ids, scores) of the k best rows for each query, exactly. Sums must fit 62 bits."""
        remainder = (1 << self.drop) - 1
        for own, mine in zip(query_ids.tolist(), q.astype(np.int64), strict=True):
            slices = self.sums(mine)
            same = int(np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left"))
            rows = self._rows(self._select(slices, k + same))
            # what the dropped bits can add and take away, together
            spread = int(np.abs(mine).sum()) * remainder
            if spread and len(rows):
                kth = int(np.sort(self._values(slices, rows))[-min(len(rows), k + same)])
                rows = self._rows(self._from(slices, max(0, kth - -(-spread >> self.drop))))
            rows = rows[self.ids[rows] != own]
            scores = self.x[rows] @ mine
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield own, self.ids[rows][best], scores[best]


def _large(row_ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As Block.top, for components whose sums may pass 62 bits: in Python's integers."""
    rows = [[int(v) for v in r] for r in x.tolist()]
    for own, mine in zip(query_ids.tolist(), q.tolist(), strict=True):
        mine = [int(v) for v in mine]
        scored = sorted((-sum(a * b for a, b in zip(r, mine, strict=True)), i) for r, i in zip(rows, row_ids.tolist(), strict=True) if i != own)[:k]
        yield own, np.array([i for _, i in scored], np.int64), np.array([min(2**63 - 1, max(-(2**63), -s)) for s, _ in scored], np.int64)


#: kind: the type of the components in body; vectors are packed with others of their length and kind.
_PACKED = "block int, dims int, kind string, ids binary, body binary"
_KINDS = ("i2", "i4", "f8")


def _whole(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and 256 times the vector; rows that take no part are gone."""
    scaled = F.transform(F.col(vector_col), lambda v: v.cast("double") * 256)
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.filter(F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled.alias("x"))


def _pack(df: DataFrame, blocks: int) -> DataFrame:
    """Blocks of rows of one length and kind each, as bytes. df: block, id, x."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, str], list[list[np.ndarray]]] = {}

        def out(key):
            ids, x = (np.concatenate(p) for p in zip(*held.pop(key), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "dims", "kind", "ids", "body"])

        for b in pieces:
            block, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            x = b.column(2)
            size = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
            flat = np.floor(x.flatten().to_numpy(zero_copy_only=False))
            start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            most = np.maximum.reduceat(np.abs(np.append(flat, 0.0)), start[:-1]) if len(x) else np.zeros(0)
            most[size == 0] = 0
            kind = np.where(most < 2**15, 0, np.where(most < 2**24, 1, 2))
            for k in sorted({*zip(block.tolist(), size.tolist(), kind.tolist(), strict=True)}):
                mine = np.flatnonzero((block == k[0]) & (size == k[1]) & (kind == k[2]))
                vectors = flat[(start[mine][:, None] + np.arange(k[1])).ravel()].astype(_KINDS[k[2]])
                key = (k[0], k[1], _KINDS[k[2]])
                held.setdefault(key, []).append([ids[mine], vectors])
                if sum(len(p[0]) for p in held[key]) >= ROWS:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return df.repartition(max(1, blocks), "block").mapInArrow(run, _PACKED)


def _unpacked(table: pa.Table) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    for dims, kind, ids, body in zip(*(table.column(c).to_pylist() for c in ("dims", "kind", "ids", "body")), strict=True):
        ids = np.frombuffer(ids, np.int64)
        yield dims, kind, ids, np.frombuffer(body, kind).reshape(len(ids), dims)


def _search(k: int, kept: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        whose, ids, scores = [], [], []
        asked = list(_unpacked(right))
        for dims, kind, rows, x in _unpacked(left):
            for at in range(0, len(rows), ROWS):
                some, body = rows[at : at + ROWS], x[at : at + ROWS]
                index = None
                for q_dims, q_kind, q_ids, q in asked:
                    if q_dims != dims:
                        continue
                    if "f8" in (kind, q_kind) or dims >= 1 << 12:
                        best = _large(some, body, q_ids, q, k)
                    else:
                        index = index or Block(some, body, kept)
                        best = index.top(q_ids, q, k)
                    for own, got, score in best:
                        whose.append(np.full(len(got), own))
                        ids.append(got)
                        scores.append(score)
        flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (whose, ids, scores)]
        return pa.Table.from_arrays([pa.array(x) for x in flat], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", kept: int = KEPT) -> DataFrame:
    """Each query's k highest scores among the rows: query_id, rank, vec_id, score.

    The two counts of rows that size the blocks are the only actions.
    """
    session(rows)
    asked = _whole(queries, id_col, vector_col).groupBy("id").agg(F.min("x").alias("x"))
    blocks, parts = max(1, -(-rows.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    numbered = _whole(rows, id_col, vector_col).withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    indexed = _pack(numbered.select("block", "id", "x"), blocks)
    asked = _pack(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select("block", "id", "x"), parts)
    left = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumnRenamed("block", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(k, kept), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
