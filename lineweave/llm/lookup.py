"""Corpus-wide answers about hashed keys, brought back to the texts that hold them.

A *chunk* is a run of one task's documents. It sends its distinct keys, packed
and dealt by hash, to shards; a shard sees every chunk's keys of its hash range,
so it can count them, and sends each chunk one packed answer per key. A second
read of the documents, grouped by chunk, meets the answers.

Compared with a join of exploded keys, a row here stands for thousands of keys.
Both reads cut chunks alike because they run the same scan; a chunk carries a
fingerprint of its ids and lengths, and a mismatch raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textscan as ts
from .common import ids_and_text, session

CHUNK_BYTES, SHARD_BYTES = 3 << 20, 64 << 20


def shards_for(df: DataFrame) -> int:
    """Twice the session's shuffle partitions, or one for each SHARD_BYTES of the documents as Spark estimates them, if that is more.

    The estimate of a plan with joins can be far too high, so it counts up to 64 times the partitions.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(2 * partitions, -(-size // SHARD_BYTES)), 64 * partitions)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

    def out():
        nonlocal n
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        off = ts.texts(table.column(1))[1]
        mark = zlib.crc32(off.tobytes(), zlib.crc32(np.ascontiguousarray(table.column(0).fill_null(-1).to_numpy(zero_copy_only=False)).tobytes()))
        n += 1
        return part << 32 | n, mark, table

    for b in ts.pieces(batches, "text", CHUNK_BYTES):
        more = int(ts.texts(b.column(1))[1][-1])
        if held and size + more > CHUNK_BYTES:
            yield out()
            held, size = [], 0
        held.append(b)
        size += more
    if held:
        yield out()


class Keys:
    """Distinct keys of a chunk in the order in which they are sent: by shard, then key.

    sent: (shard, 32 bits of the key) as one number, ascending; at: for each of the given hashes, its place in sent.
    Two hashes that agree in these bits count as one key. With wide, sent is the hash without its shard (hash // shards),
    ascending within each shard, and only equal hashes are one key.
    """

    def __init__(self, hashes: np.ndarray, shards: int, wide: bool = False):
        if wide:
            key, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
            shard = (key % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.sent, self.at, self.count = key[order] // np.uint64(shards), place[at], count[order]
            self.bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            return
        short = (hashes % np.uint64(shards)) << np.uint64(32) | (hashes >> np.uint64(32))
        self.sent, self.at, self.count = np.unique(short, return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted(self.sent, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))


def _packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte by byte: the upper bytes are zeros, which the shuffle's compression takes away."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(raw.view(np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def answers(
    docs: DataFrame,
    hashes: Callable[[ts.Scan], np.ndarray],
    respond: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    width: type,
    finish: Callable[[pa.RecordBatch, np.ndarray], pa.Table],
    schema: str,
    lower: bool = False,
    wide: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """wide: keys are told apart by all 64 bits, for answers that are results; else by 32 bits and the shard, for prefilters.
    hashes(scan): a chunk's keys, repeats included.
    respond(total, own, first): for each chunk's keys, their counts in the corpus and in the chunk, and whether no chunk
    read before it holds them -> answers of `width`.
    carry: further columns of docs that finish() finds after the id and the text.
    finish(rows, answer per key as hashes() gave them) -> rows of the result; called right after hashes() of these rows.
    """
    session(docs)
    source, shards = ids_and_text(docs, carry=carry), shards_for(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, mark, rows in _chunks(batches):
            k = Keys(hashes(ts.scan(rows.column(1), lower=lower)), shards, wide)
            low = k.sent if wide else (k.sent & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            # a count of one, by far the most common, is not written
            body = []
            for i in range(shards):
                a, b = k.bounds[i], k.bounds[i + 1]
                more = np.flatnonzero(k.count[a:b] > 1).astype(np.uint32)
                body.append(np.uint32(b - a).tobytes() + (_packed(low[a:b]) if wide else low[a:b].tobytes()) + more.tobytes() + k.count[a:b][more].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array(np.full(shards, chunk)), pa.array(np.full(shards, mark, np.int64)), pa.array(body, pa.binary())], ["shard", "chunk", "mark", "body"])

    def count(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("chunk").to_numpy())))
        keys, counts = [], []
        for body in table.column("body"):
            raw = np.frombuffer(body.as_buffer(), np.uint32)
            n = int(raw[0])
            end = 1 + (2 * n if wide else n)
            more = (len(raw) - end) // 2
            c = np.ones(n, np.uint32)
            c[raw[end : end + more]] = raw[end + more :]
            keys.append(_unpacked(raw[1:end]) if wide else raw[1:end])
            counts.append(c)
        flat, own = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")  # equal keys stay in the order of their chunks
        by_key = flat[order]
        new = np.flatnonzero(np.concatenate([[True], by_key[1:] != by_key[:-1]])) if len(flat) else np.zeros(0, np.int64)
        total, first = np.empty(len(flat), np.int64), np.zeros(len(flat), bool)
        if len(flat):
            sums = np.add.reduceat(own[order].astype(np.int64), new)
            total[order] = np.repeat(sums, np.diff(np.concatenate([new, [len(flat)]])))
            first[order[new]] = True
        out = respond(total, own, first).astype(width)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return pa.Table.from_arrays([table.column("chunk"), table.column("mark"), table.column("shard"), pa.array([x.tobytes() for x in np.split(out, cut)], pa.binary())], ["chunk", "mark", "shard", "answer"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, mark, rows in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([mark], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "mark", "rows"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or right.num_rows != shards or set(right.column("mark").to_pylist()) != {left.column("mark")[0].as_py()}:
            raise RuntimeError("the documents changed between two reads")
        rows = pa.ipc.open_stream(left.column("rows")[0].as_buffer()).read_all().combine_chunks().to_batches()[0]
        order = np.argsort(right.column("shard").to_numpy())
        bodies = right.column("answer").combine_chunks().take(pa.array(order))
        got = np.concatenate([np.frombuffer(x.as_buffer(), width) for x in bodies])
        k = Keys(hashes(ts.scan(rows.column(1), lower=lower)), shards, wide)
        return finish(rows, got[k.at])

    sent = source.select("doc_id", "text").mapInArrow(send, "shard int, chunk long, mark long, body binary")
    answered = sent.groupBy("shard").applyInArrow(count, "chunk long, mark long, shard int, answer binary")
    told = source.mapInArrow(again, "chunk long, mark long, rows binary")
    return told.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(meet, schema)
