"""Vectorised word scanning shared by the corpus operators.

A *word* is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); these bytes never occur inside a multi-byte UTF-8
sequence, so the scan works on the raw Arrow buffers without decoding a text.

Words get 64-bit hashes: a polynomial over random byte values, finished by a
mixing step. Windows of k words get a hash of their words' hashes. Two
different windows share a hash with probability about 2**-64, so two documents
of 10,000 windows each are confused in one window in about 10**11 such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_COEF = _RNG.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[SPACE] = 0  # what stands between two words adds nothing to a word's sum
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}

#: Bytes of text handled at once; a longer single text is handled whole.
CHUNK_BYTES = 2 << 20


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(21, (n - 1).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 1 << 22:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Scan:
    """Words of a run of texts.

    data: the texts' bytes (lower-cased if asked); off: each text's bounds in it;
    start, end: each word's bounds in data; doc: each word's text; hash: its hash;
    first: bounds in start of each text's words (len = texts + 1).
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, hashes: bool = True):
        self.off = off
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        weighed = _BYTE[self.data]
        weighed *= _power(_BASE, len(self.data))[: len(self.data)]
        return mix(np.add.reduceat(weighed, self.start) * _power(_BASE_INV, len(self.data))[self.start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of each window of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = self.hash[:n] * _COEF[0]
        for j in range(1, k):
            total += self.hash[j : j + n] * _COEF[j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(total[at])

    def whole(self, i: int) -> int:
        """A hash of the i-th text's whole word sequence."""
        words = self.hash[self.first[i] : self.first[i + 1]]
        x = len(words)
        for h in words.tolist():
            x = ((x ^ h) * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & (2**64 - 1)
        return int(mix(np.array([x], np.uint64))[0])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column's values; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, between rows, into runs of about `size` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = texts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def scan(column: pa.Array, lower: bool = False, hashes: bool = True) -> Scan:
    return Scan(*texts(column), lower=lower, hashes=hashes)
