"""Byte-level BPE by merge replay over a vocabulary of words.

The texts of a run are cut into words by the tokenizer's pattern and each
distinct word is taken once. All those words lie in one array of symbols, and an
inverted index maps each mergeable pair to the places where it stands. The
lowest-ranked pair is applied at all its places, and only the two neighbours of
each place are looked at again; then the next, until no pair is left. Within a
word this is the order in which the words' merges would be done one by one, so
the ids are those of the tiktoken library. As there, a word that is itself in
the vocabulary is taken whole.

A run is a slice of one task's texts and words keep their ids from run to run,
so no text is shuffled and nothing grows with the corpus: the store of words is
emptied after the run in which it passes WORDS entries and words are merged anew.

Defined results: a null text counts as empty (no ids); one row per input row,
also for repeated or null ids; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textscan as ts
from .common import ids_and_text, session

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words from which a worker's store of ids is emptied, and words of one long text handled at once.
WORDS, SLICE = 500_000, 1 << 20
#: Places of a pair from which its merges are done as arrays, and words from which that pays.
MANY, LEAST = 24, 2000


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Tokenizer:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p", r"[^\p"))
        self.width = max(self.ranks.values()) + 2  # the last stands for no token
        self.bytes = [b""] * self.width
        for b, r in self.ranks.items():
            self.bytes[r] = b
        self.digits = [str(i) for i in range(self.width)]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)])
        # a pair of tokens merges if its bytes are a token, whichever way that token is cut
        self.pairs = {self.ranks[b[:i]] * self.width + self.ranks[b[i:]]: r for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks}
        self.pair_keys = np.array(sorted(self.pairs))
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()])
        # tokens that can take part in a merge ranked before their own
        self.unsafe = {t for k, r in self.pairs.items() for t in divmod(k, self.width) if r < t and len(self.bytes[t]) > 1}
        self._forget()

    def _forget(self) -> None:
        """Empty the store: each word's number, and by number the bounds of its ids."""
        self.words = _Numbers()
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one word after the other, and how many each has."""
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        n = int(bounds[-1])
        ids = np.empty(n + 1, np.int64)
        ids[:n] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ids[n] = self.width - 1
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[bounds[1:][np.diff(bounds) > 0] - 1] = n  # n: there is none
        prv[bounds[:-1][np.diff(bounds) > 0]] = n
        rank = np.full(n + 1, -1, np.int64)  # of the pair that begins here
        index: dict[int, list] = {}
        first = np.flatnonzero(nxt[:n] < n)
        rank[first] = self._ranks(ids[first], ids[nxt[first]])
        self._post(index, rank, first)
        if len(words) >= LEAST:
            self._replay_arrays(ids, nxt, prv, rank, np.repeat(np.arange(len(words)), np.diff(bounds)), index)
        self._replay_places(ids := ids.tolist(), nxt.tolist(), prv.tolist(), rank.tolist(), {r: np.concatenate(p).tolist() for r, p in index.items()}, n)
        kept = np.array(ids[:n])
        alive = kept >= 0
        cut = np.concatenate([[0], np.cumsum(alive)])[bounds]
        return kept[alive], np.diff(cut)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    @staticmethod
    def _post(index: dict[int, list], rank: np.ndarray, places: np.ndarray) -> list[int]:
        """Enter places by the rank of their pair; the ranks that are new to the index."""
        r = rank[places]
        places, r = places[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cut = np.flatnonzero(np.diff(r)) + 1
        new = []
        at = [0, *cut.tolist(), len(r)]
        for k, a, b in zip(r[at[:-1]].tolist() if len(r) else (), at, at[1:], strict=False):
            if k in index:
                index[k].append(places[a:b])
            else:
                index[k] = [places[a:b]]
                new.append(k)
        return new

    def _replay_arrays(self, ids: np.ndarray, nxt: np.ndarray, prv: np.ndarray, rank: np.ndarray, word: np.ndarray, index: dict[int, list]) -> None:
        """Merge in rank order, all places of a pair at once, as long as pairs have many places."""
        n = len(ids) - 1
        heap = list(index)
        heapq.heapify(heap)
        few = 0
        while heap and few < 64:
            r = heap[0]
            heapq.heappop(heap)
            places = np.unique(np.concatenate(index.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            if r in self.unsafe:  # a merge may make way for one that comes before the word's other places: only the first now
                first = np.concatenate([[True], word[places[1:]] != word[places[:-1]]])
                if not first.all():
                    index[r] = [places[~first]]
                    heapq.heappush(heap, r)
                    places = places[first]
            few = few + 1 if len(places) < MANY else 0
            # in a run of overlapping pairs, the first, the third and so on
            joined = np.zeros(len(places), bool)
            joined[1:] = nxt[places[:-1]] == places[1:]
            if joined.any():
                since = np.arange(len(places))
                since -= np.maximum.accumulate(np.where(joined, 0, since))
                places = places[since % 2 == 0]
            gone = nxt[places]
            after = nxt[gone]
            ids[places], ids[gone] = r, -1
            rank[places], rank[gone] = -1, -1
            nxt[places] = after
            prv[after] = places
            right = places[after < n]
            rank[right] = self._ranks(ids[right], ids[nxt[right]])
            left = prv[places]
            left = left[left < n]
            rank[left] = self._ranks(ids[left], ids[nxt[left]])
            for k in self._post(index, rank, np.concatenate([right, left])):
                heapq.heappush(heap, k)

    def _replay_places(self, ids: list[int], nxt: list[int], prv: list[int], rank: list[int], index: dict[int, list[int]], n: int) -> None:
        """Merge in rank order, place by place."""
        width, get = self.width, self.pairs.get
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, p in enumerate(places):
                if rank[p] != r:
                    continue  # a neighbour has taken one of the two
                q = nxt[p]
                ids[p] = r
                rank[q] = -1
                ids[q] = -1
                after = nxt[p] = nxt[q]
                again = False
                rank[p] = -1
                if after < n:
                    prv[after] = p
                    s = rank[p] = get(r * width + ids[after], -1)
                    if s >= 0:
                        again |= s <= r
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(heap, s)
                before = prv[p]
                if before < n:
                    s = rank[before] = get(ids[before] * width + r, -1)
                    if s >= 0:
                        again |= s <= r
                        if s in index:
                            index[s].append(before)
                        else:
                            index[s] = [before]
                            heapq.heappush(heap, s)
                if again and k + 1 < len(places):  # a merge made way for one that comes before the rest of this list
                    rest = places[k + 1 :]
                    if r in index:
                        index[r] += rest
                    else:
                        index[r] = rest
                        heapq.heappush(heap, r)
                    break

    def _learn(self, words: list[str]) -> None:
        """Enter the ids of words that have just been numbered."""
        sizes = np.ones(len(words), np.int64)
        todo, ids = [], np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                ids[k] = whole
            else:
                todo.append((k, b))
        flat, n = self.replay([b for _, b in todo])
        at = np.array([k for k, _ in todo], np.int64)
        sizes[at] = n
        ends = np.cumsum(sizes)
        out = np.repeat(ids, sizes)
        lo = ends[at] - n
        out[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        self.flat = np.concatenate([self.flat, out.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and after each word how many there are so far, from 0."""
        if len(self.words) > WORDS:
            self._forget()
        known = len(self.words)
        w = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > known:
            self._learn(list(islice(self.words, known, None)))
        lo = self.bounds[w]
        size = self.bounds[w + 1] - lo
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])], ends

    def encode(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, in slices; read them in order."""
        if sum(map(len, texts)) <= 4 * SLICE:
            cut = [self.cut.findall(t) for t in texts]
            words = list(chain.from_iterable(cut))
            ids, ends = self.ids(words)
            at = ends[np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])].tolist()
            for a, b in zip(at, at[1:], strict=False):
                yield iter((ids[a:b].tolist(),))
        else:
            for t in texts:
                yield self._long(t)

    def _long(self, text: str) -> Iterator[list[int]]:
        found = (m[0] for m in self.cut.finditer(text))
        while words := list(islice(found, SLICE)):
            yield self.ids(words)[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def _tokenizer(path: str | None) -> Tokenizer:
    """A worker's tokenizer, kept with its words from task to task."""
    return Tokenizer(path or public_tokenizers.path(VOCABULARY))


_RUN = 4 * SLICE  # bytes of texts in a run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and its ids, an array. path: a rank file that every executor has."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in ts.pieces(batches, "text", _RUN):
            rows = [list(chain.from_iterable(x)) for x in t.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids count as none."""
    session(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            rows = [t.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc_id", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What the contract asks for, from ids and bytes that exist only slice by slice."""
    session(docs)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in ts.pieces(batches, "text", _RUN):
            rows = []
            for slices in t.encode(b.column(1).to_pylist()):
                n, written, body = 0, hashlib.sha256(), hashlib.sha256()
                for ids in slices:
                    if n and ids:
                        written.update(b" ")
                    n += len(ids)
                    written.update(" ".join(map(t.digits.__getitem__, ids)).encode())
                    body.update(t.decode(ids))
                rows.append((n, written.hexdigest(), body.hexdigest()))
            n, x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_text(docs).mapInArrow(run, schema)
