"""Secret scans behind a trigram inverted index.

For each run of texts an inverted index maps trigrams (of the bytes, A-Z folded)
to the texts that hold them; only trigrams that some rule asks for are posted.
From each rule's regex a Boolean trigram query is derived: a string that a match
must contain becomes the AND of its trigrams, an alternation becomes an OR, and
what says nothing becomes ANY. The postings are intersected and united, and the
regex verifies the candidates. A rule whose query is ANY (a bare run of hex
digits, say) scans every text.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; per rule, matches are leftmost and do not overlap, and those that are
too short are dropped after matching; one row per input row, also for repeated
or null ids; no secrets give zero counts and empty strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textscan as ts
from .common import ids_and_text, session


@dataclass(frozen=True)
class Rule:
    """least: characters that `group` of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Published token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE

# A query is True (any text), a trigram, ("and", parts) or ("or", parts).
_MOST = 48  # strings that a piece of a regex may stand for before it is turned into a query


def _and(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(some: set[str]):
    """The query for texts that hold one of these strings."""
    each = []
    for s in sorted(some):
        b = s.encode()
        each.append(_and([b[i : i + 3] for i in range(len(b) - 2)]))
    return _or(each)


def _set(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < _MOST:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings that the piece can be, or None; a query that holds for its matches)."""
    exact: set[str] | None = {""}
    asked: list = []

    def flush(tail: set[str] | None) -> None:
        nonlocal exact
        if exact is not None:
            asked.append(_strings(exact))
        exact = tail

    for op, arg in tree:
        query: object = True
        if op is C.LITERAL:
            got = {chr(arg).lower()}
        elif op is C.IN:
            got = _set(arg)
        elif op is C.SUBPATTERN:
            got, query = _walk(arg[3])
        elif op is C.BRANCH:
            both = [_walk(x) for x in arg[1]]
            got = set().union(*(b[0] for b in both)) if all(b[0] is not None for b in both) else None
            query = _or([b[1] if b[0] is None else _strings(b[0]) for b in both])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            lo, hi, inner = arg
            one, inner_query = _walk(inner)
            got = {""} | one if (lo, hi) == (0, 1) and one is not None else None
            if lo >= 1:
                query = inner_query if one is None else _strings(one)
                if lo == hi and one is not None and len(one) ** lo <= _MOST:
                    got = {""}
                    for _ in range(lo):
                        got = {a + b for a in got for b in one}
        elif op is C.AT:
            got = {""}
        else:
            got = None
        if got is not None and exact is not None and len(exact) * len(got) <= _MOST:
            exact = {a + b for a in exact for b in got}
        elif got is not None:
            flush(got)
        else:
            flush(None)
            asked.append(query)
    return exact if not asked else None, _and([*asked, *([_strings(exact)] if exact is not None else [])])


def trigram_query(pattern: str):
    """What trigrams a text must hold to have a match; True if the regex demands none."""
    return _walk(_parser.parse(pattern, re.ASCII))[1]


def _trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(_trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # a run of one character class, longer than `least`, needs no look at the shorter ones
        self.regexes = [re.compile(r.pattern[:-1] + "{%d,}" % r.least if r.least and not r.group and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern, re.ASCII) for r in rules]
        self.wanted = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, data: np.ndarray, off: np.ndarray) -> dict[bytes, np.ndarray]:
        """Each wanted trigram's texts, in order."""
        if len(data) < 3:
            return {}
        low = ts._LOWER[data].astype(np.uint32)
        found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[doc + 1]
        key = np.unique(found[at[inside]].astype(np.int64) << 40 | doc[inside])
        which, doc = key >> 40, key & ((1 << 40) - 1)
        cut = np.flatnonzero(np.diff(which)) + 1
        return {self.wanted[w[0] - 1]: d for w, d in zip(np.split(which, cut), np.split(doc, cut), strict=True) if len(w)}

    def candidates(self, query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(query, np.zeros(0, np.int64))
        each = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(each))
        each.sort(key=len)
        out = each[0]
        for e in each[1:]:
            out = np.intersect1d(out, e, assume_unique=True)
        return out

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Each text's (start, rule's place, end), in that order."""
        data, off = ts.texts(column)
        postings = self.postings(data, off)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        values: dict[int, str] = {}
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes, strict=True)):
            for i in self.candidates(query, postings, len(column)).tolist():
                if (text := values.get(i)) is None:
                    text = values[i] = bytes(data[off[i] : off[i + 1]]).decode()
                for m in regex.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for x in found:
            x.sort()
        return found


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and an array of its secrets (kind, start, end, value). No shuffle."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for b in ts.pieces(batches, "text"):
            texts = b.column(1)
            rows = [[{"kind": rules[k].kind, "start": s, "end": e, "value": texts[i].as_py()[s:e]} for s, k, e in x] for i, x in enumerate(scanner.scan(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "secrets"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, each secret replaced by [KIND]; overlapping spans become one, named by the first."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in ts.pieces(batches, text_col):
            at = b.schema.get_field_index(text_col)
            found = scanner.scan(b.column(at))
            if any(found):
                texts = b.column(at).to_pylist()
                for i, x in enumerate(found):
                    if x:
                        texts[i] = _without(texts[i], x, rules)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    out, at = [], 0
    for start, k, end in found:
        if start >= at:
            out += [text[at:start], f"[{rules[k].kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES)
        names = [r.kind for r in RULES]
        nothing = hashlib.sha256(b"").hexdigest()
        for b in ts.pieces(batches, "text"):
            found = scanner.scan(b.column(1))
            counts = np.zeros((len(found), 3), np.int64)
            base, spans = [nothing] * len(found), [""] * len(found)
            for i, x in enumerate(found):
                if x:
                    for _, k, _ in x:
                        if k < 3:
                            counts[i, k] += 1
                    base[i] = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in x if k < 3).encode()).hexdigest()
                    spans[i] = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, j]) for j in range(3)), pa.array(base), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return ids_and_text(docs).mapInArrow(run, _SCHEMA)
