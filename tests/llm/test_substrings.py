import itertools
import random

import pyarrow as pa

from lineweave.llm import substrings
from lineweave.llm import textscan as ts

DOCS = "doc_id long, text string, row string, cuts int"


def _docs(spark, *texts):
    return spark.createDataFrame([(None if i % 7 == 3 else i - i % 2, t, "clash", 1) for i, t in enumerate(texts)], DOCS).coalesce(1)


def _own(k, n=80):
    return " ".join(f"d{k}w{i}" for i in range(n))


def _passage(n=60, name="p"):
    return " ".join(f"{name}{i}q" for i in range(n))


def test_passages_that_repeat_are_found_wherever_they_stand(spark):
    p = _passage()
    docs = spark.createDataFrame([(1, f"{_own(1)} {p} {_own(2)}"), (2, f"{_own(3)}\n{p}\n{_own(4)}"), (3, _own(5)), (4, None), (5, "")], "doc_id long, text string").coalesce(1)
    rows = substrings.repeats(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2} and {r.doc_id for r in rows if r.removed} == {2}
    for r in rows:
        text = {1: f"{_own(1)} {p} {_own(2)}", 2: f"{_own(3)}\n{p}\n{_own(4)}"}[r.doc_id]
        part = text.encode()[r.first : r.last].decode()
        assert part in p and len(part.split()) >= 60 - 2 * (substrings.REACH - 1)


def test_every_repeated_passage_of_50_words_and_nothing_short(spark):
    rng = random.Random(2)
    least = substrings.LEAST + 2 * (substrings.REACH - 1)
    texts, want = [], set()
    for k in range(60):
        n = rng.choice([14, 20, substrings.LEAST - 1, least, least + 7, 90])
        p = _passage(n, f"p{k}x")
        if k % 3 == 1:
            p = p.replace(" ", "\n")  # over many lines
        for side in "ab":
            texts.append(f"{_own(f'{k}{side}', rng.randrange(1, 60))} {p if side == 'a' else p.upper()} {_own(f'{k}{side}z', rng.randrange(1, 60))}")
        if n >= least:
            want |= {2 * k, 2 * k + 1}
    got = {r.row for r in substrings._found(spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text")).collect()}
    assert got == want


def test_a_changed_word_does_not_hide_a_passage(spark):
    words = _passage(64).split()
    other = [*words[:32], "changed", *words[33:]]
    rows = substrings.repeats(spark.createDataFrame([(1, f"{_own(1)} {' '.join(words)} {_own(2)}"), (2, f"{_own(3)} {' '.join(other)} {_own(4)}")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2}


def test_near_copies_of_paragraphs_equal_all_pairs(spark):
    """Recall of the bands against every pair of lines, not against the bands' own buckets."""
    rng = random.Random(5)
    lines = []
    for base in range(12):
        words = [f"b{base}x{i}" for i in range(60)]
        for k in range(8):
            lines.append(" ".join(w if rng.random() > 0.02 else f"{w}k{k}" for w in words))
    lines += ["short line here", _own(1, 35)] * 2
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [None]
    places, at = [], 0
    for i, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n") if t else ():
            if len(line.split()) >= substrings.LEAST:
                w = line.split()
                places.append(((i, at), frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))))
            at += len(line.encode()) + 1
    up = {p: p for p, _ in places}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = found = 0
    got = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text")
    for r in substrings._found(docs).filter("kind = 'paragraph'").collect():
        got.setdefault(r.component_id, {})[(r.row, r.first)] = r.removed
    of = {p: c for c, some in got.items() for p in some}
    for (p, x), (q, y) in itertools.combinations(places, 2):
        if 4 * len(x & y) >= 3 * len(x | y):
            pairs += 1
            found += p in of and of[p] == of.get(q)
            a, b = top(p), top(q)
            up[max(a, b)] = min(a, b)
    assert pairs > 100 and found == pairs
    groups = {}
    for p, _ in places:
        groups.setdefault(top(p), set()).add(p)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert all(not removed == (p == min(g)) for g in got.values() for p, removed in g.items())


def test_clean_keeps_one_occurrence_of_everything(spark):
    p, q = _passage(60, "p"), _passage(70, "q")
    texts = [f"{_own(0)} {p} {q}", f"{p}\n{_own(1)}\n{q}", f"{q} {_own(2)} {p}", f"{_own(3)}\n{p}\n{_own(4)}", None, "", _own(6), _own(6), f"é {_own(8)} {q} ü"]
    docs = _docs(spark, *texts)
    out = substrings.clean(docs)
    assert out.columns == docs.columns
    left = [r.text for r in out.collect()]
    assert len(left) == len(texts) and left.count(None) == 1
    whole = "\n".join(t or "" for t in left)
    for name, n in (("p", 60), ("q", 70), ("d6w", 80)):
        words = _passage(n, name).split() if name != "d6w" else _own(6).split()
        middle = words[substrings.REACH - 1 : 1 - substrings.REACH]
        assert all(whole.split().count(w) == 1 for w in middle)
    for k in (0, 1, 2, 3, 4, 8):
        assert all(w in whole.split() for w in _own(k).split())


def test_repeated_rows_with_one_id_lose_all_but_one(spark):
    docs = spark.createDataFrame([(7, _passage()), (7, _passage()), (None, _passage()), (None, None)], "doc_id long, text string").coalesce(1)
    assert sorted(map(len, (r.text or "" for r in substrings.clean(docs).collect())))[-2] < 200
    assert sum(r.removed for r in substrings.repeats(docs).filter("kind = 'paragraph'").collect()) == 2


def test_a_stretch_stands_in_every_reach(spark):
    rng = random.Random(8)
    least = substrings.SPAN + substrings.REACH - 1
    for k in range(200):
        passage = _passage(least, f"p{k}q")
        around = lambda side: " ".join(f"{side}{k}w{rng.random()}" for _ in range(rng.randrange(60)))
        s = ts.scan(pa.array([f"{around('a')} {passage} {around('b')}", f"{around('c')} {passage} {around('d')}"]), lower=True)
        m = substrings.Marked(s)
        of = [set(m.span_hash[s.doc[m.span] == d].tolist()) for d in (0, 1)]
        assert of[0] & of[1]


def test_empty_and_null_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.repeats(none).count() == 0 and substrings.clean(none).count() == 0
