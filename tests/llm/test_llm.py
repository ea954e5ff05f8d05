import base64
import hashlib
import math
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lineweave.llm import bpe, chat, html, jaccard, lm, lookup, mixing, quality, secrets, textscan, topk

DOCS = "doc_id long, text string, source string, n_words string"


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t, f"s{i % 2}" if i % 5 else None, "clash") for i, t in enumerate(texts)], DOCS)


def test_bpe_equals_tiktoken_and_round_trips(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  wörld's\n\n 123", "a" * 5000, "naïve 🙂 café " * 50, "<|endoftext|>"]
    got = {r.doc_id: r.ids for r in bpe.encode(_docs(spark, *texts)).collect()}
    assert got == {i: want.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.body).decode() for r in bpe.decode(bpe.encode(_docs(spark, *texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_secrets_spans(spark):
    text = 'é token = "abcdefgh12" AKIAABCDEFGHIJKL and ' + "0af" * 11
    rows = secrets.digest(_docs(spark, text, None, "token=short")).collect()
    by = {r.doc_id: r for r in rows}
    assert (by[0].n_assign, by[0].n_access, by[0].n_hex) == (1, 1, 1) and by[0].spans.startswith("assign:2:")
    assert by[1].spans == by[2].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(_docs(spark, text, None)).collect()}
    assert clean[0] == 'é [ASSIGN]" [ACCESS] and [HEX]' and clean[1] is None


def test_trigram_queries_never_lose_a_match():
    s = secrets.Scanner()
    for rule, query in zip(s.rules, s.queries, strict=True):
        assert rule.kind == "hex" or query is not True


def test_quality_keeps_columns_and_rejects(spark):
    good = " ".join(f"word{i}" for i in range(60))
    d = _docs(spark, good, "too few", None, "a b c " * 40)
    assert [r.doc_id for r in quality.apply_policy(d).collect()] == [0]
    assert quality.apply_policy(d).columns == d.columns
    assert {r.rule: r.failing for r in quality.ablations(quality.ledger(d)).collect()}["few_words"] == 2


def test_mix_hits_targets_and_repeats(spark):
    d = _docs(spark, *[" ".join(["w"] * (5 + i % 7)) for i in range(300)], None)
    a, b = ({r.doc_id: (r.copies, r.target, r.source) for r in mixing.copies(d).collect()} for _ in range(2))
    assert a == b and len(a) == 301 and max(c for c, _, _ in a.values()) <= 3
    size = {i: 5 + i % 7 for i in range(300)}
    for s in {x[2] for x in a.values()}:
        target = next(t for _, t, x in a.values() if x == s)
        assert abs(sum(size.get(i, 0) * c for i, (c, _, x) in a.items() if x == s) - target) < 40


def _best(rows, ids, query, own, k):
    return sorted((-sum(a * b for a, b in zip(v, query, strict=True)), i) for v, i in zip(rows, ids, strict=True) if i != own)[:k]


@pytest.mark.parametrize("kept", [1, 3, 6, 30])
def test_topk_block_equals_brute_force(kept):
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (500, 7))
    x[100:200] = x[100]
    x[0], x[1] = 0, 299
    ids = r.permutation(500)
    block = topk.Block(ids, x, kept)
    for own, got, score in block.top(ids[:60], x[:60], 5):
        want = _best(x.tolist(), ids.tolist(), x[np.flatnonzero(ids == own)[0]].tolist(), own, 5)
        assert [(-int(s), int(i)) for s, i in zip(score, got, strict=True)] == want


def test_topk_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(9)
    rows = [(i, r.normal(0, 1, 3 + i % 2 * 2).tolist(), "clash") for i in range(400)]
    rows += [(i, rows[7][1], None) for i in range(400, 460)]  # ties
    rows += [(7, [9.0] * 5, None), (50, [0.25, -0.5, 3.0], None)]  # repeated ids
    rows += [(501, [3e30, -1.0, 2.0], None), (502, [2.0**40, 1.0, 1.0], None), (550, [2.0**41, 0.5, 0.5], None)]  # beyond 62 bits
    rows += [(503, None, None), (504, [1.0, None, 2.0], None), (505, [float("nan")] * 3, None), (506, [float("inf")] * 3, None), (None, [1.0] * 3, None), (600, [], None), (601, [], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    whole = [(i, [math.floor(v * 256) for v in x]) for i, x, _ in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    want = set()
    for own in {i for i, _ in whole if i % 50 == 0}:
        q = min(x for i, x in whole if i == own)
        same = [(i, x) for i, x in whole if len(x) == len(q)]
        for rank, (s, i) in enumerate(_best([x for _, x in same], [i for i, _ in same], q, own, 5), 1):
            want.add((own, rank, i, min(2**63 - 1, max(-(2**63), -s))))
    got = [tuple(x) for x in topk.digest(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_jaccard_components_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = [None, "", "one two", "One  two"]
    for _ in range(60):
        t = list(base)
        for k in r.integers(0, 60, r.integers(0, 3)):
            t[k] = f"x{r.integers(9)}"
        texts.append(" ".join(t))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    old, jaccard.BLOCK = jaccard.BLOCK, 8  # so that blocks meet
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(_docs(spark, *texts)).collect()}
    finally:
        jaccard.BLOCK = old
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [8, 256])
def test_jaccard_join_returns_every_link(spark, block):
    r = np.random.default_rng(6)
    texts = []
    for base in "pq":
        for k in range(14):
            t = [f"{base}{i}" for i in range(60)]
            if k:
                t[r.integers(0, 60)] = f"x{k}"
            texts.append(" ".join(t))
    texts += [texts[0].upper(), None, "one two"]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").lower().split() for t in texts)]
    want = {(i, j) for j in range(28) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(want) > 60
    old, jaccard.BLOCK = jaccard.BLOCK, block
    try:
        rows = jaccard.join(_docs(spark, *texts))[1].collect()
    finally:
        jaccard.BLOCK = old
    assert len(rows) == len(want) and {(x.a, x.b) for x in rows} == want


def test_chat_reads_back_what_it_wrote(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <\\|"
    d = spark.createDataFrame([(1, '{"prompt": "p", "response": "<|im_end|>"}'), (2, '{"zzz": 1}'), (3, "no json")], "id int, record string")
    rows = {r.id: r for r in chat.format(d).withColumn("back", chat.read(chat.F.col("formatted"))).collect()}
    assert [(b.role, b.text) for b in rows[1].back] == [("user", "p"), ("assistant", "<|im_end|>")]
    assert rows[2].turns is None and rows[3].turns is None
    c = spark.createDataFrame([(1, 0, "assistant", tricky), (1, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.loss_chars for r in chat.digest(c).collect()} == {1: len(tricky), -1: 34}


@pytest.mark.parametrize("page,want", [(None, ""), ("<p>just text<p>more", "just text more"), ("<body><nav>menu</nav><article><h1>T</h1><p><b>A &amp; b<br><p>c</article><footer>f</footer>", "T A & b c"), ("<b>" * 3000 + "x", "x")])
def test_html(page, want):
    assert html.extract(page) == want


def test_html_keeps_every_section_without_article():
    section = lambda name, n, size: "".join(f"<p>{name}{k} {'x' * size}</p>" for k in range(n))
    links = "<ul>" + "".join(f'<li><a href="/{k}">elsewhere {k}</a></li>' for k in range(20)) + "</ul>"
    words = [f"{name}{k}" for name, n in (("first", 3), ("second", 3), ("third", 1)) for k in range(n)]
    for inner in (f"<div>{section('first', 3, 200)}</div><div>{section('second', 3, 180)}</div><div>{section('third', 1, 20)}</div>", f"<section><div>{section('first', 3, 200)}</div></section><section>{section('second', 3, 180)}</section>{section('third', 1, 20)}"):
        got = html.extract(f"<body><div id=content><h1>Title</h1>{inner}</div>{links}</body>").split()
        assert got[0] == "Title" and [w for w in got if w in words] == words and "elsewhere" not in got


_STORY = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize("page", [
    '<div class="content no-sidebar"><article><p>{}</article></div>', '<div class="page has-header"><p>{}</div>', "<div id=search-results><p>{}</div>",
    "<form action=/><header>H</header><article><p>{}</article></form>", "<form><div><p>{}</div></form>", "<main><h1></h1><form><p>{}</form></main>",
    "<div class=widget><article><p>{}</article></div>", "<div class='x comments'><div><p>{}</div></div>", "<article><div class=hidden><p>{}</div></article>",
])
def test_html_never_cuts_what_holds_the_article(page):
    assert html.extract(f"<body><nav>menu</nav>{page.format(_STORY)}<footer>foot</footer></body>") == _STORY


@pytest.mark.parametrize("part", ["<div class=comments><article>{}</article></div>", "<aside>{}</aside>", "<div class='x ad'>{}</div>", "<div hidden>{}</div>"])
def test_html_still_cuts_what_stands_beside_an_article(part):
    assert html.extract(f"<body><article><p>{_STORY}</article>{part.format('other ' * 200)}</body>") == _STORY


@pytest.mark.parametrize("name", ["class=share", "id=search", 'class="x comment"', "class=alert"])
@pytest.mark.parametrize("tag", ["p", "h2", "li", "span", "blockquote"])
def test_html_keeps_text_whatever_its_class(tag, name):
    page = f"<body><article><p>{_STORY}</p><{tag} {name}>Share prices fell sharply</{tag}><p>the end</article></body>"
    assert html.extract(page) == f"{_STORY} Share prices fell sharply the end"
    links = f"<{tag} {name}><a href=/a>Share this page now</a> <a href=/b>Print</a></{tag}>"
    assert html.extract(f"<body><article><p>{_STORY}</p>{links}<p>the end</article></body>") == f"{_STORY} the end"


def test_html_density_chooses_among_articles():
    teasers = "".join(f'<article><h3><a href="/{k}">Elsewhere {k} in the news today</a></h3></article>' for k in range(9))
    assert html.extract(f"<body><div>{teasers}</div><div><article><p>{_STORY}</p><p>{_STORY}</p></article></div><div>{teasers}</div></body>") == f"{_STORY} {_STORY}"


def test_html_densities_equal_brute_force():
    r = np.random.default_rng(4)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return "text " * int(r.integers(0, 30))
        name = ("div", "section", "a", "ul", "b")[r.integers(5)]
        return f"<{name}>{''.join(tree(depth - 1) for _ in range(r.integers(1, 4)))}</{name}>"

    for _ in range(40):
        t = html.Tree(f"<body>{tree(4)}{tree(3)}</body>")
        chars, links, density, total, body = html.densities(t)
        below = lambda i: [i] + [x for k in t.items[i] if not isinstance(k, str) for x in below(k)]  # noqa: B023, E731
        inside = lambda i: any(t.tag[k] == "a" for k in up(i))  # noqa: B023, E731
        up = lambda i: [i, *up(t.parent[i])] if i >= 0 else []  # noqa: B023, E731
        count = lambda some: sum(len(x.strip()) for i in some for x in t.items[i] if isinstance(x, str))  # noqa: B023, E731

        def parts(i):
            some = below(i)  # noqa: B023
            linked = [k for k in some if any(t.tag[x] == "a" for x in up(k) if x >= i)]  # noqa: B023
            return count(some), len(some) - 1, count(linked), len(linked)

        whole = parts(body) if body >= 0 else None
        for i in range(len(t.tag)):
            c, tg, lc, lt = parts(i)
            assert (chars[i], links[i]) == (c, lc)
            if body < 0 or not c:
                assert density[i] == 0
                continue
            base = math.log(c / max(1, c - lc) * lc + whole[2] / whole[0] * c + math.e)
            want = c / max(1, tg) * math.log(max(1.0, c / max(1, lc) * max(1, tg) / max(1, lt))) / (math.log(base) if base > 1.0000001 else 1.0)
            assert density[i] == pytest.approx(want)
            assert total[i] == pytest.approx(sum(density[k] for k in t.items[i] if not isinstance(k, str)))


def test_chat_canonical_layouts(spark):
    two = [("user", "q"), ("assistant", "r")]
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}', '{"messages": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "r"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}', '{"prompt": "q", "completion": "r"}', '{"prompt": "q", "response": "r"}', '{"question": "q", "answer": "r"}',
        '{"instruction": "q", "output": "r"}', '{"instruction": "q", "input": "", "output": "r"}', '{"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "r"}]}',
    ]
    records += ['{"system": "s", "prompt": "q", "response": "r"}', '{"role": "user", "text": null}', '{"instruction": "q", "input": "i", "output": "r"}']
    d = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    got = {r.id: [tuple(t) for t in r.turns] for r in chat.canonical(d).collect()}
    assert all(got[i] == two for i in range(9)) and got[9] == [("system", "s"), *two] and got[10] == [("user", "")] and got[11] == [("user", "q\n\ni"), ("assistant", "r")]


def test_secrets_equal_the_rules_run_directly(spark):
    r = np.random.default_rng(7)
    bits = ["token", "SECRET", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "0af9", "passwd=", "é", "\n", "Zm9vYmFy+/=", "x"]
    texts = ["".join(bits[k] for k in r.integers(0, len(bits), r.integers(1, 40))) for _ in range(400)]
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    for row in secrets.digest(_docs(spark, *texts)).collect():
        found = [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for place, (kind, rule, group, least) in enumerate(rules) for m in rule.finditer(texts[row.doc_id]) if len(m[group]) >= least]
        assert row.base_sha256 == hashlib.sha256(",".join(x for _, _, x in sorted(found)).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(p == k for _, p, _ in found) for k in range(3)]


def test_lm_scores_tell_words_apart_that_share_32_bits_and_a_shard(spark, monkeypatch):
    shards = 16  # few enough that some of these words share their 32 bits and shard
    monkeypatch.setattr(lookup, "shards_for", lambda d: shards)
    words = [f"q{i}" for i in range(1_500_000)]
    h = textscan.scan(pa.array([" ".join(words)]), lower=True).hash
    short = (h % np.uint64(shards)) << np.uint64(32) | h >> np.uint64(32)
    order = np.argsort(short)
    k = np.flatnonzero(short[order][1:] == short[order][:-1])[0]
    a, b = words[order[k]], words[order[k + 1]]
    texts = [f"{a} u v", f"{a} w {b}", f"{a} u {a} u", f"{b} z", "v z", None, ""]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = sorted(c.execute(lm.SQL).fetchall())
    assert sorted(map(tuple, lm.digest(_docs(spark, *texts)).collect())) == want


def test_lm_scores_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    r = np.random.default_rng(2)
    docs = _docs(spark, *[" ".join(f"w{k}" for k in r.integers(0, 60, 80)) for _ in range(40)], None, "")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for shards in (1, 5, 64):
        monkeypatch.setattr(lookup, "shards_for", lambda d, n=shards: n)
        seen.append(sorted(map(tuple, lm.digest(docs).collect())))
    assert seen[0] == seen[1] == seen[2]
    assert lookup.shards_for(docs) == 64 and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_empty_tables(spark):
    d = _docs(spark, "x").limit(0)
    for f in (bpe.digest, secrets.digest, quality.digest, mixing.digest, jaccard.digest, lm.digest):
        assert f(d).count() == 0
