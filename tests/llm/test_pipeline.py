from collections import Counter

import corpus_pipeline as pipeline
from lineweave.llm import mixing, quality
from lineweave.storage import written

CLASH = "doc_id long, text string, source string, row_key int, copies string, __n_words int, member int, n_words string"


def _text(k):
    return " ".join(f"d{k}w{i}" for i in range(60))


def _docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, 1, "c", 2, 3, "x") for i, t, s in rows], CLASH)


def test_null_and_repeated_ids_lose_no_document_and_add_none(spark):
    rows = [(None, _text(k), "s") for k in range(6)] + [(None, _text(0), "s"), (7, _text(10), "s"), (7, _text(10), "s"), (7, _text(11), "s"), (8, _text(12), "s"), (5, _text(12), "s"), (None, _text(12), "s"), (None, None, "s"), (9, "", None)]
    docs = _docs(spark, *rows)
    kept = written(pipeline.near_duplicates(spark, docs, ""))
    assert kept.columns == docs.columns
    want = Counter([*((None, _text(k)) for k in range(6)), (7, _text(10)), (7, _text(11)), (5, _text(12)), (None, None), (9, "")])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    mixed = pipeline.source_mix(spark, kept.filter("source = 's'"), "")
    assert mixed.columns == docs.columns
    # one source only: its target is its size, so each row is taken once
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == want - Counter([(9, "")])


def test_every_stage_keeps_columns_and_empty_tables(spark):
    docs = _docs(spark, (1, _text(1), "s"), (2, "too short", "s"), (3, None, None))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        if name != "encoded":
            assert stage(spark, docs, "").columns == docs.columns
    assert [r.doc_id for r in quality.apply_policy(docs).collect()] == [1]


def test_sampling_equals_brute_force(spark):
    """Each source's copies are the whole numbers that the running sum of expected copies crosses from its offset."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ("a", "b", None)[i % 7 % 3]) for i in range(500)] + [(3, None, "a"), (None, "w w", "b"), (None, "w w", "b")]
    got = mixing.copies(_docs(spark, *rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    whole, weight = sum(size.values()), {"a": 1, "b": 2, None: 3}
    target, open_, left = {}, set(size), float(whole)
    while True:  # water filling, source by source
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    for s in size:
        mine = [r for r in got if r.source == s]
        each = target[s] / size[s]
        assert len(mine) == sum(x == s for _, _, x in rows) and all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in mine)
        assert {r.copies for r in mine} <= {int(each), int(each) + 1} and abs(sum(r.copies for r in mine) - each * len(mine)) <= 1
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 2 * 23


def test_rows_without_an_id_are_spread_over_slices(spark):
    rows = [(None, f"w{i} w", "a") for i in range(600)]
    found = mixing._sliced(_docs(spark, *rows), "source", "text", "doc_id", 1, []).groupBy("source", "class", "slice").count().collect()
    assert sum(r["count"] for r in found) == 600 and max(r["count"] for r in found) <= 20
    assert len(mixing.copies(_docs(spark, *rows)).collect()) == 600
