import random

import numpy as np
import pandas as pd

from conftest_llm import rows_of

from lodestrand.llm import exact


def test_copies_against_brute_force(corpus, corpus_rows):
    first, count = {}, {}
    for i, text, *_ in corpus_rows:
        if text is not None and i is not None:
            first[text] = min(first.get(text, i), i)
    got = exact.copies(corpus).collect()
    assert len(got) == len(corpus_rows)
    for i, text, *_ in corpus_rows:
        if text is not None:
            count[text] = count.get(text, 0) + 1
    assert sum(r["is_copy"] for r in got) == sum(n - 1 for n in count.values())
    want = sorted(((i, first.get(text) if text is not None else i) for i, text, *_ in corpus_rows), key=repr)
    assert rows_of(exact.copies(corpus), "doc_id", "keep_id") == want


def test_dedup_keeps_columns_and_the_smallest_id(corpus, corpus_rows):
    out = exact.dedup_rows(corpus)
    assert out.columns == corpus.columns
    want = {}
    for i, text, *_ in corpus_rows:
        if text is not None:
            want[text] = min([x for x in (want.get(text), i) if x is not None], default=None)
    want = sorted([(i, t) for t, i in want.items()] + [(r[0], None) for r in corpus_rows if r[1] is None], key=repr)
    assert rows_of(out, "doc_id", "text") == want


def test_empty_table(nothing):
    assert exact.copies(nothing).collect() == [] and exact.dedup_rows(nothing).collect() == []


def test_columns_that_have_no_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert [r["doc_id"] for r in exact.dedup_rows(df).collect()] == [1]


def keys(*names):
    return np.array([int.from_bytes(exact.digest(str(x))[:8], "big") for x in names], np.uint64)


def test_filter_insertion_and_deletion():
    r = random.Random(1)
    index, live = exact.CuckooIndex(2), set()
    for _ in range(300):
        batch = {r.randrange(4000) for _ in range(r.choice([1, 7, 100]))}
        if r.random() < 0.6:
            index.insert(keys(*sorted(batch - live)))
            live |= batch
        else:
            index.delete(keys(*sorted(batch & live)))
            live -= batch
        if live:
            assert index.suspects(keys(*live)).all()
        assert sorted(index.keys().tolist()) == sorted(keys(*live).tolist()) and (index.filter.table != 0).sum() == len(live)
    assert index.resizes > 3
    others = keys(*range(10_000, 30_000))
    assert index.suspects(others).mean() < 0.01
    index.delete(keys(*live))
    assert not index.filter.table.any() and not index.suspects(keys(*live)).any()


def test_two_digests_of_one_key():
    k = np.array([77 << 48 | 5], np.uint64)
    index = exact.CuckooIndex()
    index.insert(k)
    index.insert(k)
    index.delete(k)
    assert index.suspects(k).all() and index.keys().tolist() == k.tolist()
    index.delete(k)
    assert not index.suspects(k).any()


def test_stream_suspects_every_repeat():
    r = random.Random(2)
    xs = [r.randrange(3000) for _ in range(5000)]
    own = keys(*xs)
    found = set(exact._stream(exact.CuckooIndex(), pd.Series(own.view(np.int64))).tolist())
    again = {int(k) for k, n in zip(*np.unique(own, return_counts=True)) if n > 1}
    assert again <= found and len(found - again) < 30


def live(index, spark):
    return sorted(r["keep_id"] for r in index.live(spark).collect())


def test_changes_to_a_written_index(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    first = docs((1, "a"), (2, "b"), (3, None), (4, ""))
    index, new = exact.apply_changes(None, first)
    assert rows_of(new, "doc_id", "keep_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    index, new = exact.apply_changes(index, docs((5, "a"), (6, "c"), (7, "c"), (9, "d")), withdrawn=spark.createDataFrame([(2,), (None,), (99,)], "doc_id long"))
    assert rows_of(new, "doc_id", "keep_id") == [(5, 1), (6, 6), (7, 6), (9, 9)]
    index, new = exact.apply_changes(index, docs((8, "b"), (10, "a")), withdrawn=spark.createDataFrame([(1,)], "doc_id long"))
    assert rows_of(new, "doc_id", "keep_id") == [(10, 10), (8, 8)]
    assert live(index, spark) == [4, 6, 8, 9, 10]
    held = {s: f["keys"] for f in index.filters_of(spark, list(index.filters)).collect() for s in [f["shard"]]}
    assert sum(len(k) for k in held.values()) == 8 * 5
    # a document that was withdrawn comes back, and an untouched shard's filter is the one written before
    before = dict(index.filters)
    index, new = exact.apply_changes(index, docs((2, "b")), withdrawn=spark.createDataFrame([(8,)], "doc_id long"))
    assert rows_of(new, "doc_id", "keep_id") == [(2, 2)] and live(index, spark) == [2, 4, 6, 9, 10]
    assert sum(before[s] is not index.filters[s] for s in before) <= 1
    assert live(index.compact(spark), spark) == [2, 4, 6, 9, 10]


def test_a_row_that_is_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(exact, "_RUN", 8)
    df = spark.createDataFrame([(3, "same")] * 30 + [(5, "same")] * 3, "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["is_copy"]) for r in exact.copies(df).collect()) == [(3, 3, 0)] + [(3, 3, 1)] * 29 + [(5, 3, 1)] * 3
