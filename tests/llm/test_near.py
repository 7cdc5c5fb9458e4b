import random
import re

import numpy as np
from conftest_llm import near_text, rows_of

from lodestrand.llm import near


def grams(text, n):
    w = re.findall(r"[^\W]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, t):
    sets = {}
    for i, text, *_ in rows:
        if i is not None and grams(text, n):
            sets.setdefault((i, grams(text, n)), i)
    keys, out = list(sets), set()
    for x, (i, a) in enumerate(keys):
        for j, b in keys[x + 1 :]:
            if i != j and len(a & b) / len(a | b) >= t:
                out.add((min(i, j), max(i, j)))
    return out


def expected(rows, n, t):
    """{doc_id: (class_id, n_links)} by all pairs of (doc_id, set)."""
    nodes = sorted({(i, grams(text, n)) for i, text, *_ in rows if i is not None}, key=lambda x: x[0])
    links, parent = {i: 0 for i, _ in nodes}, {i: i for i, _ in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(nodes):
        for j, b in nodes[x + 1 :]:
            if a and b and len(a & b) / len(a | b) >= t:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (find(i), links[i]) for i in links}


def told(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def random_groups(seed=8):
    r = random.Random(seed)
    rows = []
    for g in range(40):
        base = ["v%d" % r.randrange(300) for _ in range(r.randint(4, 60))]
        rows += [(10 * g + k, near_text(r, base, r.randint(0, 4))) for k in range(6)]
    return rows


def test_all_documents_of_the_fixture(corpus, corpus_rows):
    got = near.near(corpus)
    assert got.columns == ["doc_id", "class_id", "n_links"] and got.count() == len({r[0] for r in corpus_rows if r[0] is not None})
    assert told(got) == expected(corpus_rows, near.N, near.T)


def test_many_random_pairs_and_overlaps(spark):
    rows = random_groups()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, t in ((3, 0.6), (2, 0.3), (1, 0.8)):
        assert told(near.near(df, n, t)) == expected(rows, n, t)
    text, got = dict(rows), near.near_pairs(df).collect()
    rep = {r["doc_b"]: r["doc_a"] for r in got if grams(text[r["doc_a"]], 3) == grams(text[r["doc_b"]], 3)}
    of = {i: [j for j in text if rep.get(j, j) == i] for i in text}
    assert {(min(x, y), max(x, y)) for r in got for x in of[rep.get(r["doc_a"], r["doc_a"])] for y in of[rep.get(r["doc_b"], r["doc_b"])] if x != y} == brute(rows, 3, 0.6)
    for row in got:
        a, b = grams(text[row["doc_a"]], 3), grams(text[row["doc_b"]], 3)
        assert row["doc_a"] < row["doc_b"] and (row["overlap"], row["size_a"], row["size_b"]) == (len(a & b), len(a), len(b)) and abs(row["jaccard"] - len(a & b) / len(a | b)) < 1e-6


def test_one_group_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "_BUCKET_GRAMS", 50)
    r = random.Random(3)
    base = ["v%d" % i for i in range(60)]
    rows = [(k, near_text(r, base, k % 5)) for k in range(60)] + random_groups(4)
    rows = [(i, x[1]) for i, x in enumerate(rows)]
    assert told(near.near(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows, near.N, near.T)


def one_large_group(seed, variants):
    """Variants of one text, some of which are copies of another, two texts that share a half of it, and small groups."""
    r = random.Random(seed)
    base = ["v%d" % i for i in range(40)]
    other = base[:25] + ["o%d" % i for i in range(15)]
    texts = [near_text(r, base, k % 6) for k in range(variants)] + [near_text(r, other, k % 4) for k in range(variants // 3)]
    texts += texts[::9] + [x[1] for x in random_groups(seed)[:60]]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_a_large_group_gives_no_row_for_each_pair(spark, monkeypatch):
    rows, written, counts = one_large_group(5, 300), near.written, []

    def counted(df, **options):
        out = written(df, **options)
        counts.append(out.count())
        return out

    monkeypatch.setattr(near, "written", counted)
    assert told(near.near(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows, near.N, near.T)
    assert max(counts) < 40 * len(rows), counts


def test_a_large_group_in_blocks(spark, monkeypatch):
    rows = one_large_group(6, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = expected(rows, near.N, near.T), brute(rows, near.N, near.T)
    for short, block, strip in ((4, 600, 3), (10, 2000, 512), (40, 1500, 7)):
        monkeypatch.setattr(near, "_SHORT", short)
        monkeypatch.setattr(near, "_CELL_GRAMS", block)
        monkeypatch.setattr(near, "_SET_GRAMS", 30)
        monkeypatch.setattr(near, "_STRIP", strip)
        assert told(near.near(df)) == want
    text, got = dict(rows), near.near_pairs(df).collect()
    rep = {r["doc_b"]: r["doc_a"] for r in got if r["jaccard"] == 1.0}
    assert {(r["doc_a"], r["doc_b"]) for r in got if r["jaccard"] < 1} == {(x, y) for x, y in pairs if x not in rep and y not in rep}
    for row in got:
        a, b = grams(text[row["doc_a"]], 3), grams(text[row["doc_b"]], 3)
        assert (row["overlap"], row["size_a"], row["size_b"]) == (len(a & b), len(a), len(b))


def test_a_document_of_several_texts_joins_its_classes(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a), (2, a), (5, b), (9, b), (7, "x y z")]
    got = told(near.near(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected(rows, near.N, near.T) == {2: (2, 1), 5: (2, 2), 9: (2, 1), 7: (7, 0)}


def test_keep_one(corpus, corpus_rows):
    out = near.keep_one(corpus)
    assert out.columns == corpus.columns
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in brute(corpus_rows, near.N, near.T):
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    want = sorted(((r[0], r[1]) for r in corpus_rows if r[0] is None or find(r[0]) == r[0]), key=repr)
    assert rows_of(out, "doc_id", "text") == want


def test_empty_table(nothing, spark):
    assert near.near(nothing).collect() == [] and near.keep_one(nothing).collect() == []
    lone = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert told(near.near(lone)) == {1: (1, 0), 2: (2, 0)} and near.near_pairs(lone).collect() == [] and near.keep_one(lone).count() == 2


def test_squeeze_round_trip():
    for a in (np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64), np.array([1 << 63, 3], np.uint64)):
        assert (near.unsqueeze(near.squeeze(a)) == a).all()
