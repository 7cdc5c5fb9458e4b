import random
from collections import Counter, defaultdict

import numpy as np

from lodestrand.llm import packing


def brute_place(sizes, window):
    """Every level tried for every piece, the sum of squares written out."""
    level, at, where, slots, n = [0] * (window + 1), defaultdict(list), [], [], 0
    filled = Counter()
    for s in sizes:
        best = None
        for h in [*range(window - s, 0, -1), 0]:
            if h and not level[h]:
                continue
            after = level[:]
            if h:
                after[h] -= 1
            if h + s < window:
                after[h + s] += 1
            cost = sum(x * x for x in after[1:window])
            if best is None or cost < best[0]:
                best = (cost, h)
        h = best[1]
        if h:
            w = at[h].pop()
            level[h] -= 1
        else:
            w, n = n, n + 1
        where.append(w)
        slots.append(filled[w])
        filled[w] += 1
        if h + s < window:
            at[h + s].append(w)
            level[h + s] += 1
    return where, slots, n


def test_each_placement_against_all_levels():
    r = random.Random(6)
    for window in (2, 5, 16, 40):
        for _ in range(6):
            sizes = [r.randint(1, window - 1) for _ in range(120)]
            w, s, n = packing.place(np.array(sizes), window)
            assert (w.tolist(), s.tolist(), int(n)) == brute_place(sizes, window)


def check(got, sizes, window):
    fill, slots, pieces = Counter(), defaultdict(list), defaultdict(list)
    for r in got:
        fill[r["shard"], r["window"]] += r["tokens"]
        slots[r["shard"], r["window"]].append(r["slot"])
        pieces[r["doc_id"]].append((r["start"], r["tokens"]))
    assert all(x <= window for x in fill.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: v for k, v in sizes.items() if v}
    return fill


def test_every_token_once(corpus, corpus_rows):
    got = packing.pack(corpus, window=64).collect()
    sizes = Counter()
    for i, text, *_ in corpus_rows:
        sizes[i] += len((text or "").split())
    fill = check(got, sizes, 64)
    assert sum(fill.values()) / (64 * len(fill)) > 0.95


def test_pieces_of_a_long_document_follow_each_other(corpus):
    got = sorted((r["start"], r["tokens"]) for r in packing.pack(corpus, window=1000).where("doc_id = 406").collect())
    assert got == [(1000 * i, 1000) for i in range(30)]


def test_many_shards(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 97 as int)) as text")
    got = packing.pack(docs, window=128, shard_tokens=10_000).collect()
    assert len({r["shard"] for r in got}) > 5
    fill = check(got, {i: 1 + i % 97 for i in range(3000)}, 128)
    # each of so small shards leaves some windows partly filled; one large shard hardly any in proportion
    assert sum(fill.values()) / (128 * len(fill)) > 0.88
    whole = check(packing.pack(docs, window=128).collect(), {i: 1 + i % 97 for i in range(3000)}, 128)
    assert sum(whole.values()) / (128 * len(whole)) > 0.97


def test_same_result_again(corpus):
    a, b = (sorted(map(repr, packing.pack(x, window=64).collect())) for x in (corpus, corpus.repartition(7)))
    assert a == b


def test_empty_table(nothing):
    assert packing.pack(nothing).collect() == []
