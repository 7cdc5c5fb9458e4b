import random

import numpy as np
from conftest_llm import rows_of

from lodestrand.llm import toxicity


def made(n, seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 60))]
        bad = int(r.random() < 0.3)
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["foul", "nasty", "vile"])
        rows.append((i, " ".join(words), bad))
    return rows


def test_held_out_accuracy_and_sparsity(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 1000], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.index) < 2000
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 1000]
    assert sum(a == y for a, y in held) / len(held) > 0.97


def test_the_learner_against_plain_python():
    """The vectorised update is the published one, coordinate by coordinate."""
    p = toxicity.Params(bits=4, l1=0.5, epochs=2)
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 16, 4)).astype(np.int32) for _ in range(40)]
    y = r.integers(0, 2, 40)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, t in zip(rows, y):
            ws = {int(i): weight(i) for i in x}
            wb = -zb / ((p.beta + nb**0.5) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-(sum(ws.values()) + wb))) - t
            for i, w in ws.items():
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i] += g - s * w
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / p.alpha * wb
            nb += g * g
    live, w, bias = toxicity.ftrl(rows, y, p)
    want = {i: weight(i) for i in range(16) if weight(i)}
    assert set(live.tolist()) == set(want)
    assert all(abs(want[i] - x) < 1e-5 for i, x in zip(live.tolist(), w.tolist()))
    assert abs(bias + zb / ((p.beta + nb**0.5) / p.alpha + p.l2)) < 1e-9


def test_every_row_has_a_result(spark, corpus, corpus_rows):
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(100)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(corpus, labels)
    got = toxicity.toxicity(corpus, model)
    assert sorted([r["doc_id"] for r in got.collect()], key=repr) == sorted([r[0] for r in corpus_rows], key=repr)
    wordless = [r for r in got.collect() if r["doc_id"] in (400, 401, 402, 403, 404)]
    assert all(r["p"] == 0 and r["toxic"] == 0 for r in wordless)
    kept = toxicity.reject_toxic(corpus, model)
    assert kept.columns == corpus.columns
    toxic = got.where("toxic = 1").count()
    assert kept.count() == len(corpus_rows) - toxic


def test_no_label_and_empty_tables(spark, corpus, corpus_rows, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(corpus, none)
    assert len(model.index) == 0 and toxicity.reject_toxic(corpus, model).count() == len(corpus_rows)
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.train(corpus, one_class).index) == 0
    assert toxicity.toxicity(nothing, model).collect() == []
    assert rows_of(toxicity.toxicity(nothing, toxicity.train(nothing, none)), "doc_id") == []
