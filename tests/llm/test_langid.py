import math
import random
import re
from collections import Counter

from lodestrand.llm import langid


def made(n, seed):
    r = random.Random(seed)
    sounds = {"aa": ["ka", "to", "mi", "ne"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "oux", "ille", "ant"]}
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(1, 4))) for _ in range(150)] for k, v in sounds.items()}
    rows = []
    for i in range(n):
        k = r.choice(sorted(sounds))
        text = " ".join(r.choice(words[k]) if r.random() < 0.8 else "".join(r.choice(sounds[k]) for _ in range(5)) for _ in range(r.randint(5, 30)))
        rows.append((i, text, k))
    return rows


def test_held_out_accuracy(spark):
    rows = made(600, 4)
    docs = spark.createDataFrame([(i, t, k if i < 300 else None) for i, t, k in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in langid.language(docs, langid.train(docs)).collect()}
    assert sum(got[i] == k for i, _, k in rows if i >= 300) / 300 > 0.98


def brute(train, texts, p):
    """The same model with dictionaries of strings."""
    langs = sorted({k for _, k in train})
    counts = [{k: Counter() for k in langs} for _ in range(p.max_n + 1)]
    words = lambda t: re.findall(r"\w+", t.lower())
    for t, k in train:
        for w in words(t):
            counts[0][k][w] += 1
            for n in range(1, p.max_n + 1):
                counts[n][k].update(w[i : i + n] for i in range(len(w) - n + 1))
    score = []
    for n in range(p.max_n + 1):
        every = sum(counts[n].values(), Counter())
        kept = {x for x, c in every.items() if c >= p.min_count}
        total = {k: sum(counts[n][k][x] + p.smooth for x in kept) for k in langs}
        score.append({x: [math.log((counts[n][k][x] + p.smooth) / total[k]) for k in langs] for x in kept})
    out = []
    for t in texts:
        got = []
        for w in words(t):
            if w in score[0]:
                got.append(score[0][w])
                continue
            for n in range(p.max_n, 0, -1):
                hits = [score[n][w[i : i + n]] for i in range(len(w) - n + 1) if w[i : i + n] in score[n]]
                if hits:
                    got.append([sum(c) / len(hits) for c in zip(*hits)])
                    break
        if not got:
            out.append(("und", 0.0))
            continue
        mean = [sum(c) / len(got) for c in zip(*got)]
        best = max(range(len(langs)), key=lambda i: mean[i])
        out.append((langs[best], sorted(mean)[-1] - sorted(mean)[-2]))
    return out


def test_against_dictionaries(spark):
    rows = made(200, 9) + [(900, "zzz 123", "aa"), (901, "KA to MI unseenword", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r["doc_id"]: (r["lang"], r["margin"]) for r in langid.language(docs, model).collect()}
    for (i, *_), (lang, margin) in zip(rows, brute([(t, k) for _, t, k in rows], [t for _, t, _ in rows], model.params)):
        assert got[i][0] == lang and abs(got[i][1] - margin) < 1e-4


def test_edge_cases(spark, corpus, corpus_rows, nothing):
    model = langid.train(corpus)
    got = langid.language(corpus, model).collect()
    assert sorted([r["doc_id"] for r in got], key=repr) == sorted([r[0] for r in corpus_rows], key=repr)
    assert all(r["lang"] == "und" and r["margin"] == 0 for r in got if r["doc_id"] in (400, 401, 402, 403, 404))
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, "more", "")], "doc_id long, text string, lang string")
    empty = langid.train(unlabelled)
    assert [r["lang"] for r in langid.language(unlabelled, empty).collect()] == ["und", "und"]
    assert langid.language(nothing, langid.train(nothing)).collect() == []
    same = spark.createDataFrame([(1, "tie tie tie", "b"), (2, "tie tie tie", "a")], "doc_id long, text string, lang string")
    assert {r["lang"] for r in langid.language(same, langid.train(same)).collect()} == {"a"}


def test_every_word_of_min_count_is_known(spark):
    r = random.Random(6)
    words = {k: ["".join(r.choice(v) for _ in range(6)) for _ in range(30_000)] for k, v in (("aa", "abcdefghij"), ("bb", "efghijklmno"))}
    rows = []
    for k, own in words.items():
        for _ in range(3):
            r.shuffle(own)
            rows += [(len(rows) + i, " ".join(own[i * 100 : i * 100 + 100]), k) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    texts = [t for _, t, _ in rows[::90]] + [w for k in words for w in words[k][:200]]
    tests = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["lang"], x["margin"]) for x in langid.language(tests, model).collect()}
    for i, (lang, margin) in enumerate(brute([(t, k) for _, t, k in rows], texts, model.params)):
        assert got[i][0] == lang and abs(got[i][1] - margin) < 1e-4
