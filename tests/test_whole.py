"""Queries that have no SQL against plain Python, over whole texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestrand.functions import splitter, vectors
from lodestrand.operators import cases, metrics, records
from lodestrand.operators import retrieval as R

ASSET = f"asset_id string, doc string, page_no int, kind string, caption string, ocr_text string, vlm_summary string, page_type string, key_points array<string>, entities array<string>, visual_elements array<string>, objects array<{records.OBJECT}>"


def assets(spark):
    thing = lambda label, **more: {"label": label, "attributes": None, "description": None, "location": None, "bbox": None, "bbox_region": None, "confidence": None, "source_key": "objects"} | more
    rows = [
        ("a1", "d", 1, "chart", "Caption", "seen  text", None, "plan", [], ["North", "north ", "South"], ["arrow"], [thing("Tower", attributes=["tall", "Tall"], description="tall", location="left"), thing("tower", attributes=["TALL"], description="tall", location="Left"), thing("Tower", bbox=[0.7, 0.7, 0.9, 0.9])]),
        ("a2", "d", 2, "page_image", "", None, " ", None, None, None, None, None),
        ("a3", "e", 7, "map", "Caption", "caption", "word " * 500, None, ["k"], None, None, [thing(" ")]),
    ]
    return spark.createDataFrame(rows, ASSET)


def chunks(spark):
    rows = [("c1", "d", 1, 1, "text", "alpha beta. " * 200, "One > two"), ("c2", "d", 2, 3, "table", "short", None), ("c3", "d", 4, 4, "text", "Page range: 4-4\nhas it", "")]
    return spark.createDataFrame(rows, "chunk_id string, doc string, page_start int, page_end int, kind string, text string, section string")


SAID = {"a1": "Caption\nseen  text\nPage type: plan\nEntities: North; South\nVisual elements: arrow\nObjects: Tower: tall, left; tower: TALL, tall, Left; Tower: lower right", "a3": "Caption\n" + ("word " * 500).strip() + "\nKey points: k"}


def test_what_assets_and_objects_say(spark):
    got = {r[0]: r[1] for r in assets(spark).select("asset_id", records.asset_text()).collect()}
    assert got == SAID | {"a2": ""}
    objects = [(r["object_id"], r["text"]) for r in records.object_records(assets(spark)).orderBy("object_id").collect()]
    tail = "\nPage type: plan\nCaption: Caption"
    assert objects == [
        ("a1:object:0", "Object: Tower\nAttributes: tall\nLocation: left\nSource field: objects" + tail),
        ("a1:object:1", "Object: Tower\nBbox region: lower right\nSource field: objects" + tail),
        ("a1:object:2", "Visual feature: arrow\nFeature type: visual_element\nSource field: visual_elements" + tail),
    ]


def test_strategies_against_plain_python(spark):
    links = spark.createDataFrame([("c1", 1, "a1"), ("c2", 2, "a2"), ("c3", 3, "a1")], "chunk_id string, ord long, asset_id string")
    got = defaultdict(list)
    for r in records.strategies(chunks(spark), assets(spark), links, size=300, overlap=40, least=30).collect():
        got[r["strategy"]].append((r["page_start"], r["kind"], r["text"]))
    lead = {"c1": "Section: One > two\nPage range: 1-1", "c2": "Page range: 2-3", "c3": "Page range: 4-4"}
    rows = {r["chunk_id"]: r for r in chunks(spark).collect()}
    text = {c: rows[c]["text"] if rows[c]["text"].startswith(p) else f"{p}\n{rows[c]['text']}".strip() for c, p in lead.items()}
    context = " ".join(f"- chart page 1: {SAID['a1']}".split())
    context = context if len(context) <= 700 else context[:699].rstrip() + "..."
    seen = {c: t if c == "c2" else f"{t.rstrip()}\n\nVisual context:\n{context}" for c, t in text.items()}
    parts = lambda t: [x[2] for x in splitter.subchunks(t, 300, 40, 30)]

    def pieces(of):
        return [(rows[c]["page_start"], rows[c]["kind"], p) for c in rows for p in parts(of[c])]

    linked = [(1, "figure", f"{lead['c1']}\nVisual asset kind: chart\nAsset page: 1\n{SAID['a1']}")]
    alone = [(7, "map", f"Page range: 7-7\nVisual asset kind: map\nAsset page: 7\n{SAID['a3']}")]
    objects = [(1, "figure", f"{lead['c1']}\nVisual object: {r['o']['label']}\nVisual asset kind: chart\nAsset page: 1\n{r['text']}") for r in records.object_records(assets(spark)).collect()]
    short = {c: " ".join(t.split()) for c, t in text.items()}
    short = {c: t if len(t) <= 900 else t[:899].rstrip() + "..." for c, t in short.items()}
    parents = [(rows[c]["page_start"], "page_summary" if rows[c]["kind"] == "text" else rows[c]["kind"], short[c] + ("" if c == "c2" else f"\n\nVisual context:\n{context}")) for c in rows]
    want = {"page": [(rows[c]["page_start"], rows[c]["kind"], t) for c, t in text.items()], "semantic": pieces(text), "multimodal": pieces(seen) + linked + alone, "object_aware": pieces(seen) + linked + alone + objects, "hierarchical": parents + pieces(seen) + alone}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_terms_are_chosen_from_all_of_an_item(spark):
    nested = [("a" * (100 - i), "a" * (100 - i), i, 9.0) for i in range(90)]
    terms = {1: [*nested, ("late", "late", 95, 2.0), ("later", "later", 96, 1.5), ("other", "other", 97, 1.0)], 2: [("one", "one", 0, 1.0)]}
    df = spark.createDataFrame([(i, *t) for i, own in terms.items() for t in own], "item_id long, term string, key string, pos int, score double")
    got = {r["item_id"]: r["terms"] for r in cases.chosen_terms(df, 3, 1).collect()}
    assert got == {1: ["a" * 100, "late", "other"], 2: ["one"]}


def test_queries_of_documents_against_plain_python(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80)] + ["the", "Table", "1999", "12", "x1b2c3d4e5f6"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(40)]
    keys = {i: list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_./%+-]{2,}|[0-9]+", t))) for i, t in docs}
    fine = lambda k: len(k) > 1 and k not in cases.STOP and not (len(k) >= 12 and re.search(r"\d", k)) and not (k.isdigit() and len(k) != 4)
    keys = {i: [k for k in own if fine(k)] for i, own in keys.items()}
    df = Counter(k for own in keys.values() for k in own)
    score = lambda k: round((math.log((len(docs) + 1) / df[k]) + 1) * min(len(k), 16) / 8 * (0.75 if k.isdigit() else 1), 9)
    want = {i: cases.choose([(k, k, p, score(k)) for p, k in enumerate(own)], 8, 3) for i, own in keys.items()}
    own = cases.drafted(cases.chosen_terms(cases.scored_terms(spark.createDataFrame(docs, "item_id long, text string"))))
    got = {x["item_id"]: (x["terms"], x["query"], round(x["score"], 6)) for x in own.collect()}

    def cut(t):
        return t if len(t) <= 120 else t[:120].rsplit(" ", 1)[0]

    lower = lambda ts: [t.lower() for t in ts]
    assert {i: lower(t) for i, (t, _, _) in got.items()} == {i: [k for k, _ in x] for i, x in want.items() if x}
    assert all(q == cut(" ".join(t)) and abs(s - sum(x for _, x in want[i])) < 1e-5 for i, (t, q, s) in got.items())


def test_greedy_cap_against_plain_python(spark):
    r = random.Random(9)
    rows = [(i, f"c{i}", [f"t{r.randrange(9)}" for _ in range(r.randint(0, 3))]) for i in range(200)]
    seen, want = Counter(), []
    for _, c, ts in rows:
        if all(seen[t] < 4 for t in set(ts)):
            seen.update(set(ts))
            want.append(c)
    got = metrics.greedy_cap(spark.createDataFrame(rows, "ord long, case_id string, targets array<string>").repartition(5), 4).collect()
    assert sorted(x[0] for x in got) == sorted(want)


def test_bootstrap_against_plain_python(spark):
    r = random.Random(2)
    rows = [(a, b, i, r.choice([-1.0, 0.0, 0.5, 1.0])) for a, b in (("x", "y"), ("y", "x")) for i in range(30)] + [("x", "z", 1, 0.25)]
    got = {(x["a"], x["b"]): (x["mean"], x["low"], x["high"]) for x in metrics.bootstrap_interval(spark.createDataFrame(rows, "a string, b string, i int, d double"), ["a", "b"], "d", "i", "mrr").collect()}
    for a, b in (("x", "y"), ("y", "x")):
        own = [d for p, q, _, d in rows if (p, q) == (a, b)]
        name = f"{a}|{b}|mrr"
        g = random.Random(sum((i + 1) * ord(c) for i, c in enumerate(name)))
        means = sorted(sum(own[g.randrange(30)] for _ in range(30)) / 30 for _ in range(1000))
        assert got[a, b] == (sum(own) / 30, means[int(0.025 * 999)], means[int(0.975 * 999)])
    assert got["x", "z"] == (0.25, 0.25, 0.25)


def test_nearest_in_blocks_and_ties(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(5)
    q = v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    m = vectors.unit(np.array([x for _, x in rows]))
    want = {(i, j): (n, s) for i in range(0, 300, 20) for n, (s, j) in enumerate(sorted(((-round(float(m[i] @ m[j]), 9), j) for j in range(300)))[:7], 1)}
    monkeypatch.setattr(vectors, "_HELD", 50)
    for limit in (1 << 20, 100):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
        got = {(x["query_id"], x["item_id"]): (x["rank"], -x["score"]) for x in R.vector_topk(v, q, 7).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_holders_against_plain_python(spark):
    from lodestrand.plans.metric_queries import holders

    r = random.Random(4)
    texts = [(i, r.choice([" ", "\n", "  "]).join("".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 30)))) for i in range(60)]
    queries = [(100 + i, " ".join("".join(r.choice("ab") for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 5)))) for i in range(40)]
    got = {tuple(x) for x in holders(spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")).select("query_id", "item_id").collect()}
    assert got == {(q, i) for q, a in queries for i, t in texts if a in " ".join(t.split())}


def test_search_without_a_source_and_with_one(spark):
    c = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, None)], "item_id long, text string")
    q = spark.createDataFrame([(9, "red pear")], "query_id long, text string")
    got = [(x["item_id"], x["sources"], x["evidence"]) for x in R.hybrid_search(c, q, k=3, dense=False).orderBy("rank").collect()]
    assert got == [(1, ["bm25"], []), (2, ["bm25"], [])]
    p = spark.createDataFrame([(2, 1)], "child_id long, parent_id long")
    got = [(x["item_id"], x["sources"], x["evidence"]) for x in R.hybrid_search(c, q, k=3, parents=p, rerank=True).orderBy("rank").collect()]
    assert got == [(1, ["bm25", "dense", "rerank:lexical"], [2])]

def test_runs_of_the_same_ranks_tie(spark):
    """The gains of equal ranks are equal to the last bit, in whatever order the hits lie."""
    forward, back = list(range(1, 11)), list(range(10, 0, -1))
    cases = spark.createDataFrame([(q,) for q in range(20)], "query_id long")
    targets = spark.createDataFrame([(q, i, False) for q in range(20) for i in range(1, 21)], "query_id long, item_id long, excluded boolean").coalesce(1)
    hits = spark.createDataFrame([(run, q, i, i) for run, order in (("a", forward), ("b", back)) for q in range(20) for i in order], "run string, query_id long, item_id long, rank int").coalesce(1)
    m = metrics.case_metrics(cases, targets, hits, 10, ("run",)).select("run", "query_id", "ndcg").collect()
    assert len({r["ndcg"] for r in m}) == 1 and math.isclose(m[0]["ndcg"], sum(1 / math.log2(i + 1) for i in forward) / 20)
    pairs = metrics.pairwise(metrics.case_metrics(cases, targets, hits, 10, ("run",)), "run", 10).collect()
    assert [(r["wins"], r["ties"]) for r in pairs] == [(0, 20), (0, 20)]


def test_terms_selected_in_place_are_those_of_rows(spark, monkeypatch):
    """Frequent keys at hand, some of them, none: the same choice as by a row for each term; items of several texts, of none, with terms in both cases."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 12))) for _ in range(60)] + ["the", "Table", "1999", "12", "3.5kg", "x1b2c3d4e5f6", "주택", "한국어", "漢字", "deadbeef42", "Über", "a_b|c_d", "-v1.2.3,"]
    docs = [(i % 70, " ".join(w.upper() if r.random() < 0.2 else w for w in (r.choice(words) + ("" if r.random() < 0.7 else str(r.randrange(999))) for _ in range(r.randint(1, 60))))) for i in range(80)] + [(101, None), (102, ""), (103, "zz yy"), (None, "some words that stand alone"), (None, "other words")]
    d = spark.createDataFrame(docs, "item_id long, text string").repartition(3)
    want = {x["item_id"]: (x["terms"], round(x["score"], 6)) for x in cases.chosen_terms(cases.scored_terms(d)).collect() if x["terms"]}
    own = {}
    for x in d.select("item_id", F.explode(cases.term_keys(cases.meaningful_text(F.col("text")))).alias("t")).select("item_id", "t.*").collect():
        own.setdefault(x["item_id"], set()).add(x["key"])
    assert {x["item_id"]: set() for x in cases.scored_terms(d).collect()}.keys() == own.keys()
    keys = defaultdict(set)
    for x in cases.scored_terms(d).collect():
        keys[x["item_id"]].add(x["key"])
    assert dict(keys) == own and len(want) > 60
    for limit in (1 << 20, 400, 0):
        monkeypatch.setattr(cases, "_COMMON_BYTES", limit)
        assert {x["item_id"]: (x["terms"], round(x["score"], 6)) for x in cases.selected_terms(d).collect() if x["terms"]} == want


def test_texts_are_split_once_for_all_strategies(spark):
    """Of three chunks one is seen with more: its two texts are split, the others' once; package chunks are numbered once, however often they are read."""
    from lodestrand.operators.chunks import split_chunks
    from lodestrand.plans import link_queries

    context = spark.createDataFrame([("c1", "what is seen " * 20), ("c3", ""), ("gone", "x")], "chunk_id string, context string")
    plain, seen = records.both_splits(chunks(spark), context, size=300, overlap=40, least=30)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(plain) == rows(split_chunks(chunks(spark), 300, 40, 30)) and rows(seen) == rows(split_chunks(records.with_context(chunks(spark), context), 300, 40, 30))
    assert plain.inputFiles() == seen.inputFiles() and spark.read.parquet(*{f.rpartition("/")[0] for f in plain.inputFiles()}).where("parent_id is null").count() == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(seen)
    p, _, k = link_queries._package_chunks(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(p) and "Window" not in plan(k.select("chunk_id"))


def test_holders_join_and_shuffle_no_texts(spark, monkeypatch):
    """Queries in several blocks, short ones and repeated items among them: each block is a pass over the texts, and only what was found is shuffled."""
    from lodestrand.plans import metric_queries

    texts = spark.createDataFrame([(1, "a b  c d"), (1, "a b c d e"), (2, "xa b c"), (3, None), (4, "c\nd")], "item_id long, text string")
    queries = spark.createDataFrame([(7, "a b c"), (8, "c d"), (9, "b"), (10, " "), (11, "a b c d e f")], "query_id long, text string")
    for limit in (1 << 20, 1):
        monkeypatch.setattr(metric_queries.R, "WEIGHT_BYTES", limit)
        got = metric_queries.holders(texts, queries)
        assert sorted(map(tuple, got.collect())) == [(7, 1), (7, 2), (8, 1), (8, 4), (9, 1), (9, 2)]
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
