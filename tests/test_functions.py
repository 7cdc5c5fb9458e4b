import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import filters, ids, splitter, text
from lodestrand.operators import cases, graph, links, metrics, visual
from lodestrand.operators import retrieval as R
from lodestrand.plans.text_queries import parse_ranges


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text_quality_of_odd_pages(spark):
    rows = [(1, None), (2, "   "), (3, "ab\x01" * 30), (4, "#" * 50), (5, "plain text of a page")]
    got = {r["i"]: r["q"] for r in spark.createDataFrame(rows, "i int, t string").select("i", text.text_quality(F.col("t")).alias("q")).collect()}
    assert [got[i]["quality"] for i in range(1, 6)] == ["empty", "empty", "degraded", "degraded", "good"]
    assert got[3]["reasons"] == ["high_control_char_ratio"] and got[4]["reasons"] == ["low_letter_or_number_ratio"]


def test_pieces_stay_within_bounds_and_lose_nothing():
    r = random.Random(5)
    for _ in range(60):
        t = " ".join("".join(r.choice("abcde.") for _ in range(r.randint(1, 12))) + r.choice(["", ".", "\n\n", "\n1. x"]) for _ in range(r.randint(1, 900)))
        parts = splitter.split_text(t, 300, 40)
        assert all(0 < len(p) <= 345 for p in parts)
        assert {w for w in re.findall(r"[a-e]{4,}", t)} <= {w for p in parts for w in re.findall(r"[a-e]{4,}", p)} | set(re.findall(r"[a-e]{4,}", " ".join(parts)))
    assert splitter.split_text(None) == [] and splitter.split_text("  ") == [] and splitter.split_text("one") == ["one"]


def test_a_short_tail_joins_the_piece_before():
    t = ("word " * 100).strip() + "\n\ntail"
    got = splitter.subchunks(t, 500, 0, 50)
    assert len(got) == 1 and got[0][:2] == (0, 2) and got[0][2].endswith("tail")


def test_identities(spark):
    assert one(spark, ids.uuid5_url(F.lit("http://a.example/x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://a.example/x"))
    import hashlib

    for w in ("alpha", "ß", "東"):
        assert one(spark, ids.hash_slot(F.lit(w))) == int(hashlib.sha256(w.encode()).hexdigest(), 16) % 384
    v = np.array(one(spark, ids.image_vector(F.lit(b"picture"))))
    assert abs(np.linalg.norm(v) - 1) < 1e-5
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, ids.cosine(a, a)) == 1.0 and one(spark, ids.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_page_range_specs():
    assert parse_ranges("1-3, 7") == [1, 2, 3, 7]
    for bad in ("3-1", "x", "0", "1-"):
        with pytest.raises(ValueError):
            parse_ranges(bad)


def test_payload_filters(spark):
    assert filters.parse(["a>=1", "a<5", 'b="x"', "c=plain"]) == {"a": {"gte": 1, "lt": 5}, "b": "x", "c": "plain"}
    for bad in (["a"], ["a>x"], ["a>=1", "a>=2"], ["a=1", "a>2"]):
        with pytest.raises(ValueError):
            filters.parse(bad)
    df = spark.createDataFrame([(1, ["x", "y"], '{"k": 3, "s": "v"}'), (2, None, '{"k": "3"}'), (None, ["z"], None)], "a int, tags array<string>, p string")
    n = lambda c: [r["a"] for r in df.where(c).collect()]
    assert n(filters.condition({"tags": "x"}, arrays=("tags",))) == [1]
    assert n(filters.condition({"tags": ["z", "x"]}, arrays=("tags",))) == [1, None]
    assert n(filters.condition({"a": {"gte": 2}})) == [2] and n(filters.condition({"a": None})) == [None]
    assert n(filters.json_condition({"k": 3}, F.col("p"))) == [1, 2] and n(filters.json_condition({"s": "v"}, F.col("p"))) == [1]


def test_model_answers():
    p = visual.parse_output
    assert p('x ```json\n{"a": 1}\n``` y') == ("json_object", '{"a": 1}') and p("[1, 2]")[0] == "json_list" and p("``` 3 ```")[0] == "json_scalar"
    assert p('so {"a": {"b": [1, 2]}} there') == ("json_object", '{"a": {"b": [1, 2]}}')
    assert p('{"title": "b \\"q\\"", "entities": ["x", "X ", "y\\n z", "cut') == ("json_repaired", '{"entities": ["x", "y z"], "title": "b \\"q\\""}')
    assert p('{"key_points": ["1", "2", "3", "4", "5", "6"') == ("json_repaired", '{"key_points": ["1", "2", "3", "4", "5"]}')
    assert p('{"title": "cut in the mid') == p('{"page_type": "map", "x') == p(None) == p("") == p("3") == p("nothing { here") == ("raw_text", None)
    long = '{"title": "t", "summary": "' + "a[" * 200_000
    assert p(long) == ("json_repaired", '{"title": "t"}')


def test_terms_are_chosen_without_overlap():
    term = lambda x, pos, score: (x, x.lower(), pos, score)
    own = [term("engine", 0, 3.0), term("Engines", 1, 2.9), term("oil", 2, 1.0), term("gear", 3, 0.5)]
    assert cases.choose(own, 2, 1) == [("engine", 3.0), ("oil", 1.0)] and cases.choose(own, 8, 3) == [("engine", 3.0), ("oil", 1.0), ("gear", 0.5)]
    assert cases.choose(own[:2], 8, 2) == [("engine", 3.0), ("Engines", 2.9)] and cases.choose(own[:2], 8, 3) == []
    assert cases.choose([*own[:2], term("x" * 20, 2, 9.0)], 8, 3) == [("engine", 3.0), ("Engines", 2.9), ("x" * 20, 9.0)]


def test_salient_terms(spark):
    assert one(spark, cases.salient_terms(F.lit("The engine: ENGINE, 12 1999 a1 deadbeef01 abcd x1b2c3d4e5f6 oil/ 3.5% table 개요 주택 v1.2"))) == ["the", "engine", "1999", "abcd", "oil", "3.5%", "주택", "v1.2"]


def test_entity_names(spark):
    assert one(spark, graph.norm_entity(F.lit(' "ＡＢ  c" '))) == "AB c"


def test_empty_corpus_has_no_hits(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    q = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert R.bm25_topk(R.postings(none), q, 3).collect() == [] and R.dense_topk(none, q, 3).collect() == [] and R.dense_topk(q.withColumnRenamed("query_id", "item_id"), q.limit(0), 3).collect() == []
    assert R.bm25_topk(R.postings(q.select(F.col("query_id").alias("item_id"), "text")), none.select(F.col("item_id").alias("query_id"), "text"), 3).collect() == []


def test_bm25_against_plain_python(spark):
    import math

    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12)))) for i in range(30)]
    qs = [(i, " ".join(r.choice("abcdefghz") for _ in range(4))) for i in range(6)]
    toks = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for w in "abcdefgh"}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for q, t in qs:
        for i, d in toks.items():
            s = sum((idf[w] if idf[w] >= 0 else low) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in t.split() if w in idf)
            s = max(s, 0) + len(set(t.split()) & set(d)) / len(set(t.split()))
            if s > 0:
                want[q, i] = round(s, 9)
    got = {(x["query_id"], x["item_id"]): round(x["score"], 9) for x in R.bm25_topk(R.postings(spark.createDataFrame(docs, "item_id long, text string")), spark.createDataFrame(qs, "query_id long, text string"), 99).collect()}
    assert got == want


def test_rank_fusion(spark):
    hits = spark.createDataFrame([(1, 10, 1, 2.0, "bm25"), (1, 11, 2, 1.0, "bm25"), (1, 11, 1, 0.9, "dense"), (1, 12, 1, 5.0, "graph")], "query_id long, item_id long, rank int, score double, source string")
    w = spark.createDataFrame([("lexical", 9.0), ("bm25", 2.0), ("graph", 0.0)], "source string, weight double")
    got = [(r["item_id"], round(r["score"], 9), r["sources"]) for r in R.fuse(hits, 5, w).orderBy("rank").collect()]
    assert got == [(11, round(2 / 62 + 1 / 61, 9), ["bm25", "dense"]), (10, round(2 / 61, 9), ["bm25"])]


def test_a_missing_metric_fails_its_check(spark):
    actual = spark.createDataFrame([("recall", 0.9), ("rank", None)], "metric string, actual double")
    rules = spark.createDataFrame([("a", "recall", ">=", 0.8), ("b", "rank", "<=", 3.0), ("c", "none", ">=", 0.0)], "name string, metric string, operator string, threshold double")
    checks = metrics.gate(actual, rules)
    assert {r["name"]: r["passed"] for r in checks.collect()} == {"a": True, "b": False, "c": False}
    assert metrics.report(checks).first()["passed"] is False


def test_delta_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, None)], "k int, v string")
    assert {(r["k"], r["change"]) for r in links.delta(a, b, "k").collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_components_of_a_long_path_and_loops(spark):
    from lodestrand.operators.components import connected_components

    e = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == 500 and got[600] == got[601] == 600
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hashed_vectors_and_counts_against_plain_python_and_remember_nothing():
    import hashlib
    import re
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from lodestrand.functions import batches, vectors

    odd = [None, "", "   ", "KK İx ſ a\nB\x1cc", "가나 다A_1 a a", "　x y　", *(f"t{i} t{i} word" for i in range(3000))]
    want = np.zeros((len(odd), 384))
    for i, t in enumerate(odd):
        for w in (t or "").split():
            want[i, int.from_bytes(hashlib.sha256(w.encode()).digest(), "big") % 384] += 1
    assert np.array_equal(vectors.hashed(odd), vectors.unit(want)) and vectors.hashed([]).shape == (0, 384)
    assert not [x for x in vars(vectors).values() if isinstance(x, dict) and len(x) > 1000 and "t5" in str(list(x)[:9])]  # no table of tokens that grows with the corpus
    row, code, n, words = batches.counted(pa.array(odd))
    got = [Counter() for _ in odd]
    for i, j, k in zip(row.tolist(), words.take(pa.array(code)).to_pylist(), n.tolist()):
        got[i][j] = k
    assert got == [Counter(w.lower() for w in re.findall("[가-힣A-Za-z0-9_]+", t or "")) for t in odd]
    parts = list(batches.slices(pa.RecordBatch.from_pydict({"text": ["x" * 10, "y" * 5000, "z"] * 50}), 7, 2000))
    assert sum(p.num_rows for p in parts) == 150 and all(p.num_rows <= 7 and (p.num_rows == 1 or p.nbytes <= 2000) for p in parts)


def test_term_counts_are_not_shuffled_but_for_items_of_several_texts(spark):
    from lodestrand.operators import retrieval as R

    docs = [(1, "A a b"), (2, ""), (3, None), (4, "x\ny X"), (None, "n n")]
    d = spark.createDataFrame(docs, "item_id long, text string").repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = R.term_counts(d)
    assert rows(got) == sorted([(1, "a", 2), (1, "b", 1), (4, "x", 2), (4, "y", 1), (None, "n", 2)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "hashpartitioning" not in plan
    more = d.unionByName(spark.createDataFrame([(4, "x z"), (None, "n m")], "item_id long, text string"))
    assert rows(R.term_counts(more)) == sorted([(1, "a", 2), (1, "b", 1), (4, "x", 3), (4, "y", 1), (4, "z", 1), (None, "n", 3), (None, "m", 1)], key=str)
