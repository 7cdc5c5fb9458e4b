"""The functions registered for SQL against the columns they stand for."""

from pyspark.sql import functions as F

from lodestrand.functions import ids, register, text, vectors
from lodestrand.functions.splitter import split_text


def test_sql_functions_give_what_the_columns_give(spark):
    register.register(spark)
    rows = [None, "", " ", "bm25", "bm25:de", "Lexical:x", " dense ", "caption_dense", "triple_dense", "rerank:a", "graph", "Some 'Name'  of\tit", "\"`Quoted`\"", "Located In__the-City_", "#" * 50, "ab\x01" * 30, "plain text of a page, 주택 one_two", "word " * 900]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    x = F.col("x")
    want = {"lex_tokens": text.word_tokens(x), "norm_entity": text.normalise_entity(x), "norm_predicate": text.normalise_predicate(x), "source_family": text.source_family(x), "uuid5_url": ids.uuid5_url(x), "text_quality": text.text_quality(x)["quality"], "hash_embed": vectors.hashed_vector(x)}
    for name, column in want.items():
        for r in df.select(x, column.alias("a"), F.expr(f"{name}(x)").alias("b")).collect():
            assert r["a"] == r["b"] or r["x"] is None, (name, r)
    assert {r["x"]: r["b"] for r in df.selectExpr("x", "split_text(x) AS b").collect()} == {t: split_text(t) for t in rows}


def test_regions(spark):
    register.register(spark)
    boxes = [[0.0, 0.0, 0.2, 0.2], [0.4, 0.4, 0.6, 0.6], [0.7, 0.1, 0.9, 0.2], [0.4, 0.7, 0.6, 0.9], [0.0, 0.4, 0.1, 0.6], [0.5, 0.5, 0.4, 0.6], [0.0, 0.0, 2.0, 1.0], [0.1, 0.2], None]
    for r in spark.createDataFrame([(b,) for b in boxes], "b array<double>").select("b", text.bbox_region(F.col("b")).alias("want"), F.expr("bbox_region(b)").alias("got")).collect():
        assert r["want"] == r["got"], r
