import re

import corpus_pipeline
from conftest_llm import rows_of
from lodestrand.llm import toxicity

NAMES = ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def save(spark, tmp_path, corpus, labels):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_each_on_what_the_one_before_kept(spark, corpus, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(120)], "doc_id long, toxic int")
    sf = save(spark, tmp_path, corpus, labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] > 0
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
    # stage by stage against brute force
    texts = lambda i: spark.read.parquet(f"{tmp_path}/out{i}")
    model = toxicity.train(corpus, labels)
    toxic = {r["doc_id"] for r in toxicity.toxicity(corpus, model).where("toxic = 1").collect()}
    assert {r["doc_id"] for r in texts(0).collect()} == {r["doc_id"] for r in corpus.collect()} - toxic
    filled = [r["text"] for r in texts(1).collect() if r["text"] is not None]
    assert len(filled) == len(set(filled)) and set(filled) == {r["text"] for r in texts(0).collect()} - {None}
    sets = []
    for r in texts(2).where("doc_id is not null").collect():
        w = re.findall(r"[^\W]+", (r["text"] or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    assert not any(a and b and len(a & b) / len(a | b) >= 0.6 for i, a in enumerate(sets) for b in sets[:i])
    tokens = sum(len(r["text"].split()) for r in texts(3).collect())
    assert docs.selectExpr("sum(tokens)").first()[0] == tokens


def test_empty_tables(spark, nothing, tmp_path):
    sf = save(spark, tmp_path, nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows_of(corpus_pipeline.run(spark, sf)) == []
