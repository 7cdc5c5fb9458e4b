import json

from pyspark.sql import functions as F

from lodestrand.sources import package as P
from lodestrand.streaming import ingest as S


def tables(spark):
    return P.Package(
        spark.createDataFrame([("d", 1, "one"), ("d", 2, "two")], "doc string, page_no long, text string"), spark.createDataFrame([("c1", "d", 1, 1, "one"), ("c2", "d", 2, 2, None)], "chunk_id string, doc string, page_start long, page_end long, text string"),
        spark.createDataFrame([("a1", "d", 1)], "asset_id string, doc string, page_no long"), spark.createDataFrame([("c1", "a1")], "chunk_id string, asset_id string"), spark.createDataFrame([("t1", "c1", "s", "p", "o")], "triple_id string, chunk_id string, subject string, predicate string, object string"),
    )


def test_package_round_trip_and_refresh(spark, tmp_path):
    for format in ("parquet", "json"):
        path = f"{tmp_path}/{format}"
        manifest = tables(spark).write(path, format)
        assert {r["record"]: r["rows"] for r in manifest.collect()} == {"pages": 2, "chunks": 2, "assets": 1, "links": 1, "triples": 1}
        back = P.Package.read(spark, path, format)
        assert sorted(r["chunk_id"] for r in back.chunks.collect()) == ["c1", "c2"]
    new = back.refreshed(chunks=spark.createDataFrame([("c2", "d", 2, 2, "new"), ("c3", "d", 3, 3, "more")], back.chunks.select("chunk_id", "doc", "page_start", "page_end", "text").schema))
    assert {r["chunk_id"]: r["text"] for r in new.chunks.collect()} == {"c1": "one", "c2": "new", "c3": "more"}
    P.clear(spark, f"{tmp_path}/json", ["links", "no such table"])
    assert not (tmp_path / "json/links").exists() and (tmp_path / "json/chunks").exists()


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": null}\n\n{"a": 2, "b": "x"}\n')
    df = P.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, None), (2, "x")]
    P.write_jsonl(df, f"{tmp_path}/out")
    assert P.read_jsonl(spark, f"{tmp_path}/out", "a int, b string").count() == 2


def test_section_maps_in_all_forms(spark, tmp_path):
    flat = {"doc": "d", "page_start": 1, "page_end": 3, "chapter": "C", "section": "S"}
    nested = {"doc": "d", "page_start": 4, "page_end": 5, "section": {"chapter": "C", "section": "T", "issue": ""}}
    forms = {"a.jsonl": json.dumps(flat) + "\n\n" + json.dumps(nested), "b.json": json.dumps([flat, nested]), "c.json": json.dumps({"sections": [flat, nested]})}
    for name, body in forms.items():
        (tmp_path / name).write_text(body)
        got = [(r["page_start"], r["ord"], r["section"]) for r in P.read_sections(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert got == [(1, 0, "C > S"), (4, 1, "C > T")], name


def test_files_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first line\nSECRET word\n")
    (tmp_path / "in/b.key").write_text("x")
    (tmp_path / "in/c.txt").write_text("Zürich" * 10)
    f = {r["path"].rsplit("/", 1)[1]: r for r in P.files(spark, f"{tmp_path}/in").collect()}
    assert f["a.txt"]["lines"] == 2 and f["b.key"]["bytes"] == 1
    issues = {(r["path"].rsplit("/", 1)[1], r["issue"]) for r in P.file_audit(spark, f"{tmp_path}/in", ["secret", "ZÜRICH".lower()], most=60).collect()}
    assert ("a.txt", "term: secret") in issues and ("b.key", "blocked kind") in issues and ("c.txt", "too large") in issues
    d = {r["name"]: r for r in P.documents(spark, f"{tmp_path}/in").collect()}
    assert d["a.txt"]["title"] == "first line" and len(d["a.txt"]["doc_id"]) == 16


def test_vector_records(spark, tmp_path):
    r = spark.createDataFrame([("text", 1, [1.0, 0.0]), ("text", 2, [0.0, 1.0]), ("image", 1, [1.0])], "vector_name string, target_id long, vector array<double>")
    m = {x["vector_name"]: (x["records"], x["dim"]) for x in P.write_vectors(r, f"{tmp_path}/v").collect()}
    assert m == {"text": (2, 2), "image": (1, 1)}


def test_pages_that_arrive(spark, tmp_path):
    schema = "doc string, page_no long, text string, version long"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: S.ingest(S.read_pages(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp", buckets=2).awaitTermination()
    add([("d", 1, "old text", 1), ("d", 2, "", 1), ("e", 1, "other", 1)])
    run()
    add([("d", 1, "new text", 2), ("d", 1, "newer text", 3), ("e", 1, "late and old", 0)])
    run()
    got = {(r["doc"], r["page_start"]): (r["text"], r["kind"]) for r in S.current(spark, f"{tmp_path}/out").collect()}
    assert got == {("d", 1): ("newer text", "text"), ("d", 2): ("Page 2 has no usable text.", "page_summary"), ("e", 1): ("other", "text")}
