"""Queries of filters, audits, visual jobs, contexts and case generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters, text

from ..operators import audit as A
from ..operators import cases as K
from ..operators import context as X
from ..operators import links as L

from ..operators import retrieval as R
from ..operators import visual as V
from ..operators.chunks import record_summary
from .corpus import ASKED, PACKAGE, asked, assets, chunks, corpus, links, pages, table
from .metric_queries import _CASES, targets
from .registry import query


_FILTERS = ["l_quantity>=10", "l_quantity<40", 'l_returnflag="R"', "l_discount<=0.05"]


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag = 'R' AND l_discount <= 0.05")
def c02_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(filters.condition(filters.parse(_FILTERS))).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT event_id, event_type FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND event_type IN ('click', 'view')")
def c01_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(filters.json_condition(filters.parse(["k>=50"]), F.col("props")) & filters.condition({"event_type": {"any": ["click", "view"]}})).select("event_id", "event_type")


@query(f"WITH {PACKAGE} SELECT chunk_id FROM ch WHERE lang = 'de' AND page_start <= 20 AND page_end >= 5")
def c03_chunk_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {"lang": "de"} | filters.parse(["page_start<=20", "page_end>=5"])
    return chunks(spark, sf_dir).where(filters.condition(f)).select("chunk_id")


@query(f"WITH {PACKAGE} SELECT asset_id, page_no FROM ast WHERE kind IN ('table', 'map') AND page_no BETWEEN 2 AND 30")
def c05_asset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {"kind": ["table", "map"]} | filters.parse(["page_no>=2", "page_no<=30"])
    return assets(spark, sf_dir).where(filters.condition(f)).select("asset_id", "page_no")


_BOX = "[(page_id % 7) / 10.0, (page_id % 5) / 10.0, (page_id % 7) / 10.0 + (page_id % 4) / 8.0, (page_id % 5) / 10.0 + 0.3]"


@query(f"""WITH b AS (SELECT page_id, {_BOX} AS b FROM pages), c AS (SELECT page_id, b, (b[1] + b[3]) / 2 AS x, (b[2] + b[4]) / 2 AS y FROM b),
    n AS (SELECT page_id, CASE WHEN y < 1/3 THEN 'upper' WHEN y > 2/3 THEN 'lower' ELSE 'middle' END || ' ' || CASE WHEN x < 1/3 THEN 'left' WHEN x > 2/3 THEN 'right' ELSE 'center' END AS n, b[1] >= 0 AND b[2] >= 0 AND b[3] <= 1 AND b[4] <= 1 AND b[3] > b[1] AND b[4] > b[2] AS ok FROM c)
    SELECT page_id, CASE WHEN ok THEN CASE n WHEN 'middle center' THEN 'center' ELSE n END END AS region FROM n""")
def b23_bbox_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("page_id") % 7) / 10.0, (F.col("page_id") % 5) / 10.0
    return table(spark, sf_dir, "pages").select("page_id", text.bbox_region(F.array(x0, y0, x0 + (F.col("page_id") % 4) / 8.0, y0 + 0.3)).alias("region"))


@query(r"""WITH x AS (SELECT n_regionkey, n_nationkey, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS one, n_name FROM nation),
    r AS (SELECT n_regionkey, list([CASE WHEN n_regionkey <> 3 OR one THEN CAST(n_nationkey AS VARCHAR) END, CASE WHEN n_regionkey NOT IN (2, 3) OR one AND n_regionkey = 3 THEN n_name || '|x' END, ' ', CASE WHEN n_nationkey % 2 = 0 AND n_regionkey = 0 THEN '  two   words ' END] ORDER BY n_nationkey) AS c FROM x GROUP BY n_regionkey),
    t AS (SELECT n_regionkey, list_filter(list_transform(c, lambda r: list_transform(r, lambda x: trim(regexp_replace(coalesce(x, ''), '\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS w FROM r),
    k AS (SELECT n_regionkey, w, list_filter([1, 2, 3, 4], lambda i: len(list_filter(w, lambda r: r[i] <> '')) > 0) AS k FROM t), m AS (SELECT n_regionkey, list_transform(w, lambda r: list_transform(k, lambda i: r[i])) AS g FROM k),
    ls AS (SELECT n_regionkey, g, list_transform(g, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\|')), ' | ') || ' |') AS ls FROM m)
    SELECT n_regionkey, array_to_string(list_concat([ls[1], '| ' || array_to_string(list_transform(g[1], lambda c: '---'), ' | ') || ' |'], ls[2:]), chr(10)) AS markdown,
           len(g) >= 2 AND len(g[1]) >= 2 AND len(list_filter(flatten(g), lambda c: c <> '')) >= 4 AS useful FROM ls""")
def b28_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a table, some with a column or all rows but one empty."""
    one = F.col("n_nationkey") == F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    k = F.col("n_regionkey")
    n = table(spark, sf_dir, "nation").withColumn("one", one)
    row = F.array(F.when((k != 3) | F.col("one"), F.col("n_nationkey").cast("string")), F.when(~k.isin(2, 3) | (F.col("one") & (k == 3)), F.concat("n_name", F.lit("|x"))), F.lit(" "), F.when((F.col("n_nationkey") % 2 == 0) & (k == 0), "  two   words "))
    c = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("c")).select("n_regionkey", text.table_cells(F.col("c")).alias("c"))
    return c.select("n_regionkey", text.table_markdown(F.col("c")).alias("markdown"), text.table_useful(F.col("c")).alias("useful"))


_VISUAL = "v AS (SELECT page_id, page_id % 40 + 1 AS page_no, page_id % 10 AS images, page_id % 33 AS drawings, page_id % 3 AS blocks, CASE WHEN page_id % 6 = 0 THEN 'empty' ELSE 'good' END AS quality FROM pages), vs AS (SELECT *, 5 * blocks + 3 * images + drawings AS score, CASE WHEN page_no <= 3 THEN 'page_image' WHEN images >= 4 THEN 'map' WHEN drawings >= 20 THEN 'table' WHEN images >= 1 THEN 'figure' ELSE 'page_image' END AS kind, quality = 'empty' OR images > 0 OR drawings >= 20 AS render FROM v)"


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    v = table(spark, sf_dir, "pages").select(p, (p % 40 + 1).alias("page_no"), (p % 10).alias("images"), (p % 33).alias("drawings"), (p % 3).alias("blocks"), F.when(p % 6 == 0, "empty").otherwise("good").alias("quality"))
    return v.withColumns({"score": text.visual_score(F.col("blocks"), F.col("images"), F.col("drawings")), "kind": text.page_kind(F.col("page_no"), F.col("images"), F.col("drawings")), "render": text.worth_rendering(F.col("quality"), F.col("images"), F.col("drawings"))})


@query(f"WITH {_VISUAL} SELECT page_id, kind, render, CAST(score AS BIGINT) AS score, concat_ws(',', CASE WHEN images >= 8 THEN 'many_images' END, CASE WHEN drawings >= 30 THEN 'many_drawings' END, CASE WHEN quality = 'empty' AND score >= 20 THEN 'empty_visual_page' END) AS reasons FROM vs")
def b31_visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visual(spark, sf_dir).select("page_id", "kind", "render", "score", F.array_join(text.tiling_reasons(F.col("images"), F.col("drawings"), F.col("quality"), F.col("score")), ",").alias("reasons"))


@query(f"WITH {_VISUAL} SELECT page_id, score FROM vs ORDER BY score DESC, page_id LIMIT 20")
def f20_top_visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visual(spark, sf_dir).orderBy(F.desc("score"), "page_id").limit(20).select("page_id", "score")


@query("""SELECT page_id, CAST(t AS INTEGER) AS tile, CAST(t // 3 AS INTEGER) AS "row", CAST(t % 3 AS INTEGER) AS col, round(greatest((t % 3 - CAST(0.1 AS DOUBLE)) / 3, 0), 6) AS x0, round(greatest((t // 3 - CAST(0.1 AS DOUBLE)) / 2, 0), 6) AS y0, round(least((t % 3 + 1 + CAST(0.1 AS DOUBLE)) / 3, 1), 6) AS x1, round(least((t // 3 + 1 + CAST(0.1 AS DOUBLE)) / 2, 1), 6) AS y1,
    (t + 1) || '/6, row ' || (t // 3 + 1) || ' col ' || (t % 3 + 1) AS label FROM pages, range(6) r(t)""")
def b32_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tiles(table(spark, sf_dir, "pages").select("page_id"), 2, 3, 0.1)
    return t.withColumn("label", text.tile_label(F.col("tile"), F.lit(6), F.col("row"), F.col("col")))


_JOBS = f"""{_VISUAL}, jb AS (SELECT page_id, page_no, CASE kind WHEN 'map' THEN 1000 WHEN 'table' THEN 900 WHEN 'figure' THEN 800 WHEN 'page_image' THEN 650 ELSE 500 END + CASE WHEN images >= 5 THEN 200 ELSE 0 END + CASE WHEN quality = 'empty' THEN 150 ELSE 0 END
    + least(blocks, 5) * 40 + least(images, 5) * 40 + least(drawings, 20) * 5 + CASE WHEN page_id % 2 = 0 THEN 80 ELSE 0 END + CASE WHEN page_id % 4 <> 0 THEN 20 ELSE 0 END AS priority FROM vs WHERE render)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _visual(spark, sf_dir).where("render")
    empty = F.col("quality") == "empty"
    p = text.job_priority(F.col("kind"), F.col("images") >= 5, empty, text.complexity_bonus(F.col("blocks"), F.col("images"), F.col("drawings")), F.col("page_id") % 2 == 0, empty, F.col("page_id") % 4 != 0)
    return v.select("page_id", "page_no", p.cast("long").alias("priority"), (F.col("page_id") % 2).cast("int").alias("tile"), F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("asset_id"))


@query(f"WITH {_JOBS} SELECT page_id, page_no, CAST(priority AS BIGINT) AS priority FROM jb")
def b33_job_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("page_id", "page_no", "priority")


@query(f"WITH {_JOBS} SELECT page_id, priority FROM jb ORDER BY priority DESC, page_no, page_id % 2, 'a' || page_id LIMIT 25")
def f19_job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    return j.orderBy(*V.job_order(j)).limit(25).select("page_id", "priority")


@query("""SELECT event_type AS operation, 'b' || (user_id % 3) AS backend, count(*) AS results, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS completed, round(CAST(sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS completion_rate,
    round(avg(value), 6) AS mean_seconds, round(quantile_cont(value, 0.5), 6) AS p50_seconds, round(quantile_cont(value, 0.95), 6) AS p95_seconds FROM events GROUP BY ALL""")
def e22_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of visual models."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("backend"), F.when(F.col("event_id") % 5 != 0, "completed").otherwise("failed").alias("status"), F.col("value").alias("seconds"))
    return V.run_summary(e)


@query("""WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS a, CASE WHEN user_id % 3 = 0 THEN NULL ELSE least(avg(value) / 120, 1) END AS b, count(*) / 1000.0 AS c FROM events GROUP BY user_id)
    SELECT user_id, round((least(greatest(a, 0), 1) * 0.5 + coalesce(least(greatest(b, 0), 1) * 0.3, 0) + least(c, 1) * 0.2) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END), 6) AS score FROM u""")
def e23_run_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("a"), F.least(F.avg("value") / 120, F.lit(1.0)).alias("b0"), (F.count("*") / 1000.0).alias("c"))
    return u.withColumn("b", F.when(F.col("user_id") % 3 != 0, F.col("b0"))).select("user_id", F.round(V.run_score({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("score"))


@query("SELECT user_id, CASE WHEN b IS NULL THEN 'first' WHEN a IS NULL THEN 'second' ELSE 'both' END AS side FROM (SELECT coalesce(a, b) AS user_id, a, b FROM (SELECT DISTINCT user_id AS a FROM events WHERE event_type IN ('click', 'error')) FULL JOIN (SELECT DISTINCT user_id AS b FROM events WHERE event_type NOT IN ('click', 'error')) ON a = b)")
def d25_job_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = F.col("event_type").isin("click", "error")
    return V.job_sets(e.where(first), e.where(~first), "user_id")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'json_object' WHEN 1 THEN 'json_list' WHEN 2 THEN 'json_repaired' WHEN 3 THEN 'raw_text' WHEN 4 THEN 'json_repaired' ELSE 'raw_text' END AS status,
    CASE WHEN page_id % 6 IN (0, 2, 4) THEN url END AS title, CASE page_id % 6 WHEN 4 THEN 'a,b' END AS entities FROM pages""")
def b27_parse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model may give them: in a fence, as a list, cut short after much else, as plain text, cut within a list, an object without a known field."""
    o = F.to_json(F.struct(F.col("url").alias("title"), F.array(F.lit(1), F.lit(2)).alias("n")))
    k, long = F.col("page_id") % 6, F.repeat(F.lit("filler "), 2000)
    cut = F.concat(F.left(o, F.length(o) - 7), F.lit(',"entities": ["a", "b", "A", "c'))
    answer = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), o, F.lit("\n```\nDone."))).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.concat(F.lit("Result: "), F.left(o, F.length(o) - 3), F.lit(',"more": "'), long)).when(k == 3, F.lit("no structure here")).when(k == 4, cut).otherwise(F.lit('{"label": "x", "n": [1'))
    p = table(spark, sf_dir, "pages").select("page_id", V.parsed(answer).alias("p"))
    return p.select("page_id", "p.status", F.get_json_object("p.body", "$.title").alias("title"), F.array_join(F.from_json(F.get_json_object("p.body", "$.entities"), "array<string>"), ",").alias("entities"))


@query("""SELECT event_id, event_type AS label, CASE WHEN user_id % 2 = 0 THEN 'top' END AS location, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.85 WHEN 2 THEN NULL ELSE NULL END AS confidence, event_id % 3 = 0 AS has_box FROM events""".replace("THEN 0.5 ", "THEN CAST(0.5 AS DOUBLE) "))
def b22_object_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects under the names that models give them."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    label = F.when(i % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("name")))).otherwise(F.to_json(F.struct(F.lit(" ").alias("label"), F.col("event_type").alias("type"))))
    sure = F.when(i % 4 == 0, F.lit("0.5")).when(i % 4 == 1, F.lit('"85%"')).when(i % 4 == 2, F.lit("-3")).otherwise(F.lit('"high"'))
    body = F.concat(F.left(label, F.length(label) - 1), F.lit(',"score":'), sure, F.when(F.col("user_id") % 2 == 0, F.lit(',"position":"top"')).otherwise(""), F.when(i % 3 == 0, F.lit(',"box":[0,0,1,1]')).otherwise(""), F.lit("}"))
    o = e.select("event_id", V.object_column(body).alias("o"))
    return o.select("event_id", "o.label", "o.location", "o.confidence", F.col("o.box").isNotNull().alias("has_box"))


@query(f"""WITH {PACKAGE}, w AS (SELECT chunk_id, text, caption AS part FROM lk JOIN ast USING (asset_id) JOIN ch USING (chunk_id)) SELECT chunk_id, md5(CASE WHEN part IS NULL OR contains(lower(text), lower(part)) THEN text ELSE text || chr(10) || part END) AS text FROM (SELECT ch.chunk_id, ch.text, part FROM ch LEFT JOIN w ON ch.chunk_id = w.chunk_id)""")
def k15_text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = links(spark, sf_dir).join(assets(spark, sf_dir).select("asset_id", "caption"), "asset_id").select("chunk_id", F.lit(0).alias("ord"), F.col("caption").alias("part"))
    return V.missing_texts(chunks(spark, sf_dir).select("chunk_id", "text"), w).select("chunk_id", F.md5("text").alias("text"))


@query("SELECT label AS vector_name, count(*) AS records, count(DISTINCT vec_id) AS targets, CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings GROUP BY label")
def e25_vector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_summary(table(spark, sf_dir, "embeddings").select(F.col("label").alias("vector_name"), F.col("vec_id").alias("target_id"), F.col("embedding").alias("vector")))


@query("""SELECT 'v' AS vector_name, 'wrong size' AS issue, CAST(vec_id AS VARCHAR) AS key FROM embeddings WHERE vec_id % 17 = 0 UNION ALL SELECT 'v', 'zero', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 19 = 0
    UNION ALL SELECT 'v', 'unknown target', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 23 = 0 UNION ALL SELECT 'v', 'no vector', CAST(-1 - vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 23 = 1""")
def l09_vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    vector = F.when(i % 17 == 0, F.concat("embedding", F.array(F.lit(1.0).cast("float")))).otherwise(F.col("embedding"))
    vector = F.when(i % 19 == 0, F.transform(vector, lambda x: F.lit(0.0).cast("float"))).otherwise(vector)
    records = v.select(F.lit("v").alias("vector_name"), i.alias("target_id"), vector.alias("vector"))
    there = v.where(i % 23 != 0).select(F.lit("v").alias("vector_name"), i.alias("target_id")).unionByName(v.where(i % 23 == 1).select(F.lit("v").alias("vector_name"), (-1 - i).alias("target_id")))
    return A.vector_issues(records, there, {"v": 64})


@query(f"""WITH {PACKAGE} SELECT chunk_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'tokens' ELSE 'chars' END AS issue FROM ch WHERE doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 UNION ALL SELECT 'x' || chunk_id, 'stale' FROM ch WHERE doc_id % 29 = 0""")
def l11_bm25_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = chunks(spark, sf_dir), F.col("doc_id")
    m = A.token_manifest(c).join(c.select("chunk_id", "doc_id"), "chunk_id")
    stored = m.where(i % 13 != 0).select("chunk_id", F.when(i % 19 == 0, F.col("text_chars") + 1).otherwise(F.col("text_chars")).alias("text_chars"), F.when(i % 17 == 0, F.lit("other")).otherwise(F.col("tokens")).alias("tokens"))
    stale = m.where(i % 29 == 0).select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "text_chars", "tokens")
    return A.verify_manifest(stored.unionByName(stale), c)


@query(f"""WITH {PACKAGE} SELECT 'pages' AS "check", 'no chunk' AS issue, doc || '/' || page_no AS key FROM pg WHERE doc_id % 21 = 0 UNION ALL SELECT 'chunks', 'repeated id', chunk_id FROM ch WHERE doc_id % 31 = 0 AND doc_id % 21 <> 0
    UNION ALL SELECT 'chunks', 'no text', chunk_id FROM ch WHERE doc_id % 21 <> 0 AND trim(text) = '' UNION ALL SELECT 'links', 'unknown asset', asset_id FROM lk WHERE ord % 25 = 0 UNION ALL SELECT 'assets', 'not linked', asset_id FROM lk WHERE ord % 27 = 0 AND ord % 25 <> 0""")
def l08_package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, a, k = chunks(spark, sf_dir).where("doc_id % 21 <> 0"), assets(spark, sf_dir).where("page_id % 25 <> 0"), links(spark, sf_dir).where("ord % 27 <> 0 or ord % 25 = 0")
    return A.package_issues(pages(spark, sf_dir), c.unionByName(c.where("doc_id % 31 = 0")), a, k)


@query("SELECT * FROM (VALUES ('doc_id', 'mismatch'), ('n_chars', 'extra'), ('title', 'missing')) t(name, issue)")
def a18_schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of documents against one that differs in three columns."""
    have = spark.createDataFrame(A.schema_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")), "name string, type string")
    return A.contract(have, spark.createDataFrame([("doc_id", "string"), ("text", "string"), ("title", "string")], "name string, type string"), "name", "type")


@query(f"""WITH {_CASES} SELECT kind, count(*) AS targets, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM (SELECT CASE tg.item_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'chunk' ELSE 'asset' END AS kind, rank FROM tg LEFT JOIN (SELECT query_id, item_id, rank FROM ru WHERE run = 'bm25') b USING (query_id, item_id) WHERE excluded = 0) GROUP BY kind""")
def e11_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each kind of target."""
    kind = F.element_at(F.array(F.lit("page"), F.lit("chunk"), F.lit("asset")), (F.col("item_id") % 3 + 1).cast("int"))
    h = R.bm25_topk(R.postings(corpus(spark, sf_dir)), asked(spark, sf_dir), 10).select("query_id", "item_id", "rank")
    t = targets(spark, sf_dir).where("not excluded").join(h, ["query_id", "item_id"], "left")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("targets"), F.round(F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0)), 6).alias("coverage"))


_CONTEXT = """pl AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS item_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), ht AS (SELECT conv_id % 20 AS query_id, item_id, place, conv_id, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS rank FROM pl),
  al AS (SELECT query_id, item_id, 'hit' AS role, rank, 0 AS step FROM ht UNION ALL SELECT query_id, pl.item_id, 'neighbour', rank, abs(pl.place - ht.place) * 2 + CASE WHEN pl.place > ht.place THEN 1 ELSE 0 END FROM ht JOIN pl ON ht.conv_id = pl.conv_id AND abs(pl.place - ht.place) = 1),
  on1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY CASE role WHEN 'hit' THEN 0 ELSE 1 END, rank, step) AS n FROM al),
  bd AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, step, item_id) AS place, item_id, role, rank FROM on1 WHERE n = 1),
  bt AS (SELECT bd.*, CASE WHEN length(trim(text)) <= 1200 THEN trim(text) ELSE rtrim(substr(trim(text), 1, 1197)) || '...' END AS text FROM bd JOIN pl USING (item_id))"""


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("turn")))
    h = c.withColumn("query_id", F.col("doc") % 20)
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc", "turn"))).select("query_id", "item_id", "rank")
    return X.bundle(h, c.select("item_id", "doc", "place", "text"), reach=1)


@query(f"WITH {_CONTEXT} SELECT query_id, CAST(place AS INTEGER) AS place, item_id, role, CAST(rank AS INTEGER) AS rank, text FROM bt")
def k19_context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir)


@query(f"WITH {_CONTEXT} SELECT query_id, md5(string_agg('[' || place || '] item ' || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY place)) AS context FROM bt GROUP BY query_id")
def k19_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rendered(_bundle(spark, sf_dir), F.concat(F.lit("item "), F.col("item_id").cast("string"))).select("query_id", F.md5("context").alias("context"))


@query(f"""WITH {_CONTEXT}, tgx AS (SELECT DISTINCT conv_id % 20 AS query_id, item_id FROM pl WHERE turn = 0), sz AS (SELECT query_id, count(*) AS parts, CAST(sum(CASE role WHEN 'hit' THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(length(text)) AS BIGINT) AS chars FROM bt GROUP BY query_id),
    wt AS (SELECT query_id, count(*) AS expected FROM tgx GROUP BY query_id), gt AS (SELECT query_id, count(*) AS found FROM tgx JOIN bt USING (query_id, item_id) GROUP BY query_id)
    SELECT query_id, parts, hits, chars, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, round(coalesce(found, 0) / CAST(expected AS DOUBLE), 6) AS coverage, coalesce(found, 0) = coalesce(expected, 0) AS complete FROM sz LEFT JOIN wt USING (query_id) LEFT JOIN gt USING (query_id)""")
def e16_context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("turn = 0").select((F.col("conv_id") % 20).alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"))
    return X.context_metrics(_bundle(spark, sf_dir), t).withColumn("coverage", F.round("coverage", 6))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


_STOP = ", ".join(f"'{w}'" for w in K.STOP)
_MEANT = r"trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(replace({}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT contains(x, 'OCR/VLM processing required') AND NOT contains(x, 'Full page render for page')), ' '), '[|#*_`>\[\]()]', ' ', 'g'), '\s+', ' ', 'g'))"
_TERMS = r"""tw AS (SELECT item_id, list_transform(regexp_extract_all({meant}, '[A-Za-z][A-Za-z0-9_./%+-]{{2,}}|[0-9]+(?:[.,][0-9]+)*(?:[%A-Za-z가-힣㎡²³]*)?|[가-힣]{{2,}}|[一-鿿]{{2,}}'), lambda x: regexp_replace(x, '^[.,;:!?/\\+-]+|[.,;:!?/\\+-]+$', '', 'g')) AS w FROM {rows}),
  te0 AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tw), te1 AS (SELECT item_id, term, lower(term) AS key, pos FROM te0),
  te AS (SELECT item_id, key, min(pos) AS pos, arg_min(term, pos) AS term FROM te1 WHERE length(key) >= 2 AND key NOT IN ({stop}) AND NOT (regexp_matches(key, '^[0-9a-f]+$') AND regexp_matches(key, '[0-9]') AND regexp_matches(key, '[a-f]'))
    AND NOT (length(key) >= 12 AND regexp_matches(key, '[0-9]')) AND NOT (regexp_matches(key, '^[0-9]+$') AND length(key) <> 4) GROUP BY item_id, key),
  td2 AS (SELECT key, round((ln(((SELECT count(*) FROM {rows} WHERE {meant} <> '') + 1.0) / count(*)) + 1) * least(length(key), 16) / 8.0 * CASE WHEN regexp_matches(replace(replace(key, '.', ''), ',', ''), '^[0-9]+$') THEN 0.75 ELSE 1.0 END, 9) AS score FROM te GROUP BY key)"""


def _terms_sql(rows: str) -> str:
    return _TERMS.format(meant=_MEANT.format("text"), rows=rows, stop=_STOP)


_RICH = "rich AS (SELECT item_id, text || ' (In 2024, 1,200.50 kg of v1.2.3: a1b2 deadbeef42, Section TABLE!)' || chr(10) || 'OCR/VLM processing required' AS text FROM benchmark)"


@query(f"WITH {_RICH}, {_terms_sql('rich')} SELECT item_id, term, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS place, round(score, 6) AS score FROM te JOIN td2 USING (key)")
def b09_salient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every benchmark item, to which are added numbers, identifiers, stop words and a placeholder."""
    rich = F.concat("text", F.lit(" (In 2024, 1,200.50 kg of v1.2.3: a1b2 deadbeef42, Section TABLE!)\nOCR/VLM processing required"))
    t = K.scored_terms(_passages(spark, sf_dir).withColumn("text", rich))
    return t.select("item_id", "term", F.row_number().over(Window.partitionBy("item_id").orderBy("pos")).alias("place"), F.round("score", 6).alias("score"))


@query()
def f16_salient_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight terms for every document, none within another where that leaves three."""
    d = corpus(spark, sf_dir)
    return K.drafted(K.selected_terms(d)).select("item_id", F.array_join("terms", " ").alias("terms"), "query", F.round("score", 6).alias("score"))


@query()
def k20_page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for every document, the first of each query, with the share of its terms that its target has."""
    d = corpus(spark, sf_dir)
    c = K.first_per(K.page_cases(K.selected_terms(d)), [F.lower("query")], "item_id")
    return c.join(K.target_overlap(c, d), "case_id").select("case_id", "query", "item_id", F.round("overlap", 6).alias("overlap"))


@query("""WITH c AS (SELECT item_id, text AS q FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents), n AS (SELECT item_id, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS q FROM c) SELECT item_id, md5(q) AS query FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY item_id DESC) AS r FROM n) WHERE r = 1""")
def f17_first_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents as cases, whole texts as queries; of equal ones one stays."""
    c = _passages(spark, sf_dir).unionByName(corpus(spark, sf_dir).select((-1 - F.col("item_id")).alias("item_id"), "text")).select("item_id", F.lower(text.squeeze_ws(F.col("text"))).alias("query"))
    return K.first_per(c, [F.col("query")], F.desc("item_id")).select("item_id", F.md5("query").alias("query"))


@query(f"WITH {ASKED}, w AS (SELECT query_id AS item_id, CASE WHEN query_id % 5 = 0 THEN '주택 ' || text ELSE text END AS w FROM asked) SELECT item_id, CASE WHEN query_id_hangul THEN '어디에서 ' || w || ' 관련 항목을 찾을 수 있는가' ELSE 'Where is ' || w || ' discussed?' END AS question FROM (SELECT *, regexp_matches(w, '[가-힣]') AS query_id_hangul FROM w)")
def b42_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.when(F.col("query_id") % 5 == 0, F.concat(F.lit("주택 "), "text")).otherwise(F.col("text"))
    return asked(spark, sf_dir).select(F.col("query_id").alias("item_id"), text.question(term).alias("question"))


@query("""WITH x AS (SELECT event_id, event_id % 6 AS k, value FROM events)
    SELECT event_id, CASE k WHEN 0 THEN least(greatest(value, 0), 1) WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 END AS clamped,
    CASE k WHEN 0 THEN CASE WHEN value > 100 THEN 1.0 WHEN value > 1 THEN value / 100 ELSE greatest(value, 0) END WHEN 1 THEN 0.85 WHEN 3 THEN 0.0 WHEN 4 THEN 0.4 END AS percent,
    CASE k WHEN 0 THEN CASE WHEN value > 100 OR value < 0 THEN NULL WHEN value > 1 THEN round(value / 100, 6) ELSE round(value, 6) END WHEN 1 THEN 0.85 WHEN 4 THEN 0.4 END AS strict FROM x""")
def b41_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, 85%, n/a, one below 0, one with blanks, nothing."""
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "85%").when(k == 2, "n/a").when(k == 3, "-0.5").when(k == 4, " 40 ")
    return table(spark, sf_dir, "events").select("event_id", text.confidence(v).alias("clamped"), text.confidence(v, percent=True).alias("percent"), text.confidence(v, percent=True, strict=True).alias("strict"))


@query("""WITH u AS (SELECT user_id, avg(value) / 100 AS a, CASE WHEN user_id % 2 = 0 THEN NULL ELSE count(*) / 1000.0 END AS b FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN b IS NULL THEN a ELSE (a * 0.3 + b * 0.25) / 0.55 END, 6) AS score FROM u""")
def e08_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("a"), (F.count("*") / 1000.0).alias("n"))
    return u.withColumn("b", F.when(F.col("user_id") % 2 != 0, F.col("n"))).select("user_id", F.round(A.quality_score({"a": 0.3, "b": 0.25}), 6).alias("score"))


@query(f"WITH {_CASES}, gs AS (SELECT 'group ' || (query_id % 3) AS grp, run, avg(coverage) AS coverage, avg(ndcg) AS ndcg FROM ce GROUP BY ALL) SELECT grp, run AS best, round(coverage, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(coverage, 9) DESC, round(ndcg, 9) DESC, run) AS r FROM gs) WHERE r = 1")
def k24_group_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run for each group of cases."""
    from .metric_queries import _metrics

    g = _metrics(spark, sf_dir).groupBy(F.concat(F.lit("group "), (F.col("query_id") % 3).cast("string")).alias("grp"), "run").agg(F.avg("coverage").alias("coverage"), F.avg("ndcg").alias("ndcg"))
    return L.first_by(g, "grp", F.round("coverage", 9).desc(), F.round("ndcg", 9).desc(), "run").select("grp", F.col("run").alias("best"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_CASES} SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM tg)")
def d24_cases_without_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id").join(targets(spark, sf_dir), "query_id", "left_anti")


#: Sources and what the rules make of each.
_SOURCES = {"bm25": "lexical", "bm25:de": "bm25", "Lexical_v2:x": "lexical", "dense": "dense_text", " dense ": "dense_text", "dense:x": "dense", "text_dense:main": "dense_text", "caption_dense": "visual", "OBJECT_DENSE:y": "visual", "image_dense": "visual", "caption": "caption", "triple_dense": "graph", "graph": "graph", "graph:z": "graph", "rerank:lexical": "reranker", "reranked": "reranked", "": "unknown", "other:x": "other"}


@query(f"SELECT event_id, {list(_SOURCES.values())!r}[event_id % {len(_SOURCES)} + 1] AS family FROM events")
def b38_source_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("event_id") % len(_SOURCES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.source_family(source).alias("family"))
