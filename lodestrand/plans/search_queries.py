"""Queries of retrieval: every benchmark item against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import written
from ..operators import retrieval as R
from .corpus import ASKED, TRIPLES, asked, corpus, table, triples
from .registry import query

_TOK = "list_transform(regexp_extract_all(text, '[가-힣A-Za-z0-9_]+'), lambda x: lower(x))"
_BM25 = f"""{ASKED},
  dt AS (SELECT doc_id, {_TOK} AS t FROM documents),
  st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM dt),
  tk AS (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dt),
  tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM tk GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
  fl AS (SELECT avg(r) * 0.25 AS f FROM raw),
  qt0 AS (SELECT query_id, unnest({_TOK}) AS token FROM asked),
  qt AS (SELECT query_id, token, count(*) AS qf FROM qt0 GROUP BY ALL),
  qn AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY query_id),
  ws AS (SELECT query_id, doc_id, sum(qf * (CASE WHEN r < 0 THEN f ELSE r END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw, count(*) AS shared
         FROM qt JOIN tf USING (token) JOIN raw USING (token), fl, st GROUP BY query_id, doc_id),
  bm AS (SELECT query_id, doc_id AS item_id, greatest(raw, 0) + CAST(shared AS DOUBLE) / terms AS score FROM ws JOIN qn USING (query_id))"""
_DENSE = """
  dw AS (SELECT doc_id AS k, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM documents),
  qw AS (SELECT query_id AS k, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM asked),
  hs AS (SELECT w, (CAST('0x' || substr(sha256(w), 57, 8) AS BIGINT) + 256 * (
        CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) + CAST('0x' || substr(sha256(w), 9, 8) AS BIGINT) + CAST('0x' || substr(sha256(w), 17, 8) AS BIGINT) + CAST('0x' || substr(sha256(w), 25, 8) AS BIGINT)
        + CAST('0x' || substr(sha256(w), 33, 8) AS BIGINT) + CAST('0x' || substr(sha256(w), 41, 8) AS BIGINT) + CAST('0x' || substr(sha256(w), 49, 8) AS BIGINT))) % 384 AS slot
      FROM (SELECT w FROM dw UNION SELECT w FROM qw) WHERE w <> ''),
  ds AS (SELECT k, slot, CAST(count(*) AS DOUBLE) AS c FROM dw JOIN hs USING (w) GROUP BY ALL),
  qs AS (SELECT k, slot, CAST(count(*) AS DOUBLE) AS c FROM qw JOIN hs USING (w) GROUP BY ALL),
  dl2 AS (SELECT k, sqrt(sum(c * c)) AS l FROM ds GROUP BY k), ql2 AS (SELECT k, sqrt(sum(c * c)) AS l FROM qs GROUP BY k),
  cs AS (SELECT qs.k AS query_id, ds.k AS item_id, sum(qs.c * ds.c) AS dot FROM qs JOIN ds USING (slot) GROUP BY ALL),
  de AS (SELECT query_id, item_id, dot / (dl2.l * ql2.l) AS score FROM cs JOIN dl2 ON item_id = dl2.k JOIN ql2 ON query_id = ql2.k)"""


def _top(cte: str, k: int) -> str:
    return f"SELECT query_id, item_id, rk AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rk FROM {cte}) WHERE rk <= {k}"


_HITS = f"hits AS (SELECT *, 'bm25' AS source FROM ({_top('bm', 20)}) UNION ALL SELECT *, 'dense' AS source FROM ({_top('de', 20)}))"
_FUSED = "fu AS (SELECT query_id, item_id, sum(1.0 / (60 + rank)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM hits GROUP BY query_id, item_id)"
_RANKED = "SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM"


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"), *more)


@query(f"WITH {_BM25} SELECT df.token, CAST(df.df AS BIGINT) AS df, round(CASE WHEN r < 0 THEN f ELSE r END, 6) AS idf FROM df JOIN raw USING (token), fl")
def e02_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = written(R.corpus_stats(R.postings(corpus(spark, sf_dir))))
    floor = idf.agg((F.avg("raw") * R.EPSILON).alias("f"))
    return idf.crossJoin(F.broadcast(floor)).select("token", F.col("df").cast("long").alias("df"), F.round(F.when(F.col("raw") < 0, F.col("f")).otherwise(F.col("raw")), 6).alias("idf"))  # one row


@query(f"WITH {_BM25} {_RANKED} ({_top('bm', 10)})")
def f02_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.bm25_topk(R.postings(corpus(spark, sf_dir)), asked(spark, sf_dir), 10))


@query(f"WITH {ASKED}, {_DENSE} {_RANKED} ({_top('de', 5)})")
def f03_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.dense_topk(corpus(spark, sf_dir), asked(spark, sf_dir), 5))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    return R.bm25_topk(R.postings(c), q, 20).unionByName(R.dense_topk(c, q, 20))


@query(f"WITH {_BM25}, {_DENSE}, {_HITS}, {_FUSED} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fu) WHERE rank <= 5")
def f08_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.fuse(_hits(spark, sf_dir), 5), F.array_join("sources", ",").alias("sources"))


_RERANK = f"""pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS before FROM fu) WHERE before <= 20),
  qd AS (SELECT query_id, list_distinct({_TOK}) AS q FROM asked), cd AS (SELECT doc_id AS item_id, list_distinct({_TOK}) AS c FROM documents),
  rr AS (SELECT query_id, item_id, before, CAST(len(list_intersect(q, c)) AS DOUBLE) / len(q) + CAST(len(list_intersect(q, c)) AS DOUBLE) / len(list_distinct(list_concat(q, c))) AS score, sources
         FROM pool JOIN qd USING (query_id) JOIN cd USING (item_id))"""


@query(f"WITH {_BM25}, {_DENSE}, {_HITS}, gr(source, w) AS (VALUES ('bm25', 1.0), ('dense', 0.5)), fu AS (SELECT query_id, item_id, sum(w / (60 + rank)) AS score FROM hits JOIN gr USING (source) GROUP BY ALL) {_RANKED} ({_top('fu', 5)})")
def f08_family_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("lexical", 3.0), ("dense", 0.5), ("dense_text", 0.0)], "source string, weight double")
    return _out(R.fuse(_hits(spark, sf_dir), 5, weights))


_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  l AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
  q AS (SELECT vec_id AS query_id, e, l FROM l WHERE vec_id % 100 = 0),
  sc AS (SELECT q.query_id, d.vec_id AS item_id, list_dot_product(d.e, q.e) / (d.l * q.l) AS score FROM l d, q)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose number is divisible by 100."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return v, v.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")


@query(f"WITH {_VEC} {_RANKED} ({_top('sc', 10)})")
def a14_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.vector_topk(*_vectors(spark, sf_dir), 10))


_FOURS = "al AS (SELECT vec_id AS child, min(vec_id) OVER (PARTITION BY vec_id // 4) AS parent FROM embeddings)"


def _fours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child_id, parent_id): four vectors have the first of them for a parent, which has none."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("g"))
    return v.join(v.groupBy("g").agg(F.min("vec_id").alias("parent_id")), "g").select(F.col("vec_id").alias("child_id"), "parent_id").where("child_id <> parent_id")


@query(f"""WITH {_VEC}, {_FOURS}, h AS ({_top('sc', 20)}), c AS (SELECT h.*, parent FROM h JOIN al ON item_id = child)
  SELECT query_id, parent AS item_id, CAST(min(rank) AS INTEGER) AS rank, coalesce(array_to_string(list_sort(list(item_id) FILTER (WHERE item_id <> parent)), ','), '') AS evidence FROM c GROUP BY query_id, parent""")
def f09_hierarchy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.vector_topk(*_vectors(spark, sf_dir), 20)
    return R.collapse(hits, _fours(spark, sf_dir)).select("query_id", "item_id", "rank", F.array_join("evidence", ",").alias("evidence"))


_HALF = "list_transform(embedding[{}:{}], lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH r AS (SELECT 'text_dense' AS name, vec_id, label, {_HALF.format(1, 32)} AS e FROM embeddings UNION ALL SELECT 'caption_dense', vec_id, label, {_HALF.format(33, 64)} FROM embeddings),
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM r), {_FOURS},
  s AS (SELECT d.name, q.vec_id AS query_id, d.vec_id AS target, list_dot_product(d.e, q.e) / (d.l * q.l) AS score FROM n d JOIN n q ON d.name = q.name AND q.vec_id % 100 = 0 WHERE d.label BETWEEN 1 AND 7),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, query_id ORDER BY round(score, 9) DESC, target) AS rank FROM s) WHERE rank <= 30),
  m AS (SELECT query_id, name, rank, CASE WHEN name = 'caption_dense' THEN target - target % 2 ELSE target END AS item FROM h),
  c AS (SELECT m.*, parent FROM m JOIN al ON item = child), b AS (SELECT query_id, name, parent, min(rank) AS rank FROM c GROUP BY ALL), ev AS (SELECT query_id, parent, list_sort(list_distinct(list(item) FILTER (WHERE item <> parent))) AS ev FROM c GROUP BY ALL),
  f AS (SELECT query_id, parent AS item_id, sum(CASE name WHEN 'caption_dense' THEN 0.7 ELSE 1.0 END / (60 + rank)) AS score, string_agg('vector:' || name, ',' ORDER BY name) AS sources FROM b GROUP BY ALL)
  SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, sources, coalesce(array_to_string(ev, ','), '') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM f) JOIN ev ON ev.query_id = f.query_id AND ev.parent = f.item_id WHERE rank <= 10""".replace("FROM f) JOIN ev ON ev.query_id = f.query_id AND ev.parent = f.item_id", "FROM f) f JOIN ev ON ev.query_id = f.query_id AND ev.parent = f.item_id").replace("SELECT query_id, item_id, CAST(rank AS", "SELECT f.query_id, item_id, CAST(rank AS"))
def f13_multi_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of every vector as two spaces, one of chunks, one of assets, of which two belong to a chunk; among records with labels 1 to 7; four chunks have a parent."""
    v = table(spark, sf_dir, "embeddings")
    row = lambda name, low, asset: v.select(F.lit(name).alias("vector_name"), F.col("vec_id").alias("target_id"), F.col("vec_id").alias("item_id"), asset.alias("asset_id"), "label", F.slice("embedding", low, 32).alias("vector"))
    records = row("text_dense", 1, F.lit(None).cast("long")).unionByName(row("caption_dense", 33, F.col("vec_id")))
    queries = records.where("target_id % 100 = 0").select(F.col("target_id").alias("query_id"), "vector_name", "vector")
    owners = v.select(F.col("vec_id").alias("asset_id"), (F.col("vec_id") - F.col("vec_id") % 2).alias("chunk_id"))
    weights = spark.createDataFrame([("vector:caption_dense", 0.7), ("vector", 1.0)], "source string, weight double")
    got = R.multi_vector_search(records, queries, v.select(F.col("vec_id").alias("item_id")), k=10, condition=(F.col("label") >= 1) & (F.col("label") <= 7), asset_chunks=owners, parents=_fours(spark, sf_dir), weights=weights)
    return _out(got, F.array_join("sources", ",").alias("sources"), F.array_join("evidence", ",").alias("evidence"))


_GQ = "gq AS (SELECT n_nationkey AS query_id, lower(n_name) || ' suppliers located in' AS text FROM nation)"


def _graph_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lower("n_name"), F.lit(" suppliers located in")).alias("text"))


_CLEAN = "trim(regexp_replace(replace(lower({}), '_', ' '), '\\s+', ' ', 'g'))"


def _part(c: str) -> str:
    return f"(CASE WHEN contains(q, {c}) THEN 4 WHEN len(list_filter(string_split({c}, ' '), lambda z: NOT list_contains(qt, z))) = 0 THEN 2 ELSE 0 END)"


_GRAPH = f"""{TRIPLES}, {_GQ},
  tc AS (SELECT *, {_CLEAN.format('subject')} AS s, {_CLEAN.format('predicate')} AS p, {_CLEAN.format('object')} AS o FROM tr),
  qc AS (SELECT query_id, {_CLEAN.format('text')} AS q, list_distinct(string_split({_CLEAN.format('text')}, ' ')) AS qt FROM gq),
  gs AS (SELECT query_id, triple_id, chunk_id, CAST((CASE WHEN contains(s || ' ' || p || ' ' || o, q) THEN 8 ELSE 0 END) + len(list_intersect(qt, list_distinct(string_split(s || ' ' || p || ' ' || o, ' '))))
      + {_part('s')} + {_part('p')} + {_part('o')} AS DOUBLE) AS score FROM tc, qc)"""


@query(f"WITH {_GRAPH} SELECT query_id, triple_id, score FROM gs WHERE score > 0")
def f04_graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_scores(triples(spark, sf_dir), _graph_queries(spark, sf_dir))


@query(f"WITH {_GRAPH}, mx AS (SELECT query_id, chunk_id AS item_id, max(score) AS score FROM gs WHERE score > 0 GROUP BY ALL) {_RANKED} ({_top('mx', 20)})")
def f05_graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    best = R.graph_scores(t, _graph_queries(spark, sf_dir)).join(t.select("triple_id", "chunk_id"), "triple_id").groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.max("score").alias("score"))
    return _out(R.top_k(best, 20, "graph"))


def _meets(c: str) -> str:
    return f"(contains(q, lower({c})) OR len(list_filter(qt, lambda w: contains(lower({c}), w))) > 0)"


@query(f"""WITH {TRIPLES}, {_GQ}, q AS (SELECT query_id, lower(text) AS q, list_filter(string_split(lower(text), ' '), lambda z: z <> '') AS qt FROM gq),
  x AS (SELECT query_id, object AS term, 2 AS n FROM tr, q WHERE {_meets('subject')} UNION ALL SELECT query_id, predicate, 1 FROM tr, q WHERE {_meets('subject')}
    UNION ALL SELECT query_id, subject, 2 FROM tr, q WHERE {_meets('object')} UNION ALL SELECT query_id, predicate, 1 FROM tr, q WHERE {_meets('object')}
    UNION ALL SELECT query_id, subject, 1 FROM tr, q WHERE contains(q, lower(predicate)) UNION ALL SELECT query_id, object, 1 FROM tr, q WHERE contains(q, lower(predicate))),
  s AS (SELECT query_id, term, CAST(sum(n) AS BIGINT) AS score FROM x GROUP BY ALL)
  SELECT query_id, term, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 12""")
def f06_related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.related_terms(triples(spark, sf_dir), _graph_queries(spark, sf_dir)).select("query_id", "term", "score", "rank")


@query(f"""WITH {ASKED}, ro(route, ord, term) AS (VALUES ('english', 1, 'the'), ('german', 2, 'und'), ('french', 3, 'le'))
  SELECT query_id, coalesce(arg_min(route, ord), 'default') AS route FROM asked LEFT JOIN ro ON contains(lower(text), term) GROUP BY query_id""")
def f14_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("english", 1, "the"), ("german", 2, "und"), ("french", 3, "le")], "route string, ord int, term string")
    return R.route_queries(asked(spark, sf_dir), routes)


@query(f"SELECT doc_id, token, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL")
def a11_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_counts(corpus(spark, sf_dir)).select(F.col("item_id").alias("doc_id"), "token", "tf")


def _terms_sql(table_: str) -> str:
    """Related terms of the queries in a table."""
    return f"""q AS (SELECT query_id, lower(text) AS q, list_filter(string_split(lower(text), ' '), lambda z: z <> '') AS qt FROM {table_}),
  x AS (SELECT query_id, object AS term, 2 AS n FROM tr, q WHERE {_meets('subject')} UNION ALL SELECT query_id, predicate, 1 FROM tr, q WHERE {_meets('subject')}
    UNION ALL SELECT query_id, subject, 2 FROM tr, q WHERE {_meets('object')} UNION ALL SELECT query_id, predicate, 1 FROM tr, q WHERE {_meets('object')}
    UNION ALL SELECT query_id, subject, 1 FROM tr, q WHERE contains(q, lower(predicate)) UNION ALL SELECT query_id, object, 1 FROM tr, q WHERE contains(q, lower(predicate))),
  rt AS (SELECT query_id, string_agg(term, ' ' ORDER BY n DESC, term) AS more FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS r FROM (SELECT query_id, term, sum(n) AS n FROM x GROUP BY ALL)) WHERE r <= 12 GROUP BY query_id)"""


_PART0 = {c: _part(c) for c in "spo"}
_HYBRID = f"""{ASKED.replace('asked AS', 'asked0 AS')}, {TRIPLES}, {_terms_sql('asked0')},
  {_BM25.replace(ASKED, "asked AS (SELECT query_id, concat_ws(' ', text, more) AS text FROM asked0 LEFT JOIN rt USING (query_id))")}, {_DENSE},
  tc AS (SELECT *, {_CLEAN.format('subject')} AS s, {_CLEAN.format('predicate')} AS p, {_CLEAN.format('object')} AS o FROM tr),
  qc AS (SELECT query_id, {_CLEAN.format('text')} AS q, list_distinct(string_split({_CLEAN.format('text')}, ' ')) AS qt FROM asked0),
  gs AS (SELECT query_id, CAST(substr(chunk_id, 2) AS BIGINT) AS item_id, max(CAST((CASE WHEN contains(s || ' ' || p || ' ' || o, q) THEN 8 ELSE 0 END) + len(list_intersect(qt, list_distinct(string_split(s || ' ' || p || ' ' || o, ' '))))
      + {_PART0['s']} + {_PART0['p']} + {_PART0['o']} AS DOUBLE)) AS score FROM tc, qc GROUP BY ALL),
  gp AS (SELECT * FROM gs WHERE score > 0),
  h3 AS (SELECT *, 'bm25' AS source FROM ({_top('bm', 60)}) UNION ALL SELECT *, 'dense' FROM ({_top('de', 60)}) UNION ALL SELECT *, 'graph' FROM ({_top('gp', 60)})),
  pa AS (SELECT doc_id AS child_id, doc_id - doc_id % 4 AS parent_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id // 4 % 2 = 0 AND doc_id - doc_id % 4 IN (SELECT doc_id FROM documents)),
  cn AS (SELECT query_id, source, coalesce(parent_id, item_id) AS canon, rank, parent_id, item_id FROM h3 LEFT JOIN pa ON item_id = child_id),
  cb AS (SELECT query_id, source, canon AS item_id, min(rank) AS rank FROM cn GROUP BY ALL),
  ev AS (SELECT query_id, canon AS item_id, coalesce(array_to_string(list_sort(list_distinct(list(item_id) FILTER (WHERE parent_id IS NOT NULL))), ','), '') AS evidence FROM cn GROUP BY ALL),
  fu AS (SELECT query_id, item_id, sum(1.0 / (60 + rank)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM cb GROUP BY query_id, item_id)"""


@query(f"WITH {_HYBRID}, {_RERANK.replace('FROM asked)', 'FROM asked0)')} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, sources || ',rerank:lexical' AS sources, evidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, before) AS rank FROM rr) JOIN ev USING (query_id, item_id) WHERE rank <= 5")
def f12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: queries widened by the graph, hashed vectors, BM25, graph hits, hits of children counted for their parents, fusion, reranking of the 20 best.

    Of eight documents the second to fourth are children of the first. A triple belongs to the document of its supplier's or nation's number.
    """
    c, q, t = corpus(spark, sf_dir), asked(spark, sf_dir), triples(spark, sf_dir)
    own = c.select(F.col("item_id").alias("child_id"), (F.col("item_id") - F.col("item_id") % 4).alias("parent_id")).where((F.col("item_id") % 4 != 0) & (F.floor(F.col("item_id") / 4) % 2 == 0))
    parents = own.join(c.select(F.col("item_id").alias("parent_id")), "parent_id", "left_semi")
    at = t.select("triple_id", F.substring("chunk_id", 2, 18).cast("long").alias("chunk_id"))
    got = R.hybrid_search(c, q, k=5, triples=t, triple_chunks=at, expand=True, parents=parents, rerank=True, depth=20)
    return _out(got, F.array_join("sources", ",").alias("sources"), F.array_join("evidence", ",").alias("evidence"))
