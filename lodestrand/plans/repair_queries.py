"""Queries of ablations, annotations and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.ids import chunk_id, sha_id
from ..functions.text import word_tokens
from ..operators import links as L
from ..operators import metrics as M
from ..operators import retrieval as R
from .corpus import ASSET_TRIPLES, PACKAGE, asked, asset_triples, assets, chunks, corpus, links, table
from .link_queries import _resolved
from .metric_queries import _CASES, K, runs, targets
from .registry import query
from .search_queries import _RERANK, _hits

_MODES = _CASES.replace("\n  ru AS (", f"\n  {_RERANK},\n  ru AS (SELECT 'rerank' AS run, query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, before) AS rank FROM rr) WHERE rank <= 10 UNION ALL ", 1)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, query_id, item_id, rank) of four ways to search: the sources are searched once for all."""
    h = written(_hits(spark, sf_dir))
    fused = R.fuse(h, 20)
    again = R.lexical_rerank(fused, corpus(spark, sf_dir), asked(spark, sf_dir), K).select(F.lit("rerank").alias("run"), "query_id", "item_id", "rank")
    return written(h.select(F.col("source").alias("run"), "query_id", "item_id", "rank").unionByName(fused.select(F.lit("rrf").alias("run"), "query_id", "item_id", "rank")).where(F.col("rank") <= K).unionByName(again))


@query(f"WITH {_MODES} SELECT run, cases, round(recall, 6) AS recall, round(coverage, 6) AS coverage, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM su")
def k21_retrieval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.case_metrics(asked(spark, sf_dir), targets(spark, sf_dir), _modes(spark, sf_dir), K, ("run",))
    return M.summary(m, K, ("run",)).select("run", "cases", *[F.round(c, 6).alias(c) for c in ("recall", "coverage", "ndcg", "mrr")])


@query(f"""WITH {_CASES}, ac AS (SELECT run, 'mrr' AS metric, mrr AS actual FROM su UNION ALL SELECT run, 'ndcg', ndcg FROM su), b AS (SELECT metric, actual AS base FROM ac WHERE run = 'bm25')
    SELECT run, metric || ' lift' AS name, round(actual - base, 6) AS actual, CAST(-0.05 AS DOUBLE) AS threshold, actual - base >= -0.05 AS passed FROM ac JOIN b USING (metric)""")
def l03_ablation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No run may be more than 0.05 worse than the baseline."""
    m = M.case_metrics(asked(spark, sf_dir), targets(spark, sf_dir), runs(spark, sf_dir), K, ("run",))
    lift = M.lift(M.long_metrics(M.summary(m, K, ("run",)), ["run"], ["mrr", "ndcg"]), "bm25", "run").select("run", "metric", F.col("delta").alias("actual"))
    rules = spark.createDataFrame([(f"{x} lift", x, ">=", -0.05) for x in ("mrr", "ndcg")], "name string, metric string, operator string, threshold double")
    return M.gate(lift, rules, ("run",)).select("run", "name", F.round("actual", 6).alias("actual"), "threshold", "passed")


@query(f"WITH {_CASES} SELECT ru.run AS run, coalesce(lang, 'unspecified') AS strategy, count(*) AS hits, count(DISTINCT ru.query_id) AS queries, round(avg(ru.rank), 6) AS mean_rank FROM ru JOIN documents ON item_id = doc_id GROUP BY ALL")
def e13_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by what kind of chunk they are; the language stands for the strategy."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("lang", F.lit("unspecified")).alias("strategy"))
    return d.join(runs(spark, sf_dir), "item_id").groupBy("run", "strategy").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@query("WITH t AS (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '[가-힣A-Za-z0-9_]+'), lambda x: lower(x)))) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def e03_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES} SELECT triple_id, chunk_id FROM rs WHERE place = 1")
def d08_triple_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("place = 1").select("triple_id", "chunk_id")


@query(f"WITH {PACKAGE} SELECT asset_id, coalesce(f.chunk_id, asset_id) AS canonical FROM ast LEFT JOIN (SELECT asset_id, arg_min(chunk_id, (ord, chunk_id)) AS chunk_id FROM lk WHERE ord % 3 <> 0 GROUP BY asset_id) f USING (asset_id)")
def d15_asset_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit on an asset counts for the first chunk that shows it, or for itself; here every third link is missing."""
    first = L.first_by(links(spark, sf_dir).where("ord % 3 <> 0"), "asset_id", "ord", "chunk_id").select("asset_id", "chunk_id")
    return assets(spark, sf_dir).select("asset_id").join(first, "asset_id", "left").select("asset_id", F.coalesce("chunk_id", "asset_id").alias("canonical"))


@query(f"""WITH {PACKAGE}, pr AS (SELECT doc, page_no, asset_id, caption, body, 999 + row_number() OVER (PARTITION BY doc, page_no ORDER BY asset_id) AS idx FROM ast WHERE kind = 'table' AND length(body) >= 20)
    SELECT substr(sha256(doc || ':' || page_no || ':' || page_no || ':table:' || idx), 1, 20) AS chunk_id, asset_id, CAST(idx AS INTEGER) AS idx, md5(caption || chr(10) || chr(10) || body) AS text FROM pr""")
def k17_table_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that say enough become chunks, numbered on their page from 1000."""
    idx = F.row_number().over(Window.partitionBy("doc", "page_no").orderBy("asset_id")) + 999
    t = assets(spark, sf_dir).where("kind = 'table' and length(body) >= 20").withColumn("idx", idx)
    return t.select(chunk_id(F.col("doc"), F.col("page_no"), F.col("page_no"), F.lit("table"), F.col("idx")).alias("chunk_id"), "asset_id", "idx", F.md5(F.concat_ws("\n\n", "caption", "body")).alias("text"))


_NOTES = "an AS (SELECT doc_id AS ord, CASE WHEN labels.doc_id % 2 = 0 THEN 'a' || labels.doc_id END AS asset_id, pg.doc, pg.page_no, 'note ' || quality AS note FROM labels JOIN pg USING (doc_id))"


@query(f"""WITH {PACKAGE}, {_NOTES}, hit AS (SELECT an.ord, ast.asset_id, note FROM an JOIN ast ON an.asset_id = ast.asset_id UNION ALL SELECT an.ord, ast.asset_id, note FROM an JOIN ast ON an.asset_id IS NULL AND an.doc = ast.doc AND an.page_no = ast.page_no),
    la AS (SELECT asset_id, arg_max(note, ord) AS note FROM hit GROUP BY asset_id) SELECT asset_id, coalesce(note, '') AS note FROM ast LEFT JOIN la USING (asset_id)""")
def k16_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes go to the asset they name, or to all on the page they name; the last one stands."""
    at = chunks(spark, sf_dir).select("doc_id", "doc", F.col("page_start").alias("page_no"))
    n = table(spark, sf_dir, "labels").join(at, "doc_id").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("named"), "doc", "page_no", F.concat(F.lit("note "), F.col("quality").cast("string")).alias("note"))
    a = assets(spark, sf_dir).select("asset_id", "doc", "page_no")
    own = n.join(a.select("asset_id"), F.col("named") == F.col("asset_id")).select("ord", "asset_id", "note")
    page = n.where("named is null").join(a, ["doc", "page_no"]).select("ord", "asset_id", "note")
    last = own.unionByName(page).groupBy("asset_id").agg(F.max_by("note", "ord").alias("note"))
    return a.join(last, "asset_id", "left").select("asset_id", F.coalesce("note", F.lit("")).alias("note"))


@query(f"""WITH {PACKAGE}, {ASSET_TRIPLES}, want AS (SELECT asset_id, caption AS subject, 'shown_in' AS predicate, doc AS object FROM ast WHERE trim(caption) <> ''), have AS (SELECT lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS s, lower(object) AS o FROM atr WHERE CAST(substr(triple_id, 2) AS BIGINT) % 2 = 0),
    miss AS (SELECT * FROM want WHERE (lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))), lower(object)) NOT IN (SELECT (s, o) FROM have))
    SELECT substr(sha256(lk.chunk_id || ':' || subject || ':' || predicate || ':' || object), 1, 24) AS triple_id, lk.chunk_id, asset_id, subject, object FROM miss JOIN lk USING (asset_id)""")
def k14_triple_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assets say and no triple does is added to the chunk that shows them; every other triple is missing here."""
    key = [F.lower(F.trim(F.regexp_replace("subject", r"\s+", " "))).alias("s"), F.lower("object").alias("o")]
    want = assets(spark, sf_dir).where("trim(caption) <> ''").select("asset_id", F.col("caption").alias("subject"), F.lit("shown_in").alias("predicate"), F.col("doc").alias("object"))
    have = asset_triples(spark, sf_dir).where(F.substring("triple_id", 2, 18).cast("long") % 2 == 0).select(*key).distinct()
    miss = want.select("*", *key).join(have, ["s", "o"], "left_anti").join(links(spark, sf_dir).select("asset_id", "chunk_id"), "asset_id")
    return miss.select(sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object")).alias("triple_id"), "chunk_id", "asset_id", "subject", "object")
