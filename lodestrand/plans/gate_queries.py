"""Queries of gates, stability, record sets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.text import source_family
from ..operators import gates as G
from ..operators import links as L
from ..operators import metrics as M
from ..operators import records as R
from .corpus import ASSET_TRIPLES, PACKAGE, asset_triples, assets, chunks, links, table
from .link_queries import _OBJECTS, _resolved, rich
from .metric_queries import _CASES, K, _metrics, runs
from .registry import query

_LIMITS = {
    "min_case_count": 10, "min_expected_case_count": 10, "min_expected_target_count": 20, "min_passed_query_count": 15, "max_failed_query_count": 3, "min_recall_at_k": 0.8, "min_target_coverage_at_k": 0.75, "min_target_ndcg_at_k": 0.7, "min_mrr": 0.5,
    "min_precision_at_k": 0.05, "max_mean_target_rank": 3, "max_p95_target_rank": 5, "max_mean_latency_ms": 100, "min_source_family_target_coverage": {"lexical": 0.5, "graph": 0.1}, "max_recall_drop": 0.05, "max_target_ndcg_drop": 0.0, "max_excluded_query_hit_rate": 0.2,
}
_CHECKS = [
    ("min_case_count", "case_count", ">=", 10), ("min_expected_case_count", "expected_case_count", ">=", 10), ("min_expected_target_count", "expected_target_count", ">=", 20), ("min_passed_query_count", "passed_query_count", ">=", 15), ("max_failed_query_count", "failed_query_count", "<=", 3),
    ("min_recall_at_k", "recall_at_k", ">=", 0.8), ("min_target_coverage_at_k", "target_coverage_at_k", ">=", 0.75), ("min_target_ndcg_at_k", "target_ndcg_at_k", ">=", 0.7), ("min_mrr", "mrr", ">=", 0.5), ("min_precision_at_k", "precision_at_k", ">=", 0.05), ("max_mean_target_rank", "mean_target_rank", "<=", 3),
    ("max_p95_target_rank", "p95_target_rank", "<=", 5), ("max_mean_latency_ms", "mean_latency_ms", "<=", 100), ("min_source_family_target_coverage:lexical", "source_family.lexical.target_coverage", ">=", 0.5), ("min_source_family_target_coverage:graph", "source_family.graph.target_coverage", ">=", 0.1),
    ("max_recall_drop", "recall_at_k", "baseline_drop<=", 0.05), ("max_target_ndcg_drop", "target_ndcg_at_k", "baseline_drop<=", 0.0), ("max_excluded_query_hit_rate", "excluded_query_hit_rate", "<=", 0.2),
]
_CHECKS_SQL = "rl(name, metric, operator, threshold) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE))" for a, b, c, d in _CHECKS) + ")"
_LONG = {"case_count": "cases", "expected_case_count": "expected_cases", "expected_target_count": "expected_targets", "passed_query_count": "passed_queries", "failed_query_count": "failed", "recall_at_k": "recall", "target_coverage_at_k": "coverage", "target_ndcg_at_k": "ndcg", "mrr": "mrr", "precision_at_k": "precision", "mean_target_rank": "mean_target_rank", "p95_target_rank": "p95_target_rank", "excluded_query_hit_rate": "excluded_rate"}


@query(f"""WITH {_CASES}, more AS (SELECT run, CAST(sum(CASE WHEN expected > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS expected_cases, CAST(sum(expected) AS DOUBLE) AS expected_targets, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS DOUBLE) AS passed_queries, avg(CASE WHEN excluded_hits > 0 THEN 1.0 ELSE 0.0 END) AS excluded_rate FROM ce GROUP BY run),
    wide AS (SELECT * FROM su JOIN more USING (run)), ac AS ({" UNION ALL ".join(f"SELECT run, '{m}' AS metric, CAST({c} AS DOUBLE) AS actual FROM wide" for m, c in _LONG.items())}
      UNION ALL SELECT run, 'source_family.' || CASE run WHEN 'bm25' THEN 'lexical' WHEN 'dense' THEN 'dense_text' ELSE run END || '.target_coverage', coverage FROM su), {_CHECKS_SQL},
    b AS (SELECT metric, actual AS base FROM ac WHERE run = 'bm25'), ch AS (SELECT r.run, rl.*, actual, base FROM (SELECT DISTINCT run FROM su) r CROSS JOIN rl LEFT JOIN ac ON ac.run = r.run AND ac.metric = rl.metric LEFT JOIN b ON b.metric = rl.metric)
    SELECT run, name, metric, operator, round(actual, 6) AS actual, round(CASE WHEN operator = 'baseline_drop<=' THEN actual - base END, 6) AS delta, threshold,
      coalesce(CASE operator WHEN '>=' THEN actual >= threshold WHEN '<=' THEN actual <= threshold ELSE base - actual <= threshold END, FALSE) AS passed FROM ch""")
def l01_retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors, ceilings, limits of groups and against the baseline for three runs; latency isn't measured here, so its check fails."""
    m = written(_metrics(spark, sf_dir))
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    more = m.groupBy("run").agg(some(F.col("expected") > 0).alias("expected_cases"), F.sum("expected").cast("double").alias("expected_targets"), some(F.col("passed")).alias("passed_queries"), F.avg(F.when(F.col("excluded_hits") > 0, 1.0).otherwise(0.0)).alias("excluded_rate"))
    wide = written(M.summary(m, K, ("run",)).join(more, "run"))
    long = M.long_metrics(wide.select("run", *[F.col(c).cast("double").alias(name) for name, c in _LONG.items()]), ["run"], list(_LONG))
    family = wide.select("run", F.concat(F.lit("source_family."), source_family(F.col("run")), F.lit(".target_coverage")).alias("metric"), F.col("coverage").cast("double").alias("actual"))
    actuals = long.unionByName(family)
    out = G.check_rows(actuals, G.rules(spark, "retrieval", _LIMITS), ("run",), actuals.where("run = 'bm25'"))
    return out.select("run", "name", "metric", "operator", F.round("actual", 6).alias("actual"), F.round("delta", 6).alias("delta"), "threshold", "passed")


_RESULTS = "re AS (SELECT user_id % 4 AS run, CASE event_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'completed' END AS status, event_id % 9 > 1 AS annotated, event_id % 2 = 0 AS ocr, event_id % 3 > 0 AS vlm, CAST(event_id % 5 AS BIGINT) * 20 AS ocr_chars, CAST(event_id % 7 AS BIGINT) * 30 AS vlm_chars, event_id % 4 > 0 AS parsed, event_id % 6 AS objects, event_id % 6 // 2 AS boxes, event_id % 3 AS triples FROM events)"
_SUM0 = lambda x: f"coalesce(sum({x}), 0)"
_SOME = lambda x: f"coalesce(sum(CASE WHEN {x} THEN 1 ELSE 0 END), 0)"
_RATES = {
    "completion_rate": (_SOME("status = 'completed'"), "count(*)"), "annotation_rate": (_SOME("annotated"), "count(*)"), "ocr_text_coverage": (_SOME("ocr AND ocr_chars > 0"), _SOME("ocr")), "vlm_summary_coverage": (_SOME("vlm AND vlm_chars > 0"), _SOME("vlm")), "vlm_json_parse_rate": (_SOME("vlm AND parsed"), _SOME("vlm")),
    "vlm_object_coverage": (_SOME("vlm AND objects > 0"), _SOME("vlm")), "objects_per_vlm_job": (_SUM0("CASE WHEN vlm THEN objects END"), _SOME("vlm")), "object_bbox_coverage": (_SUM0("CASE WHEN vlm THEN boxes END"), _SUM0("CASE WHEN vlm THEN objects END")), "triples_per_vlm_job": (_SUM0("CASE WHEN annotated THEN triples END"), _SOME("vlm")),
    "mean_ocr_text_chars": (_SUM0("CASE WHEN ocr THEN ocr_chars END"), _SOME("ocr")), "mean_vlm_summary_chars": (_SUM0("CASE WHEN vlm THEN vlm_chars END"), _SOME("vlm")),
}
_VISUAL_LIMITS = {"min_completion_rate": 0.75, "min_annotation_rate": 0.8, "min_ocr_text_coverage": 0.8, "min_vlm_summary_coverage": 0.85, "min_vlm_json_parse_rate": 0.7, "min_vlm_object_coverage": 0.9, "min_objects_per_vlm_job": 2.0, "min_object_bbox_coverage": 0.4, "min_triples_per_vlm_job": 1.2, "min_mean_ocr_text_chars": 40.0, "min_mean_vlm_summary_chars": 90.0, "max_failed_count": 300.0, "max_skipped_count": 0.0}


@query(f"""WITH {_RESULTS}, w AS (SELECT run, {", ".join(f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END AS {m}" for m, (a, b) in _RATES.items())}, CAST({_SOME("status = 'failed'")} AS DOUBLE) AS failed_count, CAST({_SOME("status = 'skipped'")} AS DOUBLE) AS skipped_count FROM re GROUP BY run),
    rl(name, metric, threshold) AS (VALUES {", ".join(f"('{n}', '{n[4:]}', CAST({v} AS DOUBLE))" for n, v in _VISUAL_LIMITS.items())}), ac AS ({" UNION ALL ".join(f"SELECT run, '{m}' AS metric, {m} AS actual FROM w" for m in [*_RATES, "failed_count", "skipped_count"])})
    SELECT run, name, round(actual, 6) AS actual, threshold, CASE WHEN name LIKE 'min%' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM ac JOIN rl USING (metric)""")
def l05_visual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of visual jobs in four runs."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("run"), F.when(i % 9 == 0, "failed").when(i % 9 == 1, "skipped").otherwise("completed").alias("status"), (i % 9 > 1).alias("annotated"), (i % 2 == 0).alias("ocr"), (i % 3 > 0).alias("vlm"), (i % 5 * 20).alias("ocr_chars"), (i % 7 * 30).alias("vlm_chars"), (i % 4 > 0).alias("parsed"),
        (i % 6).alias("objects"), F.floor(i % 6 / 2).alias("boxes"), (i % 3).alias("triples"),
    )
    long = M.long_metrics(e.groupBy("run").agg(*G.visual_metrics()), ["run"], [*_RATES, "failed_count", "skipped_count"])
    return G.check_rows(long, G.rules(spark, "visual", _VISUAL_LIMITS), ("run",)).select("run", "name", F.round("actual", 6).alias("actual"), "threshold", "passed")


@query(f"""WITH {_CASES}, rp AS (SELECT run, query_id, 0 AS rep, rank, item_id FROM ru UNION ALL SELECT run, query_id, 1, rank, CASE WHEN query_id % 7 = 0 AND rank = 1 THEN -1 ELSE item_id END FROM ru),
    ls AS (SELECT run, query_id, rep, list(item_id ORDER BY rank) AS l FROM rp GROUP BY ALL), s AS (SELECT run, query_id, count(DISTINCT l) <= 1 AS stable FROM ls GROUP BY ALL)
    SELECT run, count(*) AS queries, CAST(sum(CASE WHEN stable THEN 0 ELSE 1 END) AS BIGINT) AS unstable, round(avg(CASE WHEN stable THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY run""")
def g_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repeats of every search, the second with another first hit for every seventh query."""
    r = runs(spark, sf_dir)
    other = F.when((F.col("query_id") % 7 == 0) & (F.col("rank") == 1), -1).otherwise(F.col("item_id"))
    both = r.withColumn("repeat", F.lit(0)).unionByName(r.withColumn("repeat", F.lit(1)).withColumn("item_id", other))
    return G.stability(both, ("run",)).select("run", "queries", F.col("unstable_result_count").alias("unstable"), F.round("result_stability_rate", 6).alias("rate"))


@query(f"""WITH {_OBJECTS}, {ASSET_TRIPLES}, rc AS (SELECT 'text_dense' AS vector_name, 'text' AS target_kind, chunk_id AS target_id, chunk_id, text FROM ch UNION ALL SELECT 'caption_dense', kind, asset_id, asset_id, array_to_string(parts, chr(10)) FROM tx UNION ALL SELECT 'object_dense', 'visual_object', asset_id || ':object:' || idx, asset_id, otext FROM o1
      UNION ALL SELECT 'triple_dense', 'graph_triple', atr.triple_id, rs.chunk_id, concat_ws(' ', trim(subject), replace(predicate, '_', ' '), trim(object), 'evidence ' || trim(regexp_replace(subject, '\\s+', ' ', 'g'))) FROM atr JOIN rs ON atr.triple_id = rs.triple_id AND place = 1 WHERE trim(subject) <> '')
    SELECT vector_name, target_kind, target_id, chunk_id, md5(text) AS text, CAST(384 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS norm FROM rc WHERE trim(text) <> ''""")
def k08_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector records of chunks, assets, objects and triples, with the length of their vectors."""
    none = lambda *names: [F.lit(None).cast("array<string>" if n == "attributes" else "array<double>" if n == "bbox" else "string").alias(n) for n in names]
    first = _resolved(spark, sf_dir).where("place = 1").select("triple_id", "chunk_id")
    t = asset_triples(spark, sf_dir).where("trim(subject) <> ''").join(first, "triple_id").select("triple_id", "chunk_id", F.col("object").alias("doc"), "subject", "predicate", "object", F.col("subject").alias("evidence"), *none("attributes", "description", "location", "bbox", "bbox_region", "source_field", "source_key"))
    r = R.record_sets(chunks(spark, sf_dir).withColumn("kind", F.lit("text")), rich(spark, sf_dir), links(spark, sf_dir), t)
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return r.select("vector_name", "target_kind", "target_id", "chunk_id", F.md5("text").alias("text"), F.size("vector").alias("dim"), norm.alias("norm"))


@query(f"WITH {PACKAGE} SELECT p_partkey AS job_id, 'a' || p_partkey AS asset_id, CASE WHEN ast.asset_id IS NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN ast.asset_id IS NULL THEN 'no such asset' END AS error, kind FROM part LEFT JOIN ast ON ast.asset_id = 'a' || p_partkey")
def d20_job_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and the assets they are about; a job without one is a failed result."""
    j = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("asset_id"))
    return L.job_assets(j, assets(spark, sf_dir).select("asset_id", "kind"))


@query(f"""WITH {PACKAGE}, nw AS (SELECT asset_id, doc, page_no, 'new ' || caption AS caption FROM ast WHERE page_id % 3 = 0 UNION ALL SELECT 'z' || page_id, doc, page_no, 'added' FROM ast WHERE page_id % 10 = 0),
    mg AS (SELECT asset_id, doc, page_no, caption FROM ast WHERE asset_id NOT IN (SELECT asset_id FROM nw) UNION ALL SELECT * FROM nw) SELECT asset_id, md5(caption) AS caption, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_no, asset_id) AS INTEGER) AS place FROM mg""")
def j02_merge_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with newer ones in place of those of the same id; in order of page and id."""
    a = assets(spark, sf_dir)
    cols = ("asset_id", "doc", "page_no", "caption")
    new = a.where("page_id % 3 = 0").withColumn("caption", F.concat(F.lit("new "), "caption")).select(*cols).unionByName(a.where("page_id % 10 = 0").select(F.concat(F.lit("z"), F.col("page_id").cast("string")).alias("asset_id"), "doc", "page_no", F.lit("added").alias("caption")))
    m = L.upsert(a.select(*cols), new, ["asset_id"])
    return m.select("asset_id", F.md5("caption").alias("caption"), F.row_number().over(Window.partitionBy("doc").orderBy("page_no", "asset_id")).alias("place"))


@query(f"WITH {PACKAGE} SELECT chunk_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_start, page_end, lang, doc_id % 3, chunk_id) AS BIGINT) AS place FROM ch")
def f21_chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every chunk in its document: by pages, kind, number within its source, id."""
    c = chunks(spark, sf_dir).select("chunk_id", "doc", "page_start", "page_end", F.col("lang").alias("kind"), (F.col("doc_id") % 3).alias("subchunk_index"))
    return c.select("chunk_id", F.row_number().over(Window.partitionBy("doc").orderBy(*L.chunk_order())).cast("long").alias("place"))


@query(f"""WITH {_CASES}, gs AS (SELECT 'group ' || (query_id % 3) AS grp, run, avg(coverage) AS coverage, avg(ndcg) AS ndcg, avg(precision) AS precision, avg(CASE WHEN excluded_hits > 0 THEN 1.0 ELSE 0.0 END) AS excluded FROM ce GROUP BY ALL)
    SELECT grp, arg_max(run, (round(coverage, 9), round(ndcg, 9), -ascii(run))) AS best_coverage, arg_max(run, (round(excluded, 9), -ascii(run))) AS most_excluded, arg_min(run, (round(precision, 9), ascii(run))) AS least_precise FROM gs GROUP BY grp""")
def e28_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every group of cases, the run that covers most, that hits most of what is excluded, that is least precise; ties go to the name that begins with the earlier letter."""
    g = _metrics(spark, sf_dir).groupBy(F.concat(F.lit("group "), (F.col("query_id") % 3).cast("string")).alias("grp"), "run").agg(F.avg("coverage").alias("coverage"), F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"), F.avg(F.when(F.col("excluded_hits") > 0, 1.0).otherwise(0.0)).alias("excluded"))
    r, first = (lambda c: F.round(c, 9)), F.ascii("run")
    return g.groupBy("grp").agg(F.max_by("run", F.struct(r("coverage"), r("ndcg"), -first)).alias("best_coverage"), F.max_by("run", F.struct(r("excluded"), -first)).alias("most_excluded"), F.min_by("run", F.struct(r("precision"), first)).alias("least_precise"))
