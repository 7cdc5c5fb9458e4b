"""Gates: tables of thresholds against metrics in long form, with limits against a baseline. Every report is one join.

A suite says which metric each threshold is about and whether it is a floor or a ceiling. Thresholds of groups are given by key: {"min_source_target_coverage": {"bm25": 0.5}} asks the metric source.bm25.target_coverage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ratio

_RANKS = ("mean_first_relevant_rank", "p95_first_relevant_rank", "mean_target_rank", "p95_target_rank")
_SCORES = ("recall_at_k", "target_coverage_at_k", "target_ndcg_at_k", "mrr", "precision_at_k")
_LATENCY = ("mean_latency_ms", "p95_latency_ms")
_EXCLUDED = ("excluded_target_hit_rate", "excluded_query_hit_rate", "excluded_hit_query_count")
_GROUPED = {
    "min_target_type_coverage": "target_type.{}.target_coverage", "min_source_target_coverage": "source.{}.target_coverage", "min_source_family_target_coverage": "source_family.{}.target_coverage",
    "min_source_precision_at_hits": "source.{}.precision_at_hits", "min_source_family_precision_at_hits": "source_family.{}.precision_at_hits", "min_chunk_strategy_target_coverage": "chunk_strategy.{}.target_coverage",
    "min_retrieval_role_target_coverage": "retrieval_role.{}.target_coverage", "min_case_group_target_coverage": "case_group.{}.target_coverage", "min_case_group_source_target_coverage": "case_group_source.{}.target_coverage",
    "min_case_group_source_family_target_coverage": "case_group_source_family.{}.target_coverage", "min_case_group_source_precision_at_hits": "case_group_source.{}.precision_at_hits", "min_case_group_source_family_precision_at_hits": "case_group_source_family.{}.precision_at_hits",
    "max_source_excluded_target_hit_rate": "source.{}.excluded_target_hit_rate", "max_source_family_excluded_target_hit_rate": "source_family.{}.excluded_target_hit_rate", "max_chunk_strategy_excluded_target_hit_rate": "chunk_strategy.{}.excluded_target_hit_rate",
    "max_retrieval_role_excluded_target_hit_rate": "retrieval_role.{}.excluded_target_hit_rate", "max_case_group_excluded_target_hit_rate": "case_group.{}.excluded_target_hit_rate",
}


def _limits(floors: tuple[str, ...] = (), ceilings: tuple[str, ...] = (), **more: str) -> dict[str, str]:
    return {f"min_{m}": m for m in floors} | {f"max_{m}": m for m in ceilings} | more


#: Threshold and metric of every suite. A name says by its beginning whether it is a floor or a ceiling.
SUITES: dict[str, dict[str, str]] = {
    "retrieval": _limits(("case_count", "expected_case_count", "expected_target_count", "passed_query_count", *_SCORES, "result_stability_rate"), ("failed_query_count", *_RANKS, *_LATENCY, "unstable_result_count", *_EXCLUDED)),
    "chunking": _limits(
        ("quality_score", "page_coverage_ratio", "visual_annotation_ratio", "visual_text_coverage_ratio", "visual_text_part_coverage_ratio", *_SCORES, "result_stability_rate", *[f"{m}_per_{d}" for d in ("embedding_kchar", "mean_latency_ms", "p95_latency_ms") for m in ("retrieval_score", "target_coverage", "target_ndcg")]),
        (*_RANKS, *_LATENCY, "unstable_result_count", "failed_queries", "total_chunk_chars", "embedding_text_kchars", "chunks_under_min_chars", "chunks_over_max_chars"),
    ) | {f"min_pairwise_{m}": f"pairwise.{m}" for m in ("shared_queries", "win_rate", *[f"{x}_{y}" for x in ("target_coverage", "target_ndcg", "mrr", "precision") for y in ("lift", "ci_low")])}
    | {f"max_pairwise_{m}": f"pairwise.{m}" for m in ("mean_first_relevant_rank_delta", "mean_target_rank_delta", "first_relevant_rank_delta_ci_high", "target_rank_delta_ci_high", "mean_latency_delta_ms")},
    "context": _limits(("case_count", "expected_case_count", "expected_target_count", "passed_case_count", "hit_rate", "target_coverage"), ("failed_case_count", *_EXCLUDED, "mean_latency_ms", "mean_context_char_count", "context_char_count", "mean_chunk_count", "mean_asset_count", "mean_triple_count")),
    "visual": _limits(("completion_rate", "annotation_rate", "ocr_text_coverage", "vlm_summary_coverage", "vlm_json_parse_rate", "vlm_object_coverage", "objects_per_vlm_job", "object_bbox_coverage", "triples_per_vlm_job", "mean_ocr_text_chars", "mean_vlm_summary_chars"), ("failed_count", "skipped_count")),
}
#: Limits against the baseline run: by how much a metric may fall, and how many times the baseline's it may be.
DROPS = {f"max_{n}_drop": m for n, m in (("quality", "quality_score"), ("recall", "recall_at_k"), ("target_coverage", "target_coverage_at_k"), ("target_ndcg", "target_ndcg_at_k"), ("precision", "precision_at_k"))}
RATIOS = {f"max_{m.removesuffix('_ms')}_ratio": m for m in _LATENCY}
RULE = "name string, metric string, operator string, threshold double"


def rules(spark: SparkSession, suite: str, thresholds: Mapping[str, float | Mapping[str, float] | None]) -> DataFrame:
    """(name, metric, operator, threshold) of the thresholds that are given: configuration, a few dozen rows. An unknown name is an error."""
    out = []
    for name, value in thresholds.items():
        if value is None:
            continue
        operator = ">=" if name.startswith("min_") else "<="
        if isinstance(value, Mapping):
            out += [(f"{name}:{key}", _GROUPED[name].format(key), operator, float(v)) for key, v in value.items()]
        elif name in DROPS and suite in ("retrieval", "chunking"):
            out.append((name, DROPS[name], "baseline_drop<=", float(value)))
        elif name in RATIOS and suite in ("retrieval", "chunking"):
            out.append((name, RATIOS[name], "actual/baseline<=", float(value)))
        else:
            out.append((name, SUITES[suite][name], operator, float(value)))
    return spark.createDataFrame(out, RULE)


def check_rows(actuals: DataFrame, rules_: DataFrame, keys: tuple[str, ...] = (), baseline: DataFrame | None = None) -> DataFrame:
    """(keys..., name, metric, operator, actual, baseline, delta, ratio, threshold, passed): every rule against actuals(keys..., metric, actual), and baseline(metric, actual) where the rule is about one.

    A metric that is missing fails its check, as does a rule about a baseline without one. Where the baseline is not above 0 there is no ratio, and only an actual of 0 or less passes.
    """
    t = F.broadcast(rules_)  # configuration
    if keys:
        t = actuals.select(*keys).distinct().crossJoin(t)
    against = F.col("operator").isin("baseline_drop<=", "actual/baseline<=")
    x = t.join(actuals, [*keys, "metric"], "left")
    if baseline is None:
        x = x.withColumn("base", F.lit(None).cast("double"))
    else:
        x = x.join(F.broadcast(baseline.select("metric", F.col("actual").alias("base"))), "metric", "left")  # a row for each metric of one run
    a, b, limit = F.col("actual"), F.col("base"), F.col("threshold")
    times = F.when(b > 0, a / b)
    ok = F.when(F.col("operator") == ">=", a >= limit).when(F.col("operator") == "<=", a <= limit).when(F.col("operator") == "baseline_drop<=", b - a <= limit).otherwise(F.when(times.isNull(), (a <= 0) & b.isNotNull()).otherwise(times <= limit))
    return x.select(*keys, "name", "metric", "operator", "actual", F.when(against, b).alias("baseline"), F.when(against, a - b).alias("delta"), F.when(F.col("operator") == "actual/baseline<=", times).alias("ratio"), "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def latency(samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., mean_latency_ms, p95_latency_ms) of samples(keys..., query_id, repeat, ms), over all repeats."""
    return samples.groupBy(*keys).agg(F.avg("ms").alias("mean_latency_ms"), F.percentile("ms", 0.95).alias("p95_latency_ms"))


def stability(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., queries, unstable_result_count, result_stability_rate): a query is stable if every repeat gave the same items in the same order. hits(keys..., query_id, repeat, rank, item_id); of a query of one repeat nothing is unstable."""
    lists = hits.groupBy(*keys, "query_id", "repeat").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("hits"))  # of one query, k at most
    each = lists.groupBy(*keys, "query_id").agg((F.count_distinct("hits") <= 1).alias("stable"))
    n = F.sum((~F.col("stable")).cast("int"))
    return each.groupBy(*keys).agg(F.count("*").alias("queries"), n.alias("unstable_result_count"), ratio(F.count("*") - n, F.count("*")).alias("result_stability_rate"))


def visual_metrics() -> list[Column]:
    """The metrics of the visual suite as aggregates over results(status, annotated, ocr, vlm: whether asked for, ocr_chars, vlm_chars, parsed, objects, boxes, triples). A rate of nothing is 0."""
    n, ocr, vlm = F.count("*"), F.col("ocr"), F.col("vlm")
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    objects = total(F.when(vlm, F.col("objects")))
    rates = {
        "completion_rate": (some(F.col("status") == "completed"), n), "annotation_rate": (some(F.col("annotated")), n), "ocr_text_coverage": (some(ocr & (F.col("ocr_chars") > 0)), some(ocr)), "vlm_summary_coverage": (some(vlm & (F.col("vlm_chars") > 0)), some(vlm)),
        "vlm_json_parse_rate": (some(vlm & F.col("parsed")), some(vlm)), "vlm_object_coverage": (some(vlm & (F.col("objects") > 0)), some(vlm)), "objects_per_vlm_job": (objects, some(vlm)), "object_bbox_coverage": (total(F.when(vlm, F.col("boxes"))), objects),
        "triples_per_vlm_job": (total(F.when(F.col("annotated"), F.col("triples"))), some(vlm)), "mean_ocr_text_chars": (total(F.when(ocr, F.col("ocr_chars"))), some(ocr)), "mean_vlm_summary_chars": (total(F.when(vlm, F.col("vlm_chars"))), some(vlm)),
    }
    return [ratio(*x).alias(name) for name, x in rates.items()] + [some(F.col("status") == s).cast("double").alias(f"{s}_count") for s in ("failed", "skipped")]
