"""Context bundles: hits with evidence, neighbours, assets and triples, ready to be cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio, trim_context
from .links import neighbours


def bundle(hits: DataFrame, chunks: DataFrame, *, reach: int = 1, limit: int = 1200) -> DataFrame:
    """(query_id, place, item_id, role, rank, text): each query's hits by rank, each followed by its neighbours that aren't hits or given before; texts cut at limit.

    hits(query_id, item_id, rank), chunks(item_id, doc, place, text).
    """
    at = chunks.select("doc", "item_id", "place")
    doc_hits = hits.join(at.select("item_id", "doc"), "item_id")
    near = neighbours(at, doc_hits.select("doc", "item_id").distinct(), reach)
    more = doc_hits.join(near.drop("doc"), "item_id").select("query_id", F.col("near_id").alias("item_id"), F.lit("neighbour").alias("role"), "rank", (F.abs("distance") * 2 + (F.col("distance") > 0).cast("int")).alias("step"))
    all_ = hits.select("query_id", "item_id", F.lit("hit").alias("role"), "rank", F.lit(0).alias("step")).unionByName(more)
    first = Window.partitionBy("query_id", "item_id").orderBy((F.col("role") != "hit").cast("int"), "rank", "step")
    one = all_.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy("rank", "step", "item_id")
    placed = one.withColumn("place", F.row_number().over(order))
    return placed.join(chunks.select("item_id", "text"), "item_id").select("query_id", "place", "item_id", "role", "rank", trim_context(F.col("text"), limit).alias("text"))


def rendered(bundles: DataFrame, cite: Column) -> DataFrame:
    """(query_id, context): the bundle as one text, each part under its number and citation."""
    part = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), cite, F.lit("\n"), F.col("text"))
    x = bundles.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("ps"))
    return x.select("query_id", F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("context"))


def context_metrics(bundles: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, parts, hits, chars, expected, found, coverage, complete): complete if every expected item is in the context. targets(query_id, item_id)."""
    size = bundles.groupBy("query_id").agg(F.count("*").alias("parts"), F.sum((F.col("role") == "hit").cast("int")).alias("hits"), F.sum(F.length("text")).alias("chars"))
    want = targets.groupBy("query_id").agg(F.count_distinct("item_id").alias("expected"))
    got = targets.join(bundles, ["query_id", "item_id"]).groupBy("query_id").agg(F.count_distinct("item_id").alias("found"))
    x = size.join(want, "query_id", "left").join(got, "query_id", "left").fillna(0, ["expected", "found"])
    return x.withColumn("coverage", ratio(F.col("found"), F.col("expected"))).withColumn("complete", F.col("found") == F.col("expected"))
