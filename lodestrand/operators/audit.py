"""Checks of a package's tables against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio, word_tokens


def issue_rows(name: str, kind: str, rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.lit(name).alias("check"), F.lit(kind).alias("issue"), F.col(key).cast("string").alias("key"))


def package_issues(pages: DataFrame, chunks: DataFrame, assets: DataFrame, links: DataFrame) -> DataFrame:
    """(check, issue, key): what a package lacks or has too much of. Every row is listed: whoever shows them may cap them."""
    no_chunk = pages.withColumn("key", F.concat_ws("/", "doc", F.col("page_no").cast("string"))).join(chunks.select("doc", F.explode(F.sequence("page_start", "page_end")).alias("page_no")), ["doc", "page_no"], "left_anti")
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    empty = chunks.where("trim(text) = '' or text is null")
    lost = links.join(assets.select("asset_id"), "asset_id", "left_anti")
    alone = assets.join(links.select("asset_id"), "asset_id", "left_anti")
    return (
        issue_rows("pages", "no chunk", no_chunk, "key").unionByName(issue_rows("chunks", "repeated id", twice, "chunk_id")).unionByName(issue_rows("chunks", "no text", empty, "chunk_id"))
        .unionByName(issue_rows("links", "unknown asset", lost, "asset_id")).unionByName(issue_rows("assets", "not linked", alone, "asset_id"))
    )


def token_manifest(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_chars, tokens): what a lexical index is checked against."""
    return chunks.select("chunk_id", F.length("text").alias("text_chars"), F.sha2(F.array_join(word_tokens(F.col("text")), " "), 256).alias("tokens"))


def verify_manifest(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, issue) where the stored manifest isn't what the chunks give."""
    now = token_manifest(chunks).select(F.col("chunk_id").alias("now_id"), F.col("text_chars").alias("now_chars"), F.col("tokens").alias("now_tokens"))
    issue = F.when(F.col("now_id").isNull(), "stale").when(F.col("chunk_id").isNull(), "missing").when(~F.col("tokens").eqNullSafe(F.col("now_tokens")), "tokens").when(~F.col("text_chars").eqNullSafe(F.col("now_chars")), "chars")
    return stored.join(now, F.col("chunk_id") == F.col("now_id"), "full_outer").select(F.coalesce("chunk_id", "now_id").alias("chunk_id"), issue.alias("issue")).where("issue is not null")


def vector_issues(records: DataFrame, targets: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(vector_name, issue, key): vectors of a wrong size or of length 0, of targets that aren't there, and targets without one. records(vector_name, target_id, vector), targets(vector_name, target_id)."""
    want = F.coalesce(*[F.when(F.col("vector_name") == k, n) for k, n in dims.items()])
    row = lambda df, issue: df.select("vector_name", F.lit(issue).alias("issue"), F.col("target_id").cast("string").alias("key"))
    keys = ["vector_name", "target_id"]
    zero = ~F.exists("vector", lambda x: x != 0)
    return row(records.where(F.size("vector") != want), "wrong size").unionByName(row(records.where(zero), "zero")).unionByName(row(records.join(targets, keys, "left_anti"), "unknown target")).unionByName(row(targets.join(records, keys, "left_anti"), "no vector"))


def contract(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, issue): what is missing, extra or other than expected; both are (key, value)."""
    a = actual.select(F.col(key).alias("k1"), F.col(value).alias("v1"))
    b = expected.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    issue = F.when(F.col("k1").isNull(), "missing").when(F.col("k2").isNull(), "extra").when(~F.col("v1").eqNullSafe(F.col("v2")), "mismatch")
    return a.join(b, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), issue.alias("issue")).where("issue is not null")


def schema_rows(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) of a table, for contract()."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def quality_score(weights: dict[str, float]) -> Column:
    """Weighted mean of those of the 0..1 measures that are there."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    below = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return ratio(top, below)


def overlap_counts(cases: DataFrame) -> DataFrame:
    """Cases of the same query. cases(case_id, query)."""
    return cases.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("n"), F.min("case_id").alias("first")).where("n > 1")
