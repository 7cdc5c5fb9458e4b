"""Chunks of a package: page level and split; summaries of vector records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, sha_id
from ..functions.splitter import split_column
from ..functions.text import clean_lines, text_quality
from .links import with_section


def page_chunks(pages: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One chunk a page: its cleaned text if that is good, else a placeholder that asks for OCR.

    (chunk_id, doc, page_start, page_end, kind, text, section, needs_ocr). pages(doc, page_no, text).
    """
    at = with_section(pages, sections) if sections is not None else pages.withColumn("section", F.lit(None).cast("string"))
    # on its own, so that it is found once and not for each column made of it
    at = at.withColumn("__good", text_quality(F.col("text"))["quality"] == "good")
    good = F.col("__good")
    kind = F.when(good, "text").otherwise("page_summary")
    text = F.when(good, clean_lines(F.col("text"))).otherwise(F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(" has no usable text.")))
    return at.select(chunk_id(F.col("doc"), F.col("page_no"), F.col("page_no"), kind, F.lit(0)).alias("chunk_id"), "doc", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), kind.alias("kind"), text.alias("text"), "section", (~good).alias("needs_ocr"))


def split_chunks(chunks: DataFrame, size: int = 1600, overlap: int = 180, least: int = 180) -> DataFrame:
    """Chunks cut into bounded pieces; a chunk of one piece keeps its id. Adds (idx, total, parent_id)."""
    p = chunks.withColumn("p", F.explode(split_column(F.col("text"), size, overlap, least)))
    one = F.col("p.total") <= 1
    rest = [c for c in chunks.columns if c not in ("chunk_id", "text", "kind")]
    kind = F.when(one, F.col("kind")).otherwise(F.when(F.col("kind") == "page_summary", "text").otherwise(F.col("kind")))
    return p.select(F.when(one, F.col("chunk_id")).otherwise(sha_id(20, F.col("chunk_id"), F.lit("semantic"), F.col("p.idx"))).alias("chunk_id"), *rest, kind.alias("kind"), F.col("p.text").alias("text"), F.col("p.idx").alias("idx"), F.col("p.total").alias("total"), F.when(~one, F.col("chunk_id")).alias("parent_id"))


def record_summary(records: DataFrame) -> DataFrame:
    """For each vector name: records, distinct targets, sizes. records(vector_name, target_id, vector)."""
    d = F.size("vector")
    return records.groupBy("vector_name").agg(F.count("*").alias("records"), F.count_distinct("target_id").alias("targets"), F.min(d).alias("dim_min"), F.max(d).alias("dim_max"), (F.min(d) == F.max(d)).alias("consistent"))
