"""Joins between the record sets of a package: sections, assets, aliases, triples, neighbours, and the difference of two packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import sha_id

#: Pages in one bucket of a range join: ranges meet pages on (document, bucket), never in a nested loop.
BUCKET = 32


def with_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Every page with the section that starts last among those that hold it; on ties the one with the smallest ord. Null where none does.

    pages(doc, page_no, ...), sections(doc, page_start, page_end, ord, section).
    """
    bucket = lambda c: F.floor(c / BUCKET)
    cut = sections.where("page_end >= page_start").select(F.col("doc").alias("s_doc"), "page_start", "page_end", "ord", "section", F.explode(F.sequence(bucket(F.col("page_start")), bucket(F.col("page_end")))).alias("s_bucket"))
    on = (F.col("doc") == F.col("s_doc")) & (bucket(F.col("page_no")) == F.col("s_bucket")) & F.col("page_no").between(F.col("page_start"), F.col("page_end"))
    best = pages.select("doc", "page_no").distinct().join(cut, on).groupBy("doc", "page_no").agg(F.max_by("section", F.struct("page_start", (-F.col("ord")).alias("o"))).alias("section"))
    return pages.join(best, ["doc", "page_no"], "left")


def assets_by_span(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """(chunk_id, assets): the sorted ids of the assets on a chunk's pages. chunks(chunk_id, doc, page_start, page_end), assets(asset_id, doc, page_no)."""
    at = chunks.select("chunk_id", "doc", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    return at.join(assets.select("asset_id", "doc", "page_no"), ["doc", "page_no"]).groupBy("chunk_id").agg(F.array_sort(F.collect_set("asset_id")).alias("assets"))


def asset_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, asset_id) by a chunk's asset_ids or its references 'asset:<id>'. chunks(chunk_id, asset_ids array, refs array)."""
    named = F.transform(F.filter("refs", lambda r: F.startswith(r, F.lit("asset:"))), lambda r: F.substring(r, 7, 1_000_000))
    ids = F.array_distinct(F.concat(F.coalesce("asset_ids", F.array().cast("array<string>")), F.coalesce(named, F.array().cast("array<string>"))))
    return chunks.select("chunk_id", F.explode(ids).alias("asset_id")).where("asset_id <> ''")


def first_by(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    rank = "__lodestrand_first"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def aliases(chunks: DataFrame) -> DataFrame:
    """(alias, chunk_id): a chunk's own id, else the first chunk, by ord, that has the alias as its source or parent; of these a source goes before a parent.

    chunks(chunk_id, source_id, parent_id, ord).
    """
    name = lambda level, at, slot, c: F.struct(F.lit(level).alias("level"), at.cast("long").alias("at"), F.lit(slot).alias("slot"), F.col(c).alias("alias"))
    names = F.array(name(0, F.lit(0), 0, "chunk_id"), name(1, F.col("ord"), 0, "source_id"), name(1, F.col("ord"), 1, "parent_id"))
    flat = chunks.select("chunk_id", F.explode(names).alias("n")).select("chunk_id", "n.*").where("alias <> ''")
    return flat.groupBy("alias").agg(F.min_by("chunk_id", F.struct("level", "at", "slot", "chunk_id")).alias("chunk_id"))


def resolve(triples: DataFrame, alias: DataFrame, links: DataFrame) -> DataFrame:
    """(triple_id, chunk_id, place): the chunks that a triple speaks of, in order: what its reference means first, then the chunks of its assets.

    triples(triple_id, ref, asset_ids array), alias(alias, chunk_id), links(chunk_id, asset_id, ord).
    """
    own = triples.join(alias, F.col("ref") == F.col("alias")).select("triple_id", "chunk_id", F.lit(-1).cast("long").alias("at"))
    seen = triples.select("triple_id", F.posexplode("asset_ids").alias("i", "asset_id")).join(links, "asset_id").select("triple_id", "chunk_id", (F.col("i") * F.lit(1 << 40) + F.col("ord")).cast("long").alias("at"))
    first = own.unionByName(seen).groupBy("triple_id", "chunk_id").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("triple_id").orderBy("at", "chunk_id"))).drop("at")


def remap(triples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Triples set on the first chunk they resolve to, with their id made anew; those without one go; equal ids are one, the last by triple_id."""
    at = triples.drop("chunk_id").join(resolved.where("place = 1").select("triple_id", "chunk_id"), "triple_id")
    new = at.withColumn("new_id", sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object")))
    return first_by(new, "new_id", F.desc("triple_id")).select(F.col("new_id").alias("triple_id"), "chunk_id", "subject", "predicate", "object", F.col("triple_id").alias("was"))


def neighbours(items: DataFrame, hits: DataFrame, reach: int) -> DataFrame:
    """(doc, item_id, near_id, distance): the items up to reach places before and after each hit. items(doc, item_id, place); hits(doc, item_id)."""
    at = hits.join(items, ["doc", "item_id"]).select("doc", "item_id", F.col("place").alias("p"), F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1) if i])).alias("distance"))
    other = items.select("doc", F.col("item_id").alias("near_id"), "place")
    return at.withColumn("place", F.col("p") + F.col("distance")).join(other, ["doc", "place"]).select("doc", "item_id", "near_id", "distance")


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of the records that were added, removed or changed in any column."""
    name = "__lodestrand_record"
    record = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    a = before.select(F.col(key).alias("k1"), record(before).alias(name + "1"))
    b = after.select(F.col(key).alias("k2"), record(after).alias(name + "2"))
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when(F.col(name + "1") != F.col(name + "2"), "changed")
    return a.join(b, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), change.alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_best(results: DataFrame, key: str, status: str = "status", order: str = "ord") -> DataFrame:
    """Of each key the best result: completed before failed before skipped, the first on ties."""
    rank = F.when(F.col(status) == "completed", 0).when(F.col(status) == "failed", 1).otherwise(2)
    return first_by(results, key, rank, order)


def job_assets(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """jobs(job_id, asset_id) with their assets' columns, a status and an error: a job whose asset isn't there has failed."""
    there = assets.withColumn("__there", F.lit(True))
    x = jobs.join(there, "asset_id", "left")
    gone = F.col("__there").isNull()
    return x.select(*jobs.columns, F.when(gone, "failed").otherwise("completed").alias("status"), F.when(gone, "no such asset").alias("error"), *[c for c in assets.columns if c != "asset_id"])


def chunk_order() -> list[Column]:
    """The order of a document's chunks, which is total."""
    return [F.col(c) for c in ("page_start", "page_end", "kind", "subchunk_index", "chunk_id")]
