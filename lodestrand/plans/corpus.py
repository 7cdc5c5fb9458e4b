"""How the given tables stand for packages, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import sha_id


#: Bytes of a table of texts, as its files have them, up to which its rows are dealt out over the cores; larger ones come in partitions enough.
_SPREAD_BYTES = 256 << 20
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A small one of texts, which may be a single row group and so a single task's, is dealt out by id."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _TEXTS and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= _SPREAD_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism, _TEXTS[name])
    return df


def numbered(df: DataFrame, group: str, order: str, width: int = 8192) -> Column:
    """df with page_no: the place of each row in its group by a bigint order, from 1. A group is numbered in slices of the order, so a large one isn't sorted in one task."""
    slice_ = F.floor(F.col(order) / width).alias("slice")
    counts = df.groupBy(group, slice_).agg(F.count("*").alias("n"))
    before = counts.select(F.col(group).alias("g"), F.col("slice").alias("s"), (F.sum("n").over(Window.partitionBy(group).orderBy("slice")) - F.col("n")).alias("before"))
    own = df.withColumn("slice", F.floor(F.col(order) / width))
    at = own.withColumn("k", F.row_number().over(Window.partitionBy(group, "slice").orderBy(order)))
    return at.join(before, (F.col(group) == F.col("g")) & (F.col("slice") == F.col("s"))).withColumn("page_no", (F.col("k") + F.col("before")).cast("long")).drop("slice", "k", "g", "s", "before")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_no, doc_id, text, lang): a source is a document, its rows are the pages."""
    return numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "text", "lang"), "doc", "doc_id")


PAGES = "pg AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, doc_id, text, lang FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text): every document is a chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): every benchmark item, the whole of it, is a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


ASKED = "asked AS (SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark)"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triple_id, chunk_id, subject, predicate, object, confidence): suppliers, nations and regions as a graph."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    one = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("chunk_id"), F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.round(F.least(F.abs("s_acctbal") / 10000, F.lit(1.0)), 4).alias("confidence"))  # nations are 25
    two = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("chunk_id"), F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object"), F.lit(None).cast("double").alias("confidence"))  # regions are 5
    t = one.unionByName(two).select(sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object")).alias("triple_id"), "*")
    return t.repartition(spark.sparkContext.defaultParallelism, "triple_id")  # short rows, each of which meets every query


TRIPLES = """tr0 AS (SELECT 's' || s_suppkey AS chunk_id, s_name AS subject, 'located_in' AS predicate, n_name AS object, round(least(abs(s_acctbal) / 10000, 1.0), 4) AS confidence
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'n' || n_nationkey, n_name, 'part_of', r_name, CAST(NULL AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey),
  tr AS (SELECT substr(sha256(chunk_id || ':' || subject || ':' || predicate || ':' || object), 1, 24) AS triple_id, * FROM tr0)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, doc, page_start, page_end, doc_id, text, lang, source_id, parent_id, ord): every page is a chunk; ten pages have a parent."""
    p = pages(spark, sf_dir)
    first = F.floor((F.col("page_no") - 1) / 10).cast("long") * 10 + 1
    return p.select(
        sha_id(20, F.col("doc"), F.col("page_no"), F.col("page_no"), F.lit("text"), F.lit(0)).alias("chunk_id"), "doc", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "doc_id", "text", "lang",
        F.concat(F.lit("row:"), F.col("doc_id").cast("string")).alias("source_id"), sha_id(20, F.col("doc"), first, first + 9, F.lit("page_summary"), F.lit(0)).alias("parent_id"), F.col("doc_id").alias("ord"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, page_id, doc, page_no, kind, caption, body): a web page is an asset of the document row of its number; of rows that aren't there it has none."""
    w = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("caption"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\n\r]+", " ")).alias("body"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("page_id") % 4 + 1).cast("int"))
    at = pages(spark, sf_dir).select("doc", "page_no", "doc_id")
    return w.join(at, F.col("page_id") == F.col("doc_id")).select(F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("asset_id"), "page_id", "doc", "page_no", kind.alias("kind"), "caption", "body")


KINDS = ("table", "map", "figure", "chart")

PACKAGE = PAGES + """,
  ch AS (SELECT substr(sha256(doc || ':' || page_no || ':' || page_no || ':text:0'), 1, 20) AS chunk_id, doc, page_no AS page_start, page_no AS page_end, doc_id, text, lang, 'row:' || doc_id AS source_id,
         substr(sha256(doc || ':' || ((page_no - 1) // 10 * 10 + 1) || ':' || ((page_no - 1) // 10 * 10 + 10) || ':page_summary:0'), 1, 20) AS parent_id, doc_id AS ord FROM pg),
  ast AS (SELECT 'a' || page_id AS asset_id, page_id, doc, page_no, ['table', 'map', 'figure', 'chart'][page_id % 4 + 1] AS kind, regexp_extract(html, '<title>(.*?)</title>', 1) AS caption,
          trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages JOIN pg ON page_id = doc_id),
  lk AS (SELECT chunk_id, ord, asset_id FROM ch JOIN ast ON doc_id = page_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, ord, asset_id)."""
    a = assets(spark, sf_dir).select("asset_id", "page_id")
    return chunks(spark, sf_dir).select("chunk_id", "ord", "doc_id").join(a, F.col("doc_id") == F.col("page_id")).select("chunk_id", "ord", "asset_id")


def asset_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triple_id, ref, asset_ids, subject, predicate, object): one for each asset; of three, one speaks of a row, one of a parent, one of nothing known but its asset."""
    a = assets(spark, sf_dir)
    at = chunks(spark, sf_dir).select(F.col("doc_id").alias("d"), "source_id", "parent_id")
    ref = F.when(F.col("page_id") % 3 == 0, F.col("source_id")).when(F.col("page_id") % 3 == 1, F.col("parent_id")).otherwise("gone")
    ids = F.when(F.col("page_id") % 6 == 5, F.array().cast("array<string>")).otherwise(F.array("asset_id"))
    return a.join(at, F.col("page_id") == F.col("d")).select(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("triple_id"), ref.alias("ref"), ids.alias("asset_ids"), F.col("caption").alias("subject"), F.lit("shown_in").alias("predicate"), F.col("doc").alias("object"))


ASSET_TRIPLES = """atr AS (SELECT 't' || page_id AS triple_id, CASE page_id % 3 WHEN 0 THEN source_id WHEN 1 THEN parent_id ELSE 'gone' END AS ref, CASE WHEN page_id % 6 = 5 THEN NULL ELSE asset_id END AS asset_id, caption AS subject, 'shown_in' AS predicate, ast.doc AS object
    FROM ast JOIN ch ON page_id = doc_id),
  al AS (SELECT alias, arg_min(chunk_id, (level, a, slot, chunk_id)) AS chunk_id FROM (SELECT chunk_id AS alias, chunk_id, 0 AS level, 0 AS a, 0 AS slot FROM ch UNION ALL SELECT source_id, chunk_id, 1, ord, 0 FROM ch UNION ALL SELECT parent_id, chunk_id, 1, ord, 1 FROM ch) GROUP BY alias),
  rs AS (SELECT triple_id, chunk_id, row_number() OVER (PARTITION BY triple_id ORDER BY a, chunk_id) AS place FROM
    (SELECT triple_id, chunk_id, min(a) AS a FROM (SELECT triple_id, al.chunk_id, -1 AS a FROM atr JOIN al ON ref = alias UNION ALL SELECT triple_id, lk.chunk_id, ord FROM atr JOIN lk USING (asset_id)) GROUP BY ALL))"""
