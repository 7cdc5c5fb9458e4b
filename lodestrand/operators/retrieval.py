"""Batch hybrid retrieval: queries x corpus joins for whole tables of queries, never one query at a time.

Hits are (query_id, item_id, rank, score, source). Every ranking has a total order: score rounded to 9 digits, then item_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import BROADCAST_BYTES, repeated, written
from ..functions.batches import counted, slices
from ..functions.text import fusion_family, graph_text, ratio, word_tokens
from ..functions.vectors import merged, nearest, search

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def checked(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df hinted for broadcast if counting finds it small; else to be joined by shuffle. df is computed for the count: for tables of queries, not corpora."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def top_k(scored: DataFrame, k: int, source: str | Column, order: list[Column] | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*(order or [F.round("score", 9).desc(), F.col("item_id")]))
    named = F.lit(source) if isinstance(source, str) else source
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "rank", "score", named.alias("source"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch):
            row, code, tf, words = counted(b.column("text"))
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (words.take(pa.array(code)), pa.array(tf, pa.int64()))]
            dl = np.bincount(row, tf, b.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(dl), *lists], ["item_id", "dl", "tokens", "tfs"])


def postings(chunks: DataFrame) -> DataFrame:
    """(item_id, dl, tokens, tfs): the lexical index, a row for each text with its distinct tokens and how often it has each, a written table.

    A text's tokens are all in one place, so they are counted there, in Arrow batches: the corpus is read once and not shuffled.
    """
    kind = chunks.schema["item_id"].dataType.simpleString()
    return written(chunks.select("item_id", "text").mapInArrow(_counted, f"item_id {kind}, dl int, tokens array<string>, tfs array<long>"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch):
            row, code, tf, words = counted(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), words.take(pa.array(code)), pa.array(tf, pa.int64())], ["item_id", "token", "tf"])


def term_counts(chunks: DataFrame) -> DataFrame:
    """(item_id, token, tf): the lexical index, a row for each token of each item. Counted text by text without a shuffle; only the counts of items that have several texts are added up by one."""
    kind = chunks.schema["item_id"].dataType.simpleString()
    found = lambda df: df.mapInArrow(_rows, f"item_id {kind}, token string, tf long")
    once, more = repeated(chunks.select("item_id", "text"), "item_id")
    return found(once) if more is None else found(once).unionByName(found(more).groupBy("item_id", "token").agg(F.sum("tf").alias("tf")))


def corpus_stats(index: DataFrame) -> DataFrame:
    """The idf that every term has before the floor, with the corpus's numbers: (token, df, raw, n, avgdl). index: postings()."""
    sizes = index.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").cast("double").alias("df"))
    return df.crossJoin(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # sizes: one row


#: Bytes of the weights of a block of queries, as a task has them.
WEIGHT_BYTES = 64 << 20


def bm25_topk(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best texts of every query, as hits, where the score is above 0: Okapi BM25 with an idf floor, not below 0, plus the share of the query's distinct terms that occur.

    index: postings(), queries(query_id, text). Queries go to the tasks in blocks of a bounded size; for each the index is read once and multiplied by the block's weights, and every task keeps its k best for each query, so
    that common words cost a product and not a shuffle. An empty corpus has no hits.
    """
    spark = index.sparkSession
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {index.schema['item_id'].dataType.simpleString()}, score double"
    idf = written(corpus_stats(index))
    floor = idf.agg((F.avg("raw") * EPSILON).alias("floor"), F.first("avgdl").alias("mean"))
    asked = written(queries.select("query_id", F.explode(word_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf")))
    terms = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    known = idf.join(checked(asked.select("token").distinct()), "token").crossJoin(F.broadcast(floor)).select("token", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "mean")  # floor: one row
    weight = written(asked.join(known, "token").join(terms, "query_id").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("w"), (1.0 / F.col("terms")).alias("share"), "mean"))
    pairs, count, mean = weight.agg(F.count("*"), F.count_distinct("query_id"), F.max("mean")).first()
    blocks = max(1, math.ceil(math.sqrt(16 * pairs * count / WEIGHT_BYTES)))
    out = None
    for i in range(blocks if pairs else 0):
        own = weight.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # a block's pairs are bounded
        if not own.num_rows:
            continue
        queried, named = (own[c].combine_chunks().dictionary_encode() for c in ("query_id", "token"))
        at = spark.sparkContext.broadcast((queried.dictionary, named.dictionary, queried.indices.to_numpy(), named.indices.to_numpy(), own["w"].to_numpy(), own["share"].to_numpy()))
        part = index.mapInArrow(search(_bm25_scores(at, mean), lambda at=at: at.value[0], k, 0.0, 128), types)
        out = part if out is None else out.unionByName(part)
    return merged(spark.createDataFrame([], types) if out is None else out, k).withColumn("source", F.lit("bm25"))


def _bm25_scores(at, mean: float):
    """The scores of a batch of the index for a block of queries: (ids, tokens, and for each pair of them which query, which token, weight, share)."""
    made: dict[str, np.ndarray] = {}

    def score(b: pa.RecordBatch) -> np.ndarray:
        ids, vocabulary, q, v, w, share = at.value
        if not made:
            made["w"], made["share"] = np.zeros((len(vocabulary), len(ids))), np.zeros((len(vocabulary), len(ids)))
            made["w"][v, q], made["share"][v, q] = w, share
        tokens = b.column("tokens")
        row = np.repeat(np.arange(b.num_rows), np.diff(tokens.offsets.to_numpy()))
        where = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy()
        hit = where >= 0
        row, where, tf = row[hit], where[hit], b.column("tfs").flatten().to_numpy()[hit].astype(np.float64)
        x, there = np.zeros((b.num_rows, len(vocabulary))), np.zeros((b.num_rows, len(vocabulary)))
        dl = b.column("dl").to_numpy()[row]
        x[row, where] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        there[row, where] = 1.0
        raw = x @ made["w"]
        return np.where(np.isfinite(raw), np.maximum(raw, 0.0), 0.0) + there @ made["share"]

    return score


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, dim: int = 384, source: str = "dense") -> DataFrame:
    """The k chunks of largest cosine of hashed vectors for every query, where above 0: as hits."""
    return nearest(chunks, queries, k, text=True, dim=dim).withColumn("source", F.lit(source))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, source: str = "dense") -> DataFrame:
    """The k vectors of largest cosine for every query, at or above the threshold if one is given: as hits. vectors(item_id, vector), queries(query_id, vector)."""
    low = -2.0 if threshold is None else threshold - 1e-9
    return nearest(vectors, queries, k, text=False, low=low).withColumn("source", F.lit(source))


def graph_scores(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, triple_id, score) where above 0.

    8 if the query is within the triple's text, 1 for each token in common, and for each of its three parts 4 if it is within the query, else 2
    if all its tokens are among the query's.
    """
    parts = [graph_text(F.col(x)) for x in ("subject", "predicate", "object")]
    t = triples.select("triple_id", F.filter(F.array(*parts), lambda p: p != "").alias("parts")).withColumn("hay", F.array_join("parts", " ")).where("hay <> ''")
    q = queries.select("query_id", graph_text(F.col("text")).alias("q")).where("q <> ''").withColumn("qt", F.array_distinct(F.split("q", " ")))
    own = lambda p: F.when(F.contains(F.col("q"), p), 4).when(F.size(F.array_except(F.array_distinct(F.split(p, " ")), F.col("qt"))) == 0, 2).otherwise(0)
    score = F.when(F.contains(F.col("hay"), F.col("q")), 8).otherwise(0) + F.size(F.array_intersect("qt", F.array_distinct(F.split("hay", " ")))) + F.aggregate("parts", F.lit(0), lambda a, p: a + own(p))
    return t.crossJoin(checked(q, 256)).select("query_id", "triple_id", score.cast("double").alias("score")).where("score > 0")


def related_terms(triples: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """(query_id, term, score, rank): terms to widen a query by.

    If the subject occurs in the query, or a token of the query in the subject, the object has 2 points and the predicate 1; the same with subject and object
    changed over; a predicate in the query gives both ends 1.
    """
    q = queries.select("query_id", F.lower("text").alias("q")).withColumn("qt", F.filter(F.split("q", r"\s+"), lambda x: x != ""))
    x = triples.select("subject", "predicate", "object", *[F.lower(c).alias(f"low_{c}") for c in ("subject", "predicate", "object")]).crossJoin(checked(q, 256))
    meets = lambda c: F.contains(F.col("q"), F.col(f"low_{c}")) | F.exists("qt", lambda w: F.contains(F.col(f"low_{c}"), w))
    point = lambda cond, terms: F.when(cond, F.array(*[F.struct(F.col(c).alias("term"), F.lit(n).alias("n")) for c, n in terms]))
    gains = F.array(point(meets("subject"), [("object", 2), ("predicate", 1)]), point(meets("object"), [("subject", 2), ("predicate", 1)]), point(F.contains(F.col("q"), F.col("low_predicate")), [("subject", 1), ("object", 1)]))
    flat = x.select("query_id", F.explode(F.flatten(F.array_compact(gains))).alias("g")).groupBy("query_id", F.col("g.term").alias("term")).agg(F.sum("g.n").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def expand_queries(queries: DataFrame, triples: DataFrame, limit: int = 12) -> DataFrame:
    """queries(query_id, text) with their related terms appended."""
    terms = related_terms(triples, queries, limit).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("more"))
    return queries.join(terms, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def collapse(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """The best hit of each parent, with its evidence: hits on a child count for the parent. parents(child_id, parent_id): of parents in the corpus.

    A hit keeps its rank, which may then be missing in between; evidence is the children, without the parent itself.
    """
    at = hits.join(parents, F.col("item_id") == F.col("child_id"), "left").withColumn("canon", F.coalesce("parent_id", "item_id"))
    best = F.min_by(F.struct("rank", "score"), F.struct("rank", (-F.col("score")).alias("s"), "item_id"))
    out = at.groupBy("query_id", "source", "canon").agg(best.alias("b"), F.array_sort(F.collect_set(F.when(F.col("parent_id").isNotNull(), F.col("item_id")))).alias("evidence"))
    return out.select("query_id", F.col("canon").alias("item_id"), "b.rank", "b.score", "source", "evidence")


def weighted(hits: DataFrame, weights: DataFrame | None) -> DataFrame:
    """hits with their weight: of the source itself, else of its name up to the first colon, else 1. What weighs nothing goes."""
    if weights is None:
        return hits.withColumn("w", F.lit(1.0))
    own = weights.select(F.col("source").alias("s1"), F.col("weight").alias("w1"))
    fam = weights.select(F.col("source").alias("s2"), F.col("weight").alias("w2"))
    return hits.join(F.broadcast(own), F.col("source") == F.col("s1"), "left").join(F.broadcast(fam), fusion_family(F.col("source")) == F.col("s2"), "left").withColumn("w", F.coalesce("w1", "w2", F.lit(1.0))).where("w > 0").drop("s1", "w1", "s2", "w2")  # a row for each source


def fuse(hits: DataFrame, k: int, weights: DataFrame | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal rank fusion: (keys, item_id, rank, score, sources)."""
    x = weighted(hits, weights).groupBy(*keys, "item_id").agg(F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "item_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "item_id", "rank", "score", "sources")


def lexical_rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """By query coverage plus Jaccard of the token sets of query and chunk; ties keep the fused order."""
    q = queries.select("query_id", F.array_distinct(word_tokens(F.col("text"))).alias("qt"))
    # of the chunks, only those that are to be put in order are taken apart
    own = checked(written(fused.select("query_id", "item_id", F.col("rank").alias("before"), "sources")), 256)
    c = chunks.select("item_id", "text").join(own, "item_id").withColumn("ct", F.array_distinct(word_tokens(F.col("text"))))
    both = F.size(F.array_intersect("qt", "ct"))
    x = c.join(q, "query_id")
    x = x.withColumn("score", ratio(both, F.size("qt")) + ratio(both, F.size(F.array_union("qt", "ct"))))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "before")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "rank", "score", F.array_append("sources", F.lit("rerank:lexical")).alias("sources"))


def graph_topk(triples: DataFrame, triple_chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k chunks whose triples fit each query best, a chunk having its best triple's score: as hits. triple_chunks(triple_id, chunk_id)."""
    best = graph_scores(triples, queries).join(triple_chunks, "triple_id").groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.max("score").alias("score"))
    return top_k(best, k, "graph")


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, *, k: int = 10, triples: DataFrame | None = None, triple_chunks: DataFrame | None = None, expand: bool = False, dense: bool = True, bm25: bool = True, graph: bool | None = None,
    parents: DataFrame | None = None, weights: DataFrame | None = None, rerank: bool = False, depth: int | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Hits of every query: (query_id, item_id, rank, score, sources, evidence).

    expand widens the query that dense vectors and BM25 see by related terms of the triples; the graph and the reranker see the one asked. graph defaults to expand. Each source gives three times as many candidates as are asked for, 20 at
    least; with parents they count for these; then they are fused, by weights if given. With rerank the `depth` best (k if not given) are put in order of lexical overlap. index: postings() of the chunks, made here if not given.
    chunks(item_id, text), queries(query_id, text), triples(triple_id, subject, predicate, object), triple_chunks(triple_id, chunk_id), parents(child_id, parent_id).
    """
    graph = expand if graph is None else graph
    pool = max(depth or k, k)
    deep = max(3 * pool, 20)
    wide = written(expand_queries(queries, triples)) if expand and triples is not None else queries
    found = []
    if dense:
        found.append(dense_topk(chunks, wide, deep))
    if bm25:
        found.append(bm25_topk(postings(chunks) if index is None else index, wide, deep))
    if graph and triples is not None and triple_chunks is not None:
        found.append(graph_topk(triples, triple_chunks, queries, deep))
    if not found:
        raise ValueError("a search needs a source")
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    none = F.array().cast(f"array<{chunks.schema['item_id'].dataType.simpleString()}>")
    hits = written(collapse(hits, parents) if parents is not None else hits.withColumn("evidence", none))
    told = hits.groupBy("query_id", "item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    fused = fuse(hits, pool, weights).join(chunks.select("item_id"), "item_id", "left_semi")
    out = lexical_rerank(fused, chunks, queries, k) if rerank else fused.where(F.col("rank") <= k)
    return out.join(told, ["query_id", "item_id"], "left")


def multi_vector_search(records: DataFrame, queries: DataFrame, chunks: DataFrame, *, k: int = 10, condition: Column | None = None, asset_chunks: DataFrame | None = None, more: DataFrame | None = None, parents: DataFrame | None = None, weights: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Hits of several vector spaces and other sources in one ranking: (query_id, item_id, rank, score, sources, evidence).

    records(vector_name, target_id, item_id, asset_id, vector, and what condition reads), queries(query_id, vector_name, vector): each space is searched by its own queries among the records that fulfil the condition, and is a source
    named vector:<name>. A record of an asset counts for the chunk in asset_chunks(asset_id, chunk_id), if there is one. more: hits of BM25 or the graph, of which those in chunks(item_id) count. Several hits of one
    item in a source add up, unless parents collapse them.
    """
    pool = max(depth or k, k)
    deep = max(3 * pool, 20)
    names = sorted(r[0] for r in queries.select("vector_name").distinct().collect())  # vector spaces are few
    hits = more.join(chunks.select("item_id"), "item_id", "left_semi").select("query_id", "item_id", "rank", "score", "source") if more is not None else None
    for name in names:
        own = records.where(F.col("vector_name") == name)
        own = own if condition is None else own.where(condition)
        got = nearest(own.select(F.col("target_id").alias("item_id"), "vector"), queries.where(F.col("vector_name") == name).select("query_id", "vector"), deep, text=False, low=-2.0)
        at = got.withColumnRenamed("item_id", "target_id").join(own.select("target_id", F.col("item_id").alias("own"), "asset_id"), "target_id")
        if asset_chunks is not None:
            at = at.join(asset_chunks.select("asset_id", "chunk_id"), "asset_id", "left").withColumn("own", F.coalesce("chunk_id", "own"))
        part = at.select("query_id", F.col("own").alias("item_id"), "rank", "score", F.lit(f"vector:{name}").alias("source"))
        hits = part if hits is None else hits.unionByName(part)
    none = F.array().cast(f"array<{hits.schema['item_id'].dataType.simpleString()}>")
    hits = written(collapse(hits, parents) if parents is not None else hits.withColumn("evidence", none))
    told = hits.groupBy("query_id", "item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return fuse(hits, pool, weights).where(F.col("rank") <= k).join(told, ["query_id", "item_id"], "left")


def route_queries(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """(query_id, route): the first route, by ord, one of whose terms is in the query; 'default' where none is. routes(route, ord, term)."""
    hit = queries.join(F.broadcast(routes), F.contains(F.lower("text"), F.lower("term")), "left")  # routes are configuration
    return hit.groupBy("query_id").agg(F.coalesce(F.min_by("route", "ord"), F.lit("default")).alias("route"))
