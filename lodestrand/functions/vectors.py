"""Vectors in whole Arrow batches: hashed vectors of texts, and the best of a corpus for every query by matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import BROADCAST_BYTES, written
from .batches import numbered, slices

DIM = 384
#: Rows of a product, and candidates that a task keeps before it drops those that are too low.
_ROWS, _HELD = 512, 1 << 18


def slots(tokens: pa.Array, dim: int) -> np.ndarray:
    """SHA-256 of each token, as a number, modulo dim. Nothing is remembered: a corpus has ever more distinct tokens."""
    digests = b"".join([hashlib.sha256(t).digest() for t in tokens.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    out = np.zeros(len(tokens), np.uint64)
    for word in np.frombuffer(digests, ">u4").reshape(-1, 8).T:
        out = ((out << np.uint64(32)) + word) % np.uint64(dim)
    return out.astype(np.int64)


def hashed(texts: pa.Array | list[str | None], dim: int = DIM) -> np.ndarray:
    """A row for each text: its white-space separated tokens counted by slot, to length 1; zeros where there is none. Each distinct token is hashed once."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    row, code, words = numbered(pc.utf8_split_whitespace(texts))
    return unit(np.bincount(row * dim + slots(words, dim)[code], minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim))


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def stacked(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers, all of one length, as unit rows; null ones are zeros."""
    vectors = pc.fill_null(vectors, [0.0] * max(pc.max(pc.list_value_length(vectors)).as_py() or 1, 1)) if vectors.null_count else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(vectors), -1)) if len(vectors) else np.zeros((0, 1))


def hashed_vector(text: Column, dim: int = DIM) -> Column:
    """hashed() as a column of array<double>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(hashed(s.tolist(), dim)), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best of each query: by score, then item."""
    found = found.take(pc.sort_indices(found, [("query", "ascending"), ("score", "descending"), ("item_id", "ascending")]))
    q = found["query"].to_numpy()
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return found.filter(pa.array(rank < k))


def search(score_of: Callable[[pa.RecordBatch], np.ndarray], ids_of: Callable[[], pa.Array], k: int, low: float, rows: int = _ROWS):
    """For mapInArrow over a corpus with a column item_id: of one task, its k best rows (query_id, item_id, score) for each query, by score to 9 digits above low, then item. score_of gives the scores of a batch's rows for all queries, whose ids ids_of gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of()
        bar = np.full(len(ids), low)
        held: list[pa.Table] = []
        n = 0
        kind = None
        for batch in batches:
            for b in slices(batch, rows):
                kind = b.schema.field("item_id").type
                score = np.round(score_of(b), 9)
                # equal scores stay: which of them counts is decided by item
                i, j = np.nonzero((score >= bar) & (score > low))
                held.append(pa.table({"query": pa.array(j), "item_id": b.column("item_id").take(pa.array(i)), "score": pa.array(score[i, j])}))
                n += len(i)
                if n > max(_HELD, 2 * k * len(ids)):
                    held = [_best(pa.concat_tables(held).combine_chunks(), k)]
                    n = held[0].num_rows
                    query, s = held[0]["query"].to_numpy(), held[0]["score"].to_numpy()
                    full = np.bincount(query, minlength=len(ids)) >= k
                    least = np.full(len(ids), np.inf)
                    np.minimum.at(least, query, s)
                    bar = np.where(full, np.maximum(least, low), low)
        if kind is not None and n:
            top = _best(pa.concat_tables(held).combine_chunks(), k)
            out = pa.table({"query_id": ids.take(top["query"].combine_chunks()), "item_id": top["item_id"], "score": top["score"]})
            yield from out.combine_chunks().to_batches()

    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, *, text: bool, low: float = 0.0, dim: int = DIM) -> DataFrame:
    """(query_id, item_id, rank, score): for every query the k rows of largest cosine above low, of equal ones (to 9 digits) the smallest item_id.

    corpus(item_id, text or vector), queries(query_id, text or vector). The queries' vectors go to all tasks in blocks of a bounded size; for each block the corpus is read once, every task keeps its k best
    for each query, and only these are shuffled.
    """
    spark = corpus.sparkSession
    column = "text" if text else "vector"
    rows = (lambda b: hashed(b.column("text"), dim)) if text else (lambda b: stacked(b.column("vector")))
    q = written(queries.select("query_id", column).withColumn("__block", F.lit(0)))
    count = q.count()
    size = 8 * (dim if text else (q.agg(F.max(F.size("vector"))).first()[0] or 1))
    blocks = max(1, -(-count * size // BROADCAST_BYTES))
    types = f"query_id {q.schema['query_id'].dataType.simpleString()}, item_id {corpus.schema['item_id'].dataType.simpleString()}, score double"
    out = None
    for i in range(blocks):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", column).toArrow().combine_chunks()  # a block's bytes are bounded
        ids = own["query_id"].combine_chunks() if own.num_rows else pa.array([], own.schema.field("query_id").type)
        if not own.num_rows:
            continue
        block = own.to_batches()[0]
        at = spark.sparkContext.broadcast((ids, rows(block)))

        def score(b: pa.RecordBatch, at=at) -> np.ndarray:
            m, q = rows(b), at.value[1]
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"vectors of {m.shape[1]} numbers against queries of {q.shape[1]}")
            return m @ q.T

        part = corpus.select("item_id", column).mapInArrow(search(score, lambda at=at: at.value[0], k, low), types)
        out = part if out is None else out.unionByName(part)
    return merged(spark.createDataFrame([], types) if out is None else out, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks of search() found for each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "rank", "score")
