"""Language identification: word-first backoff.

Training counts, for each language, its words and the character n-grams (1 to max_n) of its words. A text is scored word
by word: a known word by its per-language log frequency; an unseen word by its character n-grams of max_n characters,
and if the model knows none of these, by those of one character less, and so on down to single characters. A word that
has none either counts for nothing. The language of the largest mean score per word wins.

Defined results: every row of the input has one row in the result. Null or empty texts, and texts that have no word that
can be scored, get lang 'und' and margin 0. Ties go to the language first in alphabetical order. Rows whose label is
null or empty take no part in training. doc_id is an integer or what casts to one. Without any labelled row every text is 'und'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import sized, written
from . import vec
from .common import arrow_map


@dataclass(frozen=True)
class Params:
    max_n: int = 4
    #: Labelled texts to fit on in each language, at most: the first by hash of doc_id.
    max_labelled: int = 2_000
    #: Every word and n-gram that occurs so often, over all languages, is kept.
    min_count: int = 3
    #: Added to each count before the logarithm.
    smooth: float = 0.5


WORD = 0
#: Of the hash by which labelled rows are chosen.
_SLICE_BITS = 12


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: Hashes of the known words (kind 0) and n-grams (kind n), ascending; the n-th row of score has their log frequencies.
    keys: np.ndarray
    score: np.ndarray
    params: Params


def gram_keys(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    return vec.mix(vec.span(prefix, start, end) + np.uint64(n))


def word_grams(s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, word) of every n-gram of the words that have n characters."""
    k = np.maximum(e - s - n + 1, 0)
    word = np.repeat(np.arange(len(s)), k)
    first = np.repeat(np.cumsum(k) - k, k)
    return s[word] + np.arange(len(word)) - first, word


def count(texts: list[str | None], max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, key, count) of the texts' words and n-grams."""
    kinds, keys = [], []
    for text, _, _ in vec.pieces(texts):
        cp = vec.points(text)
        s, e = vec.word_bounds(cp)
        p = vec.prefix_hash(cp)
        for n in range(max_n + 1):
            a, b = (s, e) if n == WORD else (lambda x: (x, x + n))(word_grams(s, e, n)[0])
            kinds.append(np.full(len(a), n, np.int8))
            keys.append(gram_keys(p, a, b, n))
    if not keys:
        return np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind, key = np.concatenate(kinds), np.concatenate(keys)
    key, at, n = np.unique(key, return_index=True, return_counts=True)
    return kind[at], key, n


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Fits on docs(doc_id, text, lang), at most p.max_labelled texts of each language."""
    known = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).where("id is not null and l <> ''")
    known = known.select("id", "l", F.xxhash64("id").alias("h")).withColumn("slice", F.shiftright("h", 64 - _SLICE_BITS))
    # the slices of the hash in which a language's first max_labelled rows lie; only the last of them has rows to be left out
    counts = known.groupBy("l", "slice").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("l").orderBy("slice")) - F.col("n"))
    cuts = written(counts.where(F.col("before") < p.max_labelled))
    langs = sorted(r[0] for r in cuts.select("l").distinct().collect())
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), p)
    own = known.join(sized(cuts, 64), ["l", "slice"])
    last = own.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("l", "slice").orderBy("h", "id")))
    chosen = last.where(F.col("k") <= p.max_labelled).select("id", "l").distinct()
    text = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "text").where("text is not null").join(F.broadcast(chosen), ["id", "l"])  # p.max_labelled bounds it

    def each(pdfs):
        for pdf in pdfs:
            for lang, own in pdf.groupby("l"):
                kind, key, n = count(own["text"].tolist(), p.max_n)
                yield pd.DataFrame({"l": lang, "kind": kind.astype(np.int32), "key": key.view(np.int64), "n": n})

    counts = text.select("l", "text").mapInPandas(each, "l string, kind int, key long, n long").groupBy("l", "kind", "key").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("kind", "key").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]).where(F.col("all") >= p.min_count)
    top = wide.select("kind", "key", *[f"n{i}" for i in range(len(langs))]).toArrow()  # p.max_labelled bounds it
    kinds, keys = top["kind"].to_numpy(), top["key"].to_numpy().view(np.uint64)
    table = np.stack([top[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)
    score = np.zeros_like(table)
    for kind in range(p.max_n + 1):  # a distribution of its own for each kind
        own = kinds == kind
        if own.any():
            x = table[own] + p.smooth
            score[own] = np.log(x / x.sum(axis=0))
    order = np.argsort(keys)
    return Model(langs, keys[order], score[order].astype(np.float32), p)


def scorer(model: Model):
    """texts -> (index of the language or -1, margin of its mean score over the next)."""
    k, max_n = len(model.langs), model.params.max_n

    def find(keys: np.ndarray) -> np.ndarray:
        """Row of each key in the model, or -1."""
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        return np.where(model.keys[at] == keys, at, -1)

    def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(texts)
        if not k or not len(model.keys):
            return np.full(n_docs, -1), np.zeros(n_docs)
        total, words = np.zeros((n_docs, k)), np.zeros(n_docs)
        for text, starts, docs in vec.pieces(texts):
            cp = vec.points(text)
            s, e = vec.word_bounds(cp)
            if not len(s):
                continue
            doc = docs[np.searchsorted(starts, s, "right") - 1]
            p = vec.prefix_hash(cp)
            row = find(gram_keys(p, s, e, WORD))
            hit = row >= 0
            for i in range(k):
                total[:, i] += np.bincount(doc[hit], weights=model.score[row[hit], i], minlength=n_docs)
            words += np.bincount(doc[hit], minlength=n_docs)
            left = np.flatnonzero(~hit)
            for n in range(max_n, 0, -1):
                if not len(left):
                    break
                at, word = word_grams(s[left], e[left], n)
                row = find(gram_keys(p, at, at + n, n))
                hit = row >= 0
                word, row = word[hit], row[hit]
                found = np.bincount(word, minlength=len(left))
                own = doc[left]
                share = 1.0 / found[word]  # the mean over the word's known n-grams
                for i in range(k):
                    total[:, i] += np.bincount(own[word], weights=model.score[row, i] * share, minlength=n_docs)
                words += np.bincount(own[found > 0], minlength=n_docs)
                left = left[found == 0]
        mean = total / np.maximum(words, 1)[:, None]
        best = np.where(words > 0, mean.argmax(axis=1), -1)
        if k > 1:
            two = np.sort(mean, axis=1)[:, -2:]
            margin = np.where(words > 0, two[:, 1] - two[:, 0], 0.0)
        else:
            margin = np.zeros(n_docs)
        return best, margin

    return score


def language(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, margin) of every row of docs(doc_id, text)."""
    score, names = scorer(model), np.array([*model.langs, "und"], object)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        best, margin = score(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(margin.round(6))], ["doc_id", "lang", "margin"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, lang string, margin double")
