"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip one word of a whole text, hashed into 2**bits
coordinates, each of value 1. FTRL-proximal (McMahan et al. 2013) gives each coordinate its own learning rate, and its
L1 term leaves most weights at exactly zero, so the model is a short list of (coordinate, weight), small enough to
broadcast at any size of the corpus.

Defined results: rows of null or empty text, or without a word, have p = 0 and toxic = 0; every row of the input has
one row in the result, null and repeated doc_ids too. Labels that are null are ignored; a doc_id with several labels
counts as toxic if any says so. Without any label of either class the model is empty and nothing is toxic. Other
columns of the input, of whatever name, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import arrow_map, trim


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    #: Labelled rows to fit on, at most: the first by hash of doc_id. Scoring covers every row.
    max_labelled: int = 12_000
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    params: Params

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.params.bits, np.float32)
        w[self.index] = self.weight
        return w


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, document) of the words, pairs and skip-pairs; repeated ones repeat."""
    h, d = vec.words(texts)
    idx, doc = [h], [d]
    for salt, gap in ((2, 1), (3, 2)):
        if len(h) > gap:
            ok = d[:-gap] == d[gap:]
            idx.append(vec.combine([h[:-gap], h[gap:]], salt)[ok])
            doc.append(d[:-gap][ok])
    return (np.concatenate(idx) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(doc)


def ftrl(rows: list[np.ndarray], y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass after another over the rows in the given order. The bias is not under L1."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    if not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    for _ in range(p.epochs):
        for x, t in zip(rows, y):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > p.l1, (np.sign(zx) * p.l1 - zx) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            wb = -zb / ((p.beta + nb**0.5) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - t
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / p.alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / p.alpha * wb
            nb += g * g
    live = np.flatnonzero(np.abs(z) > p.l1)
    w = (np.sign(z[live]) * p.l1 - z[live]) / ((p.beta + np.sqrt(n[live])) / p.alpha + p.l2)
    return live, w.astype(np.float32), float(-zb / ((p.beta + nb**0.5) / p.alpha + p.l2))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fits on the labelled rows, at most p.max_labelled of them. Their features are made where they lie; only those move."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(p.max_labelled)
    used = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(known), "id")  # p.max_labelled bounds it
    bits = p.bits

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        idx, doc = features(b.column("text").to_pylist(), bits)
        key = np.unique((doc << bits) | idx)
        at = np.searchsorted(key >> bits, np.arange(b.num_rows + 1))
        own = (key & ((1 << bits) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), b.column("y"), pa.array([own[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], ["id", "y", "x"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id", "x"], kind="stable")
        live, w, bias = ftrl([np.frombuffer(x, np.int32) for x in pdf["x"]], pdf["y"].to_numpy(), p)
        trim()
        return pd.DataFrame({"i": [live.astype(np.int64).tolist()], "w": [w.astype(float).tolist()], "b": [bias]})

    rows = arrow_map(used, each, "id long, y int, x binary").select("*", F.xxhash64("id").alias("order"), F.lit(0).alias("one"))
    got = rows.groupBy("one").applyInPandas(fit, "i array<long>, w array<double>, b double").collect()
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, p)
    return Model(np.array(got[0]["i"], np.int64), np.array(got[0]["w"], np.float32), got[0]["b"], p)


def scorer(model: Model):
    """texts -> probability of each, 0 where there is no word."""
    bits, state = model.params.bits, {}

    def score(texts: list[str | None]) -> np.ndarray:
        if not len(model.index):
            return np.zeros(len(texts))
        if not state:
            state["w"] = model.dense()
        idx, doc = features(texts, bits)
        some = np.bincount(doc, minlength=len(texts)) > 0
        hit = np.flatnonzero(state["w"][idx])
        key = np.unique((doc[hit] << bits) | idx[hit])
        s = np.bincount(key >> bits, weights=state["w"][key & ((1 << bits) - 1)], minlength=len(texts)) + model.bias
        return np.where(some, 1 / (1 + np.exp(-np.clip(s, -35, 35))), 0.0)

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p, toxic) of every row."""
    score, threshold = scorer(model), model.params.threshold

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        p = score(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p.round(6)), pa.array((p > threshold).astype(np.int32))], ["doc_id", "p", "toxic"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, p double, toxic int")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that toxicity() does not call toxic. Nothing is shuffled."""
    score, threshold, at = scorer(model), model.params.threshold, docs.columns.index("text")

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(score(b.column(at).to_pylist()) <= threshold))

    return arrow_map(docs, each, docs.schema)
