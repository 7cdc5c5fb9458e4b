"""Packing: sum-of-squares online packing of documents into training windows.

A document is cut into pieces of a whole window as long as one can be filled; the rest, shorter than a window, is placed
online. N(h) counts the windows filled to level h. A piece of s tokens goes to the level (0: a new window) that makes
the sum of N(h)**2 over partly filled windows least (Csirik, Johnson, Kenyon et al.): moving a window from h to h + s
changes it by 2 (N(h + s) - N(h) + 1), and the levels 0 and full don't count. N is the level array; for each level the
open windows are kept in a stack.

Tokens are counted by an expression over the text, by default its runs of non-space characters. The rows are
divided by hash of doc_id into shards of about shard_tokens tokens, each packed by itself in order of a seeded hash, so
only (doc_id, tokens) moves and the number of shards follows the corpus; a shard leaves few windows partly filled.

Result: (shard, window, slot, doc_id, start, tokens): piece [start, start + tokens) of the document's tokens is the slot-th of that window.
Defined results: null and empty texts and those without a token have no piece. A null doc_id is packed like any other; doc_id is an integer or what casts to one.
Repeated rows are packed as often as they occur. Ties between levels go to the fullest, a new window last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written

WINDOW = 2048
SHARD_TOKENS = 4_000_000


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def place(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window of each piece, slot in it, number of windows) for pieces of 1 to window - 1 tokens, in order."""
    level = np.zeros(window + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    filled: list[int] = []
    where, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    big = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # candidates h = window - s (fills it) down to 1, then 0
        top = window - s
        gain = level[s:window] - level[0:top]  # h = 0 .. top - 1, level[0] is always 0
        cost = 2 * gain + 2
        cost[0] -= 1
        cost[1:][level[1:top] == 0] = big
        best, h = (1 - 2 * int(level[top]), top) if level[top] else (big, -1)
        j = len(cost) - 1 - int(cost[::-1].argmin())
        if cost[j] < best:
            h = j
        if h:
            w = open_at[h].pop()
            level[h] -= 1
        else:
            w = len(filled)
            filled.append(0)
        where[i], slot[i] = w, filled[w]
        filled[w] += 1
        if h + s < window:
            open_at[h + s].append(w)
            level[h + s] += 1
    return where, slot, np.int64(len(filled))


def pack(docs: DataFrame, *, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """Packs every row of docs(doc_id, text)."""
    n = count_tokens(F.col("text")) if tokens is None else tokens
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n")).where("n > 0"))
    spread = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "n"], kind="stable", na_position="last")
        n, ids, shard = pdf["n"].to_numpy(np.int64), pdf["doc_id"], int(pdf["shard"].iloc[0])
        full, rest = n // window, n % window
        has = rest > 0
        w, slot, used = place(rest[has], window)
        at = np.repeat(np.arange(len(n)), full)
        whole = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        row = np.r_[at, np.flatnonzero(has)]
        return pd.DataFrame(
            {"shard": shard, "window": np.r_[used + np.arange(len(at)), w], "slot": np.r_[np.zeros(len(at), np.int64), slot], "doc_id": ids.astype("Int64").array[row], "start": np.r_[whole * window, full[has] * window], "tokens": np.r_[np.full(len(at), window), rest[has]]}
        )

    keyed = sizes.select("doc_id", "n", spread.alias("key"), F.pmod(F.xxhash64(spread), F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").applyInPandas(each, "shard long, window long, slot long, doc_id long, start long, tokens long")
