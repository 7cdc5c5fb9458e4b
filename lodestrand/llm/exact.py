"""Exact dedup over a cuckoo-filter index of live digests.

A digest is the SHA-256 of the text; 64 bits of it are its key. Keys, not texts, are shuffled: each shard of the digest space keeps a cuckoo
filter (Fan et al. 2014; 16-bit fingerprints, buckets of four, one numpy table) over its live digests, and beside it their keys, 8 bytes each. A
key that the filter doesn't hold is certainly new and is inserted. A hit is only a suspicion: the rows behind it are fetched and their texts
compared, bucketed by digest. A filter that overflows is rebuilt at twice the size from the stored keys. Withdrawn
documents are deleted from the filter, so that a later copy counts as new. The number of shards follows the bytes of text.

copies() and dedup_rows() take a whole table at once; apply_changes() keeps an index in the shared folder between changes.

Defined results: the copy with the smallest doc_id stays (null ids last); of rows that are equal in doc_id and text one
stays. Empty texts are copies of each other. A null text is no copy of anything: such rows all stay. doc_id is an integer or what casts
to one where copies() and apply_changes() give it.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import drop_written, sized, written
from .common import shards, trim

SLOTS, KICKS = 4, 500
KEY_BYTES = 16
_CHUNK = 1 << 17
_SPREAD = np.uint64(0x5BD1E995)


class Full(Exception):
    """No place after KICKS moves."""


class CuckooFilter:
    """Fingerprints of 64-bit keys, with insertion and deletion, many at a time. Sizes are powers of two; 0 is a free slot."""

    def __init__(self, buckets: int = 64, table: bytes | None = None) -> None:
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.victims = random.Random(buckets)

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (keys & self.mask).astype(np.int64), mark

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return ((at.astype(np.uint64) ^ (mark.astype(np.uint64) * _SPREAD)) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._at(keys)
        other = self._other(at, mark)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[other] == mark[:, None]).any(1)

    def _place(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks in free slots of their buckets; which of them had none."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else b
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
        used = self.table[b] != 0
        fits = rank < SLOTS - used.sum(1)
        slot = np.take_along_axis(np.argsort(used[fits], axis=1, kind="stable"), rank[fits, None], 1)[:, 0]
        self.table[b[fits], slot] = mark[order[fits]]
        return np.sort(order[~fits])

    def insert(self, keys: np.ndarray) -> None:
        """Each key once for each time that it is given; if there is no room, Full, and some of the keys may be in."""
        at, mark = self._at(keys)
        left = self._place(at, mark)
        at, mark = self._other(at[left], mark[left]), mark[left]
        left = self._place(at, mark)
        if len(left) > int((self.table == 0).sum()):
            raise Full
        for i, m in zip(at[left].tolist(), mark[left].tolist()):
            for _ in range(KICKS):
                k = self.victims.randrange(SLOTS)
                m, self.table[i, k] = int(self.table[i, k]), m
                i = (i ^ (m * int(_SPREAD))) & int(self.mask)
                free = np.flatnonzero(self.table[i] == 0)
                if len(free):
                    self.table[i, free[0]] = m
                    break
            else:
                raise Full

    def delete(self, keys: np.ndarray) -> None:
        """One fingerprint for each key, which must be in."""
        at, mark = self._at(keys)
        for i, j, m in zip(at.tolist(), self._other(at, mark).tolist(), mark.tolist()):
            for b in (i, j):
                own = np.flatnonzero(self.table[b] == m)
                if len(own):
                    self.table[b, own[0]] = 0
                    break


class CuckooIndex:
    """A cuckoo filter and the keys that it holds, which are looked at only to resize it. Both are arrays: 10 to 14 bytes a digest."""

    def __init__(self, buckets: int = 64, table: bytes | None = None, keys: bytes | None = None) -> None:
        self.filter, self.resizes = CuckooFilter(buckets, table), 0
        self.stored = [] if keys is None else [np.frombuffer(keys, np.uint64)]

    def keys(self) -> np.ndarray:
        self.stored = [np.concatenate(self.stored)] if self.stored else [np.zeros(0, np.uint64)]
        return self.stored[0]

    def suspects(self, keys: np.ndarray) -> np.ndarray:
        """Whether the filter holds each key's fingerprint; may be wrong in saying so, never in denying it."""
        return self.filter.has(keys)

    def insert(self, keys: np.ndarray) -> None:
        """Keys of digests that aren't live yet."""
        self.stored.append(keys)
        try:
            self.filter.insert(keys)
        except Full:
            self._resize()

    def _resize(self) -> None:
        size = len(self.filter.table)
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            try:
                self.filter.insert(self.keys())
                return
            except Full:
                continue

    def delete(self, keys: np.ndarray) -> None:
        """Keys of live digests, each as often as it shall go."""
        self.filter.delete(keys)
        own, order = self.keys(), np.argsort(self.keys(), kind="stable")
        drop, n = np.unique(keys, return_counts=True)
        first = np.searchsorted(own[order], drop)
        gone = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.stored = [np.delete(own, order[gone])]


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _key(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7))


def _shard(d: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(d), F.lit(n)).cast("int")


def _chunks(keys: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, how often) of each chunk."""
    flat = keys.to_numpy(np.int64).view(np.uint64)
    for i in range(0, len(flat), _CHUNK):
        yield np.unique(flat[i : i + _CHUNK], return_counts=True)


def _stream(index: CuckooIndex, keys: pd.Series) -> np.ndarray:
    """The keys that the index suspects as they come one after the other, each new one being inserted."""
    found = []
    for k, n in _chunks(keys):
        hit = index.suspects(k)
        found.append(k[hit | (n > 1)])
        index.insert(k[~hit])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def suspects(docs: DataFrame) -> DataFrame:
    """(key) of the texts that the index suspects of having a copy: a written table, small against the corpus. docs: (text, digest)."""
    n = shards(docs)
    keyed = docs.where("digest is not null").select(_key(F.col("digest")).alias("key"), _shard(F.col("digest"), n).alias("shard"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _stream(CuckooIndex(), pdf["key"])
        trim()
        return pd.DataFrame({"key": found.view(np.int64)})

    return written(keyed.groupBy("shard").applyInPandas(each, "key long"))


def dedup_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less those whose text a kept row has.

    The texts of suspected rows alone are shuffled, to be compared with each other, and of each text one row of a task at most; the other rows stay
    where they are.
    """
    name, mark, rank = "__lodestrand_digest", "__lodestrand_key", "__lodestrand_rank"
    seen = sized(suspects(docs.select("text", _digest(F.col("text")).alias("digest"))), KEY_BYTES).select(F.col("key").alias(mark))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(name, _digest(F.col("text"))).withColumn(mark, F.when(F.col(name).isNotNull(), _key(F.col(name))))
    clean = keyed.join(seen, mark, "left_anti").select(own)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy(name, "text").orderBy(F.col("doc_id").asc_nulls_last(), F.to_json(F.struct(F.lit(0).alias("_"), *rest)))
    doubted = keyed.join(seen, mark, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(own)
    return clean.unionByName(doubted)


#: Rows that one element of a written-out count stands for.
_RUN = 1 << 12


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, is_copy) of every row: keep_id is the id that stays for this row's text.

    A text of any number of copies is met by aggregates and by joins with one row for each text, never gathered.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest(F.col("text")).alias("digest")).withColumn("key", F.when(F.col("digest").isNotNull(), _key(F.col("digest"))))
    seen = sized(suspects(own.select("text", "digest")), KEY_BYTES)
    clean = own.join(seen, "key", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).alias("is_copy"))
    doubted = own.join(seen, "key", "left_semi").select("doc_id", "text", "digest")
    first = doubted.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"))
    told = doubted.join(first, ["digest", "text"]).groupBy("digest", "doc_id", "keep_id").agg(F.count("*").alias("n"))
    runs = told.select("doc_id", "keep_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN).cast("long"))).alias("run"))
    each = runs.select("doc_id", "keep_id", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)).alias("k"))
    return clean.unionByName(each.select("doc_id", "keep_id", F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 0), 0).otherwise(1).alias("is_copy")))


@dataclass(frozen=True)
class Index:
    """A written index: the live documents as folders of (shard, key, digest, keep_id, text, change), one for each change, the withdrawn ones as folders of
    (digest, keep_id, upto), and the folder that has each shard's filter as it is now, (shard, buckets, table, keys)."""

    shards: int
    change: int = 0
    content: tuple[DataFrame, ...] = ()
    withdrawn: tuple[DataFrame, ...] = ()
    filters: dict[int, DataFrame] = field(default_factory=dict)

    def live(self, spark) -> DataFrame:
        """(shard, key, digest, keep_id, text, change) of the live documents."""
        if not self.content:
            return spark.createDataFrame([], "shard int, key long, digest binary, keep_id long, text string, change int")
        out = self.content[0]
        for x in self.content[1:]:
            out = out.unionByName(x)
        if not self.withdrawn:
            return out
        dead = self.withdrawn[0]
        for x in self.withdrawn[1:]:
            dead = dead.unionByName(x)
        dead = dead.select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), "upto")
        return out.join(dead, (F.col("digest") == F.col("d")) & F.col("keep_id").eqNullSafe(F.col("k")) & (F.col("change") <= F.col("upto")), "left_anti")

    def filters_of(self, spark, touched: list[int]) -> DataFrame:
        """(shard, buckets, table, keys) of the touched shards."""
        out, folders = None, {}
        for s in touched:
            if s in self.filters:
                folders.setdefault(id(self.filters[s]), (self.filters[s], []))[1].append(s)
        for df, own in folders.values():
            part = df.where(F.col("shard").isin(own))
            out = part if out is None else out.unionByName(part)
        return spark.createDataFrame([], "shard int, buckets int, table binary, keys binary") if out is None else out

    def compact(self, spark) -> "Index":
        """The same index with one folder of content and none of withdrawn documents."""
        return Index(self.shards, self.change, (written(self.live(spark).repartitionByRange("shard").sortWithinPartitions("shard")),), (), self.filters)


def _opened(old: pd.DataFrame) -> CuckooIndex:
    return CuckooIndex() if old.empty else CuckooIndex(int(old["buckets"].iloc[0]), old["table"].iloc[0], old["keys"].iloc[0])


def _probe(old: pd.DataFrame, acts: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the keys to be looked up that the filter suspects, once the withdrawn ones are deleted."""
    index = _opened(old)
    index.delete(acts["key"][acts["act"] == "gone"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"key": _stream(index, acts["key"][acts["act"] == "look"]).view(np.int64)})


def _changed(old: pd.DataFrame, acts: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: its filter after the change."""
    index = _opened(old)
    index.delete(acts["key"][acts["act"] == "gone"].to_numpy(np.int64).view(np.uint64))
    added = acts["key"][acts["act"] == "add"].to_numpy(np.int64).view(np.uint64)
    if len(added):
        index.insert(added)
    shard = int((acts if len(acts) else old)["shard"].iloc[0])
    return pd.DataFrame({"shard": [shard], "buckets": [len(index.filter.table)], "table": [index.filter.table.tobytes()], "keys": [index.keys().tobytes()]})


def apply_changes(index: Index | None, docs: DataFrame, withdrawn: DataFrame | None = None) -> tuple[Index, DataFrame]:
    """(the index after the change, (doc_id, keep_id) of every row of docs): documents come and go without reading the corpus's texts again.

    withdrawn(doc_id): documents to delete,
    before docs are looked up; ids that aren't live, and null ones, change nothing. keep_id is the live document whose text
    a row has, else the smallest doc_id among the rows of docs that have it. Rows of null text keep their own id and aren't indexed.
    Only the filters of shards that the change touches are read and written; content is added, and what goes is listed, without rewriting the rest.
    """
    spark = docs.sparkSession
    index = index or Index(shards(docs))
    n, now = index.shards, index.change + 1
    new = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest(F.col("text")).alias("digest")).withColumns({"shard": _shard(F.col("digest"), n), "key": _key(F.col("digest"))}))
    look = new.where("digest is not null")
    live, dead = index.live(spark), None
    if withdrawn is not None:
        out = withdrawn.select(F.col("doc_id").cast("long").alias("out")).where("out is not null").distinct()
        dead = written(live.select("shard", "key", "digest", "keep_id").join(out, F.col("keep_id") == F.col("out"), "left_semi"))
    gone = dead.select("shard", "key", F.lit("gone").alias("act")) if dead is not None else spark.createDataFrame([], "shard int, key long, act string")
    acts = look.select("shard", "key", F.lit("look").alias("act")).unionByName(gone)
    touched = sorted(r[0] for r in acts.select("shard").distinct().collect())  # at most the shards
    filters = index.filters_of(spark, touched)
    found = sized(written(filters.groupBy("shard").cogroup(acts.groupBy("shard")).applyInPandas(_probe, "key long")), KEY_BYTES)
    after = Index(n, now, index.content, index.withdrawn if dead is None else (*index.withdrawn, dead.select("digest", "keep_id", F.lit(index.change).alias("upto"))), index.filters)
    known = after.live(spark).join(found, "key", "left_semi").select(F.col("digest").alias("d"), F.col("text").alias("same"), "keep_id")
    doubted = look.join(found, "key", "left_semi")
    told = doubted.join(known, (F.col("digest") == F.col("d")) & (F.col("text") == F.col("same")), "left").select("shard", "key", "digest", "text", "doc_id", F.col("keep_id").alias("held"))
    first = doubted.groupBy("digest", "text").agg(F.min("doc_id").alias("least"))
    told = told.join(first, ["digest", "text"]).select("shard", "key", "digest", "text", "doc_id", F.coalesce("held", "least").alias("keep_id"), F.col("held").isNull().alias("fresh"))
    alone = look.join(found, "key", "left_anti").select("shard", "key", "digest", "text", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(True).alias("fresh"))
    rows = written(told.unionByName(alone))
    added = written(rows.where("fresh").groupBy("shard", "key", "digest", "text").agg(F.min("keep_id").alias("keep_id")).withColumn("change", F.lit(now)))
    acts = added.select("shard", "key", F.lit("add").alias("act")).unionByName(gone)
    made = written(filters.groupBy("shard").cogroup(acts.groupBy("shard")).applyInPandas(_changed, "shard int, buckets int, table binary, keys binary"))
    result = rows.select("doc_id", "keep_id").unionByName(new.where("digest is null").select("doc_id", F.col("doc_id").alias("keep_id")))
    drop_written(found)
    return Index(n, now, (*index.content, added), after.withdrawn, index.filters | dict.fromkeys(touched, made)), result
