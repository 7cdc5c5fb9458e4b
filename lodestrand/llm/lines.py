"""Line dedup with two Bloom filters.

Of all lines of all documents that are equal but for blanks at their ends, the first stays: the one with the smallest doc_id, then
line number. Blank lines always stay.

1. 64-bit hashes of the lines, not the lines, go by range of the hash to shards, packed to a few bytes each with the line's
   place in its block of documents. Each shard streams its hashes through two Bloom filters: what the once-seen filter already
   holds goes into the twice-seen one. The number of shards follows the bytes of text.
2. The twice-seen filter is probed where it lies, in its shard: neither filters nor hashes ever meet on one machine, and
   nothing is broadcast. The places of suspected repeats go back to their blocks, which name documents and line numbers.
   A line that the filter doesn't hold is certainly unique and isn't moved.
3. Suspected repeats are shuffled as text: an aggregate finds the first occurrence of each and exact equality decides,
   so false positives of the filters change nothing. Its partial aggregation takes the skew of a line in millions of
   documents.
4. The numbers of the lines that stay come back to their documents, and the text is cut in the JVM. Steps 3 and 4 meet the
   documents by the same key, so these are shuffled once and read twice.

Defined results: one row for each row of the input, null and empty texts unchanged with 0 lines removed. Rows equal in doc_id and text
count as one document and are cut alike. Null ids come last in order. A document may become empty or keep only blank
lines. doc_id is an integer or what casts to one. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from .common import shards, slices, trim
from .near import deltas, squeeze, unsqueeze

BLANKS = " \t\r"
HASHES = 4
BITS_PER_LINE = 16
#: Lines and documents of a block: at least the first, more where there are many shards.
_BLOCK, _BLOCK_DOCS, _SHARE, _BLOCK_LIMIT = 1_000_000, 1 << 17, 64, 8_000_000
_CHUNK = 1 << 18


def line_hashes(text: str | None) -> list[int]:
    """Hash of each line, 0 for blank ones."""
    h = xxhash.xxh3_64_intdigest
    return [h(x.encode("utf-8", "surrogatepass")) | 1 if (x := line.strip(BLANKS)) else 0 for line in text.split("\n")] if text else []


def positions(h: np.ndarray, mask: np.ndarray | int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(20)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) & np.asarray(mask, np.uint64)


class Bloom:
    """A Bloom filter over 64-bit hashes, of a power of two of bits."""

    def __init__(self, expected: int) -> None:
        self.size = 1 << max(10, int(expected * BITS_PER_LINE - 1).bit_length())
        self.bits = np.zeros(self.size >> 3, np.uint8)

    def add(self, h: np.ndarray) -> None:
        for p in positions(h, self.size - 1):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in positions(h, self.size - 1):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def once_twice(chunks: Iterator[np.ndarray], expected: int) -> Bloom:
    """The twice-seen filter after all chunks went through both."""
    once, twice = Bloom(expected), Bloom(expected)
    for h in chunks:
        h, n = np.unique(h, return_counts=True)
        twice.add(h[(n > 1) | once.has(h)])
        once.add(h)
    return twice


def _pack(shards: int):
    """Docs (h1, h2, text) to rows (shard, block, hashes, places, docs, lines): a block's share of a shard; one share carries its documents and how many lines each has."""
    width = np.uint64(-(-(1 << 64) // shards))
    most = min(max(_BLOCK, _SHARE * shards), _BLOCK_LIMIT)

    def flush(parts: list[int], keys: list[np.ndarray], counts: list[int]) -> pa.RecordBatch:
        h = np.array(parts, np.uint64)
        place = np.flatnonzero(h).astype(np.uint64)
        h = h[place.astype(np.int64)]
        order = np.argsort(h)
        h, place = h[order], place[order]
        cut = np.r_[0, np.searchsorted(h, np.arange(1, shards).astype(np.uint64) * width), len(h)]
        docs = np.concatenate(keys)
        # the block's name is its content's, so that a task run again gives it again
        name = xxhash.xxh3_64_intdigest(docs.tobytes()) >> 1
        carrier = name % shards
        rows = []
        for i in range(shards):
            a, b = cut[i], cut[i + 1]
            own = i == carrier
            if a < b or own:
                rows.append((i, squeeze(deltas(h[a:b])), squeeze(place[a:b]), docs.tobytes() if own else None, squeeze(np.array(counts, np.uint64)) if own else None))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([name] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["shard", "block", "hashes", "places", "docs", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[int] = []
        keys: list[np.ndarray] = []
        counts: list[int] = []
        for b in slices(batches):
            keys.append(np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in ("h1", "h2")], 1))
            for t in b.column("text").to_pylist():
                own = line_hashes(t)
                parts += own
                counts.append(len(own))
            if len(parts) >= most or len(counts) >= _BLOCK_DOCS:
                yield flush(parts, keys, counts)
                parts, keys, counts = [], [], []
        if counts:
            yield flush(parts, keys, counts)
        trim()

    return run


def _probe(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: for each block, the places of the lines that the shard's twice-seen filter holds."""
    n = sum(int.from_bytes(b[:8], "little") for b in pdf["hashes"])

    def chunks() -> Iterator[np.ndarray]:
        parts, size = [], 0
        for b in pdf["hashes"]:
            h = np.cumsum(unsqueeze(b), dtype=np.uint64)
            for i in range(0, len(h), _CHUNK):
                parts.append(h[i : i + _CHUNK])
                size += len(parts[-1])
                if size >= _CHUNK:
                    yield np.concatenate(parts)
                    parts, size = [], 0
        if size:
            yield np.concatenate(parts)

    twice = once_twice(chunks(), n)
    hits = [unsqueeze(p)[twice.has(np.cumsum(unsqueeze(b), dtype=np.uint64))] for b, p in zip(pdf["hashes"], pdf["places"])]
    some = [i for i, x in enumerate(hits) if len(x) or pdf["docs"].iloc[i] is not None]
    trim()
    return pd.DataFrame({"block": pdf["block"].iloc[some], "places": [squeeze(hits[i]) for i in some], "docs": pdf["docs"].iloc[some], "lines": pdf["lines"].iloc[some]})


def _named(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the documents that have suspected lines, and their numbers, ascending. The same block may have come several times, with the same content."""
    i = next(k for k, x in enumerate(pdf["docs"]) if x is not None)
    docs, end = np.frombuffer(pdf["docs"].iloc[i], np.int64).reshape(-1, 2), np.cumsum(unsqueeze(pdf["lines"].iloc[i]).astype(np.int64))
    at = np.unique(np.concatenate([unsqueeze(p) for p in pdf["places"]]).astype(np.int64))
    doc = np.searchsorted(end, at, "right")
    no = at - np.r_[0, end][doc]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
    own = docs[doc[first]]
    return pd.DataFrame({"h1": own[:, 0], "h2": own[:, 1], "nos": pd.Series([x.tolist() for x in np.split(no, first[1:])] if len(doc) else [], dtype=object)})


def suspected(docs: DataFrame) -> DataFrame:
    """(h1, h2, nos): the numbers of the lines that the twice-seen filters hold, a row for each document that has any, a written table. docs: (h1, h2, text)."""
    packed = docs.select("h1", "h2", "text").where("text <> ''").mapInArrow(_pack(shards(docs)), "shard int, block long, hashes binary, places binary, docs binary, lines binary")
    hits = packed.groupBy("shard").applyInPandas(_probe, "block long, places binary, docs binary, lines binary")
    return written(hits.groupBy("block").applyInPandas(_named, "h1 long, h2 long, nos array<int>").dropDuplicates(["h1", "h2"]))


def _flags(nos: Column) -> Column:
    """True at the numbers (ascending), false between: read along with the lines, so a line costs the same in a text of any length."""
    before = F.concat(F.array(F.lit(-1)), F.slice(nos, F.lit(1), F.greatest(F.size(nos) - 1, F.lit(0))))
    return F.flatten(F.zip_with(nos, before, lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed) of every row of docs(doc_id, text): its text without repeated lines and how many went."""
    ident = F.col("doc_id").cast("long")
    own = docs.select(ident.alias("id"), "text", F.xxhash64(ident, "text").alias("h1"), F.xxhash64("text", F.lit(29), ident).alias("h2"))
    seen = suspected(own)
    marked = F.arrays_zip(F.split("text", "\n").alias("line"), _flags(F.col("nos")).alias("flag"))
    lines = F.filter(F.transform(marked, lambda z, i: F.when(z["flag"], F.struct(i.alias("no"), F.btrim(z["line"], F.lit(BLANKS)).alias("line")))), lambda x: x.isNotNull())
    held = own.join(seen.hint("shuffle_hash"), ["h1", "h2"]).select("id", "h1", "h2", F.explode(lines).alias("x"))
    # the first occurrence of each suspected line stays, whether or not it has others
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2", F.col("x.no").alias("no"))
    first = held.groupBy(F.col("x.line").alias("line")).agg(F.min(place).alias("p")).select("p.h1", "p.h2", "p.no")
    stay = first.groupBy("h1", "h2").agg(F.collect_set("no").alias("stay"))  # of one document
    at = own.join(seen.hint("shuffle_hash"), ["h1", "h2"], "left").join(stay.hint("shuffle_hash"), ["h1", "h2"], "left")
    gone = F.array_except("nos", F.coalesce("stay", F.array().cast("array<int>")))
    parts = F.arrays_zip(F.split("text", "\n").alias("line"), _flags(gone).alias("flag"))
    cut = F.transform(F.filter(parts, lambda z: ~F.coalesce(z["flag"], F.lit(False))), lambda z: z["line"])
    none = F.col("nos").isNull() | (F.size(gone) == 0)
    return at.select(F.col("id").alias("doc_id"), F.when(none, F.col("text")).otherwise(F.array_join(cut, "\n")).alias("text"), F.when(none, 0).otherwise(F.size(gone)).alias("removed"))
