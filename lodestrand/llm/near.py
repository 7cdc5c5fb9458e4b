"""N-gram Jaccard join by vertical partitioning.

Every pair of documents is found whose sets of word n-grams have Jaccard similarity t at least. N-grams are compared as 48-bit
hashes: among D distinct n-grams of a corpus a share of about D / 2**48 has the hash of another, by which an overlap may be counted
too high; nothing else is approximate, and no candidate is capped.

1. Prune. A document can only have a partner if at least t of its n-grams occur in another document. All n-gram hashes
   of all documents are sorted and packed in blocks (a few bytes each) and go by range of the hash to fragments, where
   repeated ones are found; per document their number is summed over the fragments. What stays is exact: no document
   with a partner is lost.
2. Equal sets are joined to one class; classes, not documents, are compared from here on. So a group of thousands of
   copies costs as much as one document.
3. The n-grams of the classes are put in a global order, rare ones first. A pair that reaches t shares one of the first
   size - ceil(t * size) + 1 n-grams of each side: candidates share one of these, and no cap bounds how many there are.
4. Vertical partitioning: the global order is cut into fragments at quantiles, each set into the segments that lie in
   them. Each fragment by itself counts the overlap of every candidate pair; the partial counts are summed per pair.
   Fragments are further divided by bucket of the pair, so that a task's share stays within memory as data grows: a group of
   many pairs is laid out as a square of buckets, by hash of either side.
5. Groups. An n-gram that more than _SHORT sets have among their first ones makes no candidates: the sets connected by such n-grams
   are a group, cut into blocks, and two blocks that share such an n-gram (and each block with itself) are a cell, in which all
   overlaps are counted at once, as a product of matrices. A cell gives a row for each of its sets: how many documents it is linked to
   there, and a set that it is connected to. So m variants of one text cost m * m / 2 multiplications of bits, but never as many rows.
   A pair whose blocks are a cell is no candidate in 3.

Result of near(): one row for each doc_id: doc_id, class_id, the smallest doc_id that it is linked to through any number of pairs (its
own if none), and n_links, the number of other documents of which it has Jaccard similarity t at least. Rows grow with the documents, where pairs written
out would grow with the square of a group's size. near_pairs() gives the pairs of class representatives with their membership.

Defined results: null and empty texts and those without a word have no n-gram and pair with nothing. A text of fewer
than n words has one n-gram, all of it. Rows with a null doc_id are left out. Repeated rows count once; if a doc_id
comes with several texts, each is compared, all belong to one class, and n_links counts each text of others and sums over its own. doc_id is an integer or what
casts to one. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import drop_written, sized, written
from ..operators.components import connected_components
from . import vec
from .common import arrow_map, shards, slices, trim

N, T = 3, 0.6
SEGMENTS = 8
#: N-grams of a block: at least the first, and as many more as keep its share of a fragment at 64, up to the last.
_BLOCK_GRAMS, _SHARE, _BLOCK_LIMIT = 500_000, 64, 8_000_000
_BLOCK_DOCS = 1 << 14
#: Candidate n-grams of one bucket of one fragment that a task takes, about.
_BUCKET_GRAMS = 2_000_000
_DOC_BITS = np.uint64(16)
#: Sets with one n-gram among their first ones that are compared pair by pair; if there are more, they are compared in blocks.
_SHORT = 32
#: N-grams of a block of a group, about, where each set counts as the second number at least; n-grams multiplied at once.
_CELL_GRAMS, _SET_GRAMS, _STRIP = 1 << 20, 512, 512


def squeeze(a: np.ndarray) -> bytes:
    """A sorted or small-valued uint64 array as compressed byte planes."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    raw = planes[:used].tobytes()
    return len(a).to_bytes(8, "little") + bytes([used]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(b: bytes) -> np.ndarray:
    n, used, size = int.from_bytes(b[:8], "little"), b[8], int.from_bytes(b[9:17], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :used] = np.frombuffer(pa.decompress(b[17:], size, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8")


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit gram, document) without repeats, sorted by document."""
    g, d = vec.ngrams(*vec.words(texts), n)
    g >>= np.uint64(16)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        g, d = g[new], d[new]
    return g, d


def _blocks(n: int, fragments: int):
    """Docs to rows (fragment, grams, owners, ids, sizes): a block's share of a fragment; one share carries the block's ids and sizes."""
    width = np.uint64(-(-(1 << 48) // fragments))
    most = min(max(_BLOCK_GRAMS, _SHARE * fragments), _BLOCK_LIMIT)

    def flush(keys: list[np.ndarray], ids: list[np.ndarray], at: int) -> pa.RecordBatch:
        key = np.concatenate(keys)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        doc = np.concatenate(ids)
        owner, gram = key & np.uint64((1 << 16) - 1), key >> _DOC_BITS
        size = np.bincount(owner.astype(np.int64), minlength=len(doc))
        cut = np.searchsorted(gram, np.arange(fragments + 1).astype(np.uint64) * width)
        carrier = int(doc[0]) % fragments
        rows = []
        for f in range(fragments):
            i, j = cut[f], cut[f + 1]
            if i < j or f == carrier:
                own = f == carrier
                rows.append((f, squeeze(deltas(gram[i:j])), squeeze(owner[i:j]), doc.tobytes() if own else None, size.tobytes() if own else None))
        # the block's name is its content's, so that a task run again gives it again
        name = int(vec.mix(np.array([np.bitwise_xor.reduce(vec.mix(doc.astype(np.uint64))), len(doc), key.sum() if len(key) else 0], np.uint64)).sum() >> np.uint64(1))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([name] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["fragment", "block", "grams", "owners", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, at, total = [], [], 0, 0
        for b in slices(batches):
            g, d = vec.ngrams(*vec.words(b.column("text").to_pylist()), n)
            keys.append((g >> np.uint64(16) << _DOC_BITS) | (d + at).astype(np.uint64))
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            at += b.num_rows
            total += len(g)
            if total >= most or at + 512 > _BLOCK_DOCS:
                yield flush(keys, ids, at)
                keys, ids, at, total = [], [], 0, 0
        if at:
            yield flush(keys, ids, at)
        trim()

    return run


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: for each block, how many of each document's grams occur in more than one document."""
    grams, owners, base = [], [], [0]
    for g, o in zip(pdf["grams"], pdf["owners"]):
        grams.append(np.cumsum(unsqueeze(g), dtype=np.uint64))
        own = unsqueeze(o).astype(np.int32)
        owners.append(own + np.int32(base[-1]))
        base.append(base[-1] + (int(own.max()) + 1 if len(own) else 0))
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    del grams, owners
    order = np.argsort(gram)
    gram, owner = gram[order], owner[order]
    del order
    same = np.r_[False, gram[1:] == gram[:-1], False]
    many = same[:-1] | same[1:]
    counts = np.bincount(owner[many[: len(gram)]], minlength=base[-1])
    del gram, owner, same, many
    trim()
    return pd.DataFrame({"block": pdf["block"], "counts": [squeeze(counts[i:j].astype(np.uint64)) for i, j in zip(base, base[1:])], "ids": pdf["ids"], "sizes": pdf["sizes"]})


def _survivors(t: float):
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(np.flatnonzero(pdf["ids"].notna())[0])
        ids, sizes = np.frombuffer(pdf["ids"].iloc[i], np.int64), np.frombuffer(pdf["sizes"].iloc[i], np.int64)
        total = np.zeros(len(ids), np.int64)
        for c in pdf["counts"]:
            c = unsqueeze(c).astype(np.int64)
            total[: len(c)] += c
        return pd.DataFrame({"id": ids[(sizes > 0) & (total >= t * sizes - 1e-9)]})

    return each


def prune(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(id) of the documents that may have a partner: a written table."""
    fragments = shards(docs)
    blocks = docs.mapInArrow(_blocks(n, fragments), "fragment int, block long, grams binary, owners binary, ids binary, sizes binary")
    counts = blocks.groupBy("fragment").applyInPandas(_repeats, "block long, counts binary, ids binary, sizes binary")
    return written(counts.groupBy("block").applyInPandas(_survivors(t), "id long").distinct())


def classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((set, size, grams) of each distinct set, (set, size, id) of each member): two written tables. docs: (id, text)."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        g, d = gram_sets(b.column("text").to_pylist(), n)
        at = np.searchsorted(d, np.arange(b.num_rows + 1))
        # two sums of hashes name a set: 126 bits
        one, two = vec.mix(g + np.uint64(1)), vec.mix(g ^ np.uint64(0x5555555555555555))
        c1, c2 = (np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)] for x in (one, two))
        sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(g.view(np.int64)))
        names = [pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)) for c in (c1, c2)]
        out = pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), *names, sets], ["id", "size", "s1", "s2", "grams"])
        return out.filter(pa.array(np.diff(at) > 0))

    sets = written(arrow_map(docs, each, "id long, size long, s1 long, s2 long, grams array<long>"))
    # a group of copies of any size is met by aggregates only, never by a list of its ids
    keys = sized(written(sets.groupBy("s1", "s2", "size").agg(F.min("id").alias("rep"))).drop("size"), 32)
    reps = written(sets.join(keys, (F.col("id") == F.col("rep")) & (sets.s1 == keys.s1) & (sets.s2 == keys.s2)).select(sets.s1.alias("set"), "size", "grams").dropDuplicates(["set"]))
    members = written(sets.select(F.col("s1").alias("set"), "size", "id").distinct())
    drop_written(sets)
    return reps, members


def _overlaps(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of one fragment: left (set, grams) its segments, right (a, b) its candidate pairs; the partial overlap of each."""
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
    if left.empty or right.empty:
        return empty
    left = left.sort_values("set")
    names = left["set"].to_numpy(np.int64)
    sizes = left["grams"].map(len).to_numpy(np.int64)
    flat = np.concatenate([np.asarray(g, np.int64) for g in left["grams"]])
    _, flat = np.unique(flat, return_inverse=True)
    at = np.r_[0, np.cumsum(sizes)]
    a, b = right["a"].to_numpy(np.int64), right["b"].to_numpy(np.int64)
    ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
    ok = (ia < len(names)) & (ib < len(names))
    ok[ok] &= (names[ia[ok]] == a[ok]) & (names[ib[ok]] == b[ok])
    a, b, ia, ib = a[ok], b[ok], ia[ok], ib[ok]
    out = np.zeros(len(a), np.int64)
    step = max(1, int(1_000_000 / max(1.0, 2 * sizes.mean())))
    for i in range(0, len(a), step):
        parts = []
        for side in (ia[i : i + step], ib[i : i + step]):
            k = sizes[side]
            pair = np.repeat(np.arange(len(side)), k)
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(at[side], k)
            parts.append((pair.astype(np.int64) << 32) | flat[pos])
        key = np.concatenate(parts)
        key.sort()
        twice = key[1:][key[1:] == key[:-1]]
        out[i : i + step] = np.bincount(twice >> 32, minlength=len(ia[i : i + step]))
    some = out > 0
    return pd.DataFrame({"a": a[some], "b": b[some], "n": out[some]})


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks as rows: the names of their sets, sizes and numbers of documents; the n-grams that occur; those of each set, by place among these."""
    rows = []
    for block, part in pdf.groupby("block"):
        part = part.sort_values("set")
        grams, which = np.unique(np.concatenate([np.asarray(p, np.int64) for p in part["places"]]), return_inverse=True)
        lens = part["places"].map(len).to_numpy(np.uint64)
        rows.append((block, *[part[c].to_numpy(np.int64).tobytes() for c in ("set", "size", "own")], *[squeeze(x.astype(np.uint64)) for x in (lens, deltas(grams), which)]))
    return pd.DataFrame(rows, columns=["block", "sets", "sizes", "own", "lens", "grams", "which"])


class _Block:
    """A row of _packed(): its n-grams in order, each with the sets that have it."""

    def __init__(self, row) -> None:
        self.sets, self.sizes, self.own = (np.frombuffer(x, np.int64) for x in (row.sets, row.sizes, row.own))
        self.grams = np.cumsum(unsqueeze(row.grams), dtype=np.uint64)
        which = unsqueeze(row.which).astype(np.int64)
        self.rows = np.repeat(np.arange(len(self.sets)), unsqueeze(row.lens).astype(np.int64))[np.argsort(which, kind="stable")]
        self.count = np.bincount(which, minlength=len(self.grams))

    def having(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in grams, set) of the sets that have these n-grams."""
        k = self.count[grams]
        start = (np.cumsum(self.count) - self.count)[grams]
        return np.repeat(np.arange(len(grams)), k), self.rows[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start, k)]


def _cell_overlaps(a: _Block, b: _Block) -> np.ndarray:
    """The overlap of each set of a with each of b: n-grams of many sets by products of matrices, those of few pair by pair."""
    m, n = len(a.sets), len(b.sets)
    _, ga, gb = np.intersect1d(a.grams, b.grams, assume_unique=True, return_indices=True)
    if a is b:
        ga = gb = ga[a.count[ga] > 1]
    dense = a.count[ga] * b.count[gb] * 128 >= m * n
    out = np.zeros((m, n), np.int32)
    da, db = ga[dense], gb[dense]
    for i in range(0, len(da), _STRIP):
        x, y = np.zeros((m, _STRIP), np.float32), np.zeros((n, _STRIP), np.float32)
        for z, side, grams in ((x, a, da), (y, b, db)):
            g, row = side.having(grams[i : i + _STRIP])
            z[row, g] = 1
        out += (x @ y.T).astype(np.int32)
    g, left = a.having(ga[~dense])
    _, right = b.having(gb[~dense])
    k = b.count[gb[~dense]]
    start, ends = (np.cumsum(k) - k)[g], np.cumsum(k[g])
    i = 0
    while i < len(g):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + max(m * n, 1 << 18))))
        times = k[g[i:j]]
        pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[i:j], times)
        out += np.bincount(np.repeat(left[i:j], times) * n + right[pos], minlength=m * n).reshape(m, n).astype(np.int32)
        i = j
    return out


def _roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links, a row that it is connected to, the same one for all connected; -1 if it has no link."""
    rows = np.full(len(linked), -1)
    cols = rows if same else np.full(linked.shape[1], -1)
    for i in np.flatnonzero(linked.any(axis=1)):
        if rows[i] >= 0:
            continue
        rows[i], now = i, np.array([i])
        while len(now):
            new = np.flatnonzero(linked[now].any(axis=0) & (cols < 0))
            cols[new] = i
            now = new
            if not same:
                now = np.flatnonzero(linked[:, new].any(axis=1) & (rows < 0))
                rows[now] = i
    return rows, cols


def _cell(a: _Block, b: _Block, t: float, pairs: bool) -> pd.DataFrame:
    """Of one cell: (a, b, overlap, size_a, size_b) of its pairs, or (a, b, n): a set with links, a set that it is connected to, its number of linked documents."""
    overlap = _cell_overlaps(a, b)
    linked = np.zeros(overlap.shape, bool)
    na, nb = np.zeros(len(a.sets)), np.zeros(len(b.sets))
    for i in range(0, len(a.sets), 256):
        o = overlap[i : i + 256]
        linked[i : i + 256] = (o > 0) & (o / (a.sizes[i : i + 256, None] + b.sizes[None, :] - o) >= t - 1e-9)
        if a is b:
            k = np.arange(i, min(i + 256, len(a.sets)))
            linked[k, k] = False
        x = linked[i : i + 256].astype(np.float64)
        na[i : i + 256] = x @ b.own
        nb += a.own[i : i + 256] @ x
    if pairs:
        i, j = np.nonzero(np.triu(linked) if a is b else linked)
        x, y = a.sets[i], b.sets[j]
        turn = x > y
        size = np.where(turn, b.sizes[j], a.sizes[i]), np.where(turn, a.sizes[i], b.sizes[j])
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "overlap": overlap[i, j].astype(np.int64), "size_a": size[0], "size_b": size[1]})
    rows, cols = _roots(linked, a is b)
    i, j = np.flatnonzero(rows >= 0), np.flatnonzero(cols >= 0)[: 0 if a is b else None]
    return pd.DataFrame({"a": np.r_[a.sets[i], b.sets[j]], "b": a.sets[np.r_[rows[i], cols[j]]], "n": np.r_[na[i], nb[j]].astype(np.int64)})


def _cells(t: float, pairs: bool):
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (ba, bb), part in pdf.groupby(["ba", "bb"]):
            sides = {row.block: _Block(row) for row in part.itertuples()}
            out.append(_cell(sides[ba], sides[bb], t, pairs))
        trim()
        return pd.concat(out)

    return each


def _groups(heads: DataFrame, own: DataFrame | None, ordered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Of the n-grams that too many sets have among their first ones: they (p); (set, block); blocks; cells (ba, bb): written tables. heads: (set, size, p)."""
    long = written(heads.groupBy("p").agg(F.count("*").alias("c"), F.min("set").alias("m")).where(F.col("c") > _SHORT))
    if not long.head(1):
        return None
    lists = written(heads.join(sized(long, 32), "p").select("p", "c", "m", "set", "size"))
    component = connected_components(lists.select("set", "m").distinct(), "set", "m")
    # in the order of its longest list a group's blocks have few lists in common with others, if it has several parts
    own_list = lists.groupBy("set").agg(F.max(F.struct("c", "p")).alias("longest"), F.greatest(F.max("size"), F.lit(_SET_GRAMS)).alias("w"))
    all_of = Window.partitionBy("component")
    up_to = all_of.orderBy("longest", "w", "set").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = own_list.join(component, F.col("set") == F.col("node")).withColumn("total", F.sum("w").over(all_of)).withColumn("before", F.sum("w").over(up_to) - F.col("w"))
    at = at.withColumn("blocks", F.ceil(F.col("total") / _CELL_GRAMS)).withColumn("part", F.floor(F.col("before") * F.col("blocks") / F.col("total")))
    at = written(at.select("set", "w", (F.col("blocks") > 1).alias("cut"), F.min("set").over(Window.partitionBy("component", "part")).alias("block")))
    bins = max(1, -(-at.agg(F.sum("w")).first()[0] // _CELL_GRAMS))
    of = sized(at, 32)
    docs = of.select("set", "block", "cut").withColumn("own", F.lit(1)) if own is None else own.join(of, "set").select("set", "block", "cut", "own")
    one = F.when(F.col("cut"), F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins)))
    filled = ordered.join(sized(written(docs), 32), "set").select(one.alias("bin"), "block", "set", "size", "own", "places")
    blocks = written(filled.groupBy("bin").applyInPandas(_packed, "block long, sets binary, sizes binary, own binary, lens binary, grams binary, which binary"))
    marks = lists.join(of.where("cut").select("set", "block"), "set").select("p", "block").distinct()
    cross = marks.withColumnRenamed("block", "ba").join(marks.withColumnRenamed("block", "bb"), "p").where("ba < bb").select("ba", "bb").distinct()
    cells = written(cross.union(at.select("block", "block").distinct()))
    drop_written(lists)
    return long.select("p"), at.select("set", "block"), blocks, cells


def class_links(reps: DataFrame, t: float, segments: int = SEGMENTS, own: DataFrame | None = None, pairs: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Two written tables: (a, b, overlap, size_a, size_b) of all pairs of sets with Jaccard t at least, but for those of the cells of groups; and what
    _cell() says of the cells, None if there are no groups. reps: (set, size, grams), own: (set, own), the number of documents of each set."""
    grams = reps.select("set", "size", F.explode("grams").alias("g"))
    df = grams.withColumn("df", F.count("*").over(Window.partitionBy("g"))).where("df > 1")
    # place in the global order: rare first, then by hash
    place = (F.least(F.col("df"), F.lit(32767)) * F.lit(1 << 48) + F.col("g")).cast("long")
    ordered = written(df.groupBy("set", "size").agg(F.array_sort(F.collect_list(place)).alias("places")))
    need = F.ceil(F.col("size") * F.lit(t) - F.lit(1e-9))
    # the n-grams of one set only come first in the order and can't be shared
    head = (F.col("size") - need + 1 - (F.col("size") - F.size("places"))).cast("int")
    heads = ordered.where(head > 0).select("set", "size", F.explode(F.slice("places", F.lit(1), head)).alias("p"))
    groups, counted = _groups(heads, own, ordered), None
    if groups:
        long, at, blocks, cells = groups
        kept = sized(cells, 24)
        key = F.when(F.col("ba") < F.col("bb"), F.xxhash64("ba", "bb")).otherwise(F.pmod(F.xxhash64("ba"), F.lit(max(1, -(-at.count() * _SET_GRAMS // _CELL_GRAMS)))))
        asked = kept.select("ba", "bb", key.alias("key"), F.explode(F.array_distinct(F.array("ba", "bb"))).alias("block"))
        rows = "a long, b long, overlap long, size_a long, size_b long" if pairs else "a long, b long, n long"
        counted = written(blocks.join(asked, "block").groupBy("key").applyInPandas(_cells(t, pairs), rows))
        heads = heads.join(sized(long, 16), "p", "left_anti").join(sized(at, 24), "set", "left")
    else:
        heads = heads.withColumn("block", F.lit(None).cast("long"))
    x = heads.select("p", F.col("set").alias("a"), F.col("size").alias("na"), F.col("block").alias("xa"))
    y = heads.select("p", F.col("set").alias("b"), F.col("size").alias("nb"), F.col("block").alias("xb"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(t) - F.lit(1e-9)
    apart = F.coalesce(F.col("xa") != F.col("xb"), F.lit(True))
    met = x.join(y, "p").where((F.col("a") < F.col("b")) & fits & apart).select("a", "b", "na", "nb", "xa", "xb").distinct()
    if groups:
        met = met.join(kept, (F.least("xa", "xb") == F.col("ba")) & (F.greatest("xa", "xb") == F.col("bb")) & F.col("xa").isNotNull() & F.col("xb").isNotNull(), "left_anti")
    near = written(met.select("a", "b", "na", "nb"))
    out = _verified(near, ordered, t, segments)
    drop_written(ordered, near, *(groups[2:] if groups else ()))
    return out, counted


def _verified(pairs: DataFrame, ordered: DataFrame, t: float, segments: int) -> DataFrame:
    """(a, b, overlap, size_a, size_b) of the candidates with Jaccard t at least, a written table. pairs: (a, b, na, nb), ordered: (set, size, places)."""
    room = _BUCKET_GRAMS * segments
    stats = pairs.agg(F.sum(F.col("na") + F.col("nb")).alias("grams")).first()[0] or 0
    buckets = max(1, -(-stats // room))
    # a pair's label is that of the smallest partner of its a: pairs of one group meet in one bucket, so segments are hardly repeated
    ends = pairs.select(F.col("a").alias("of"), F.least("a", "b").alias("m")).union(pairs.select(F.col("b"), F.least("a", "b")))
    label = ends.groupBy("of").agg(F.min("m").alias("label"))
    labelled = written(pairs.join(label, F.col("a") == F.col("of")).select("a", "b", "label", (F.col("na") + F.col("nb")).alias("load")))
    # labels of more than a bucket's load: at most stats / room of them
    wide = labelled.groupBy("label").agg(F.sum("load").alias("load")).where(F.col("load") > room).select("label", F.ceil(F.sqrt(F.col("load") / room)).alias("k"))
    side = lambda x: F.pmod(F.xxhash64(F.col(x)), F.col("k"))
    bucket = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.xxhash64("label", side("a"), side("b")))
    quantiles = ordered.select(F.explode("places").alias("p")).agg(F.percentile_approx("p", [i / segments for i in range(1, segments)], 1000)).first()[0]
    pivots = [-1, *(quantiles or []), (1 << 63) - 1]

    def segment(lo: int, hi: int):
        return F.filter("places", lambda p: (p > F.lit(lo)) & (p <= F.lit(hi)))

    cut = F.array(*[F.struct(F.lit(i).alias("segment"), segment(lo, hi).alias("grams")) for i, (lo, hi) in enumerate(zip(pivots, pivots[1:]))])
    bucketed = written(labelled.join(sized(written(wide), 24), "label", "left").select("a", "b", bucket.alias("bucket")))
    wanted = bucketed.select("bucket", F.explode(F.array("a", "b")).alias("set")).distinct()
    cells = ordered.join(wanted, "set").select("set", "bucket", F.explode(cut).alias("c")).select("set", "bucket", "c.segment", "c.grams").where(F.size("grams") > 0)
    asked = bucketed.select("a", "b", F.col("bucket").alias("for_bucket"), F.explode(F.array(*[F.lit(i) for i in range(segments)])).alias("for_segment"))
    partial = cells.groupBy("bucket", "segment").cogroup(asked.groupBy("for_bucket", "for_segment")).applyInPandas(_overlaps, "a long, b long, n long")
    summed = partial.groupBy("a", "b").agg(F.sum("n").alias("overlap"))
    jaccard = F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    out = written(summed.join(pairs, ["a", "b"]).where(jaccard >= F.lit(t) - F.lit(1e-9)).select("a", "b", "overlap", F.col("na").alias("size_a"), F.col("nb").alias("size_b")))
    drop_written(labelled, bucketed)
    return out


def found(docs: DataFrame, n: int = N, t: float = T) -> tuple[DataFrame, DataFrame]:
    """(the distinct sets of the documents that may have a partner, the members of each set), both written tables, as of classes()."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text <> ''")
    left = sized(prune(own, n, t), 16)
    reps, members = classes(own.join(left, "id", "left_semi"), n)
    drop_written(left)
    return reps, members


def near_pairs(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_a, doc_b, overlap, size_a, size_b, jaccard): a row for each pair of class representatives, doc_a < doc_b, and one for each other
    member of a class with its representative, the smallest doc_id, at jaccard 1. A member has the pairs of its representative."""
    sets, members = found(docs, n, t)
    pairs, more = class_links(sets, t, pairs=True)
    pairs = (pairs if more is None else pairs.unionByName(more)).withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))
    drop_written(sets)
    reps = written(members.groupBy("set", "size").agg(F.min("id").alias("rep")))
    own = sized(reps.select("set", "rep"), 24)
    between = pairs.join(own.select(F.col("set").alias("a"), F.col("rep").alias("ra")), "a").join(own.select(F.col("set").alias("b"), F.col("rep").alias("rb")), "b").where("ra <> rb")
    pick = lambda x, y, name: F.when(F.col("ra") > F.col("rb"), F.col(y)).otherwise(F.col(x)).alias(name)
    between = between.select(pick("ra", "rb", "doc_a"), pick("rb", "ra", "doc_b"), "overlap", pick("size_a", "size_b", "size_a"), pick("size_b", "size_a", "size_b"), F.round("jaccard", 6).alias("jaccard"))
    within = members.join(own, "set").where("id <> rep").select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"), *[F.col("size").alias(x) for x in ("overlap", "size_a", "size_b")], F.lit(1.0).alias("jaccard"))
    return between.unionByName(within)


def linked(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(id, class_id, n_links) of the documents that have a partner: a written table."""
    reps, members = found(docs, n, t)
    count = written(members.groupBy("set").agg(F.count("*").alias("own")))
    sizes = sized(count, 24)
    pairs, counted = class_links(reps, t, own=count)
    drop_written(reps)
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    each = ends.join(sizes.select(F.col("set").alias("b"), "own"), "b").select("a", "own")
    joined = pairs.select("a", "b")
    if counted is not None:
        each, joined = each.union(counted.select("a", "n")), joined.union(counted.select("a", "b"))
    links = written(each.groupBy(F.col("a").alias("set")).agg(F.sum("own").alias("links")))
    # a doc_id of several texts joins their sets
    several = members.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("m")).where("a <> m").select("id", "a")
    also = members.join(sized(written(several), 24), "id").where("set <> a").select("a", F.col("set").alias("b"))
    groups = sized(connected_components(joined.union(also)), 24)
    at = members.join(groups, F.col("set") == F.col("node"), "left").select("id", "set", F.coalesce("component", "set").alias("group"))
    at = written(at.join(sizes, "set").join(sized(links, 24), "set", "left").select("id", "group", (F.col("own") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    first = sized(written(at.groupBy("group").agg(F.min("id").alias("class_id"))), 24)
    out = written(at.join(first, "group").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links")).where("n_links > 0 or class_id <> id"))
    drop_written(pairs, members, count, links, at, *(() if counted is None else (counted,)))
    return out


def near(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, class_id, n_links) of every doc_id, as described above."""
    got = sized(linked(docs, n, t), 32)
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(got, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """The rows of docs, with all their columns, less those of a group of near copies but its smallest doc_id.

    Groups are the classes of near(). A doc_id stays or goes as a whole; rows without doc_id stay.
    """
    name = "__lodestrand_drop"
    gone = written(linked(docs, n, t).where("class_id <> id").select(F.col("id").alias(name)))
    return docs.join(sized(gone, 16), F.col("doc_id") == F.col(name), "left_anti")
