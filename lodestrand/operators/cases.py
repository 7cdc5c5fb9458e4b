"""Generation of retrieval cases from a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import repeated, written
from ..functions.batches import slices
from ..functions.text import meaningful_text, question, ratio, trim_query

TERM = r"[A-Za-z][\w./%+-]{2,}|[0-9]+(?:[.,][0-9]+)*[%A-Za-z가-힣㎡²³]*|[가-힣]{2,}|[一-鿿]{2,}"
#: Words that name parts of a document, or say what any text says.
STOP = tuple("page above about range table belong report figure belongs chapter defines example section summary overview includes contents document appendix reference introduction 개요 그림 목차 본문 부록 요약 자료 참고 보고서 페이지".split())
MAX_CHARS = 120
#: TERM in Python, where \w would be more than ASCII.
_TERM = re.compile(TERM.replace(r"\w", "A-Za-z0-9_")).findall


def term_keys(text: Column) -> Column:
    """array<struct<term, key>> of a text's terms in order: punctuation off the ends; key is what terms are told apart by, empty for stop words, identifiers and numbers other than of four digits."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    terms = F.transform(found, lambda x: F.regexp_replace(x, r"^[.,;:!?/\\+-]+|[.,;:!?/\\+-]+$", ""))

    def key(x: Column) -> Column:
        k = F.lower(x)
        hexa = k.rlike("^[0-9a-f]{2,}$") & k.rlike("[0-9]") & k.rlike("[a-f]")
        long = (F.length(k) >= 12) & k.rlike("[0-9]")
        number = k.rlike("^[0-9]+$") & (F.length(k) != 4)
        return F.when((F.length(k) < 2) | k.isin(*STOP) | hexa | long | number, "").otherwise(k)

    return F.filter(F.transform(terms, lambda x: F.struct(x.alias("term"), key(x).alias("key"))), lambda t: t["key"] != "")


def salient_terms(text: Column) -> Column:
    """The distinct keys of a text's terms, in order of their first place."""
    return F.array_distinct(F.transform(term_keys(text), lambda t: t["key"]))


def term_score(key: Column, df: Column, docs: Column) -> Column:
    """Rare and long terms score high, numbers less."""
    return (F.log((docs + 1) / F.greatest(df, F.lit(1))) + 1) * F.least(F.length(key), F.lit(16)) / 8.0 * F.when(key.rlike("^[.,]*[0-9][0-9.,]*$"), 0.75).otherwise(1.0)


def _found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(row, pos, code, terms, keys): of each text the distinct keys of term_keys() in order of their first place, pos being that place; terms and keys by code, of which several may have one key. The rules are applied once to each distinct term."""
    found = [_TERM(t or "") for t in texts.to_pylist()]
    flat = pa.array([x for own in found for x in own], pa.string()).dictionary_encode()
    row, code = np.repeat(np.arange(len(found)), [len(own) for own in found]), flat.indices.to_numpy().astype(np.int64)
    terms = pc.utf8_trim(flat.dictionary, characters=".,;:!?/\\+-")
    keys = pc.ascii_lower(terms)  # no other letters of terms have case
    is_ = lambda p: pc.match_substring_regex(keys, p).to_numpy(zero_copy_only=False)
    length = pc.utf8_length(keys).to_numpy(zero_copy_only=False)
    digit, number = is_("[0-9]"), is_("^[0-9]+$")
    bad = (length < 2) | pc.is_in(keys, value_set=pa.array(STOP)).to_numpy(zero_copy_only=False) | (is_("^[0-9a-f]{2,}$") & digit & is_("[a-f]")) | ((length >= 12) & digit) | (number & (length != 4))
    kept = ~bad[code]
    row, code = row[kept], code[kept]
    start = np.cumsum(np.bincount(row, minlength=len(found))) - np.bincount(row, minlength=len(found))
    same = keys.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first = np.unique(row * max(len(keys), 1) + same[code], return_index=True)
    first = np.sort(first)
    return row[first], first - start[row[first]], code[first], terms, keys


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item_id, text): (item_id, terms, places, full), full being 1 unless the text is empty."""
    for batch in batches:
        for b in slices(batch):
            row, pos, code, terms, _ = _found(b.column("text"))
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(code)), pa.array(pos, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), *lists, pc.fill_null(pc.not_equal(b.column("text"), ""), False).cast(pa.int32())], ["item_id", "terms", "places", "full"])


def _lists(docs: DataFrame) -> DataFrame:
    """(item_id, terms, full): each item's distinct terms in order of their first place, as arrays, and how many of its texts aren't empty. docs(item_id, text): an item of several texts has the terms of all."""
    kind = docs.schema["item_id"].dataType.simpleString()
    found = lambda df: df.mapInArrow(_listed, f"item_id {kind}, terms array<string>, places array<int>, full int")
    once, more = repeated(docs.select("item_id", "text"), "item_id")
    out = found(once).select("item_id", "terms", F.col("full").cast("long").alias("full"))
    if more is None:
        return out
    more = written(found(more))
    each = more.select("item_id", F.explode(F.arrays_zip("places", "terms")).alias("t"))
    first = each.groupBy("item_id", F.lower("t.terms").alias("key")).agg(F.min(F.struct("t.places", "t.terms")).alias("t")).groupBy("item_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    full = more.groupBy(F.col("item_id").alias("own_id")).agg(F.sum("full").alias("full"))
    merged = full.join(first, F.col("item_id").eqNullSafe(F.col("own_id")), "left")
    return out.unionByName(merged.select(F.col("own_id").alias("item_id"), F.coalesce("t.terms", F.array().cast("array<string>")).alias("terms"), "full"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("item_id", meaningful_text(F.col("text")).alias("text"))


def _frequency(lists: DataFrame) -> DataFrame:
    """(key, df): in how many items each key is."""
    return lists.select(F.explode("terms").alias("key")).groupBy(F.lower("key").alias("key")).agg(F.count("*").alias("df"))


def scored_terms(docs: DataFrame) -> DataFrame:
    """(item_id, term, key, pos, score) of every distinct term of every document, pos its place among these. docs(item_id, text)."""
    lists = written(_lists(_texts(docs)))
    n = lists.agg(F.sum("full").cast("double").alias("docs"))
    terms = lists.select("item_id", F.posexplode("terms").alias("pos", "term")).withColumn("key", F.lower("term"))
    df = _frequency(lists).crossJoin(F.broadcast(n))  # one row
    return terms.join(df.select("key", F.round(term_score(F.col("key"), F.col("df"), F.col("docs")), 9).alias("score")), "key").select("item_id", "term", "key", "pos", "score")


#: Bytes of the frequent keys that every task has.
_COMMON_BYTES = 8 << 20


def selected_terms(docs: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """(item_id, terms, score): chosen_terms(scored_terms(docs)), where a row is an item and not a term.

    The most frequent keys and their numbers go to all tasks, as many as fit; only terms of other keys that may be in two items or more are rows, to be joined with their numbers.
    """
    spark = docs.sparkSession
    kind = docs.schema["item_id"].dataType.simpleString()
    lists = written(_lists(_texts(docs)))
    n = float(lists.agg(F.sum("full")).first()[0] or 0)
    df = written(_frequency(lists).where("df > 1"))  # what isn't there is in one item
    sizes = df.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).agg(F.sum(F.octet_length("key") + 12).alias("bytes")).orderBy(F.desc("df")).collect()  # a row for each number
    held, low = 0, (1 << 16) + 1
    for r in sizes:
        held += r["bytes"]
        if held > _COMMON_BYTES:
            break
        low = r["df"]
    whole = not sizes or low == sizes[-1]["df"]
    own = df.where(F.col("df") >= low).toArrow().combine_chunks()  # bounded: of equal numbers all or none
    common = spark.sparkContext.broadcast((own["key"].combine_chunks() if own.num_rows else pa.array([], pa.string()), own["df"].to_numpy()))
    known = F.lit(None).cast("array<struct<place:int,df:bigint>>")
    if whole:
        lists = lists.withColumn("known", known)
    else:
        rare = lists.mapInArrow(_rare(common), f"item_id {kind}, place int, key string").join(df.where(F.col("df") < low), "key")
        lists = _with(lists, rare)
    return lists.mapInArrow(_selected(common, n, most, least), f"item_id {kind}, terms array<string>, score double")


def _with(lists: DataFrame, rare: DataFrame) -> DataFrame:
    """lists with the numbers of their rare terms as known. rare(item_id, place, df)."""
    own = rare.groupBy(F.col("item_id").alias("rare_id")).agg(F.collect_list(F.struct("place", "df")).alias("known"))  # of one item
    return lists.join(own, F.col("item_id").eqNullSafe(F.col("rare_id")), "left").drop("rare_id")


def _codes(terms: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, place, words) of lists of terms: words the distinct keys, place that of each word in keys, -1 where it isn't there."""
    flat = pc.ascii_lower(terms.flatten()).dictionary_encode()
    row, place = pc.list_parent_indices(terms).to_numpy().astype(np.int64), pc.fill_null(pc.index_in(flat.dictionary, value_set=keys), -1).to_numpy()
    return row, flat.indices.to_numpy().astype(np.int64), place, flat.dictionary


def _starts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(row, minlength=rows))]


def _rare(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, place, words = _codes(b.column("terms"), common.value[0])
            at = np.flatnonzero(place[code] < 0)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row[at])), pa.array((at - _starts(row, b.num_rows)[row[at]]).astype(np.int32)), words.take(pa.array(code[at]))], ["item_id", "place", "key"])

    return run


def _selected(common, n: float, most: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = common.value
        for b in batches:
            row, code, place, words = _codes(b.column("terms"), keys)
            start = _starts(row, b.num_rows)
            df = np.where(place >= 0, numbers[place] if len(numbers) else 1, 1)[code].astype(np.float64)
            known = b.column("known")
            if known.null_count < len(known):
                df[start[pc.list_parent_indices(known).to_numpy()] + known.flatten().field("place").to_numpy()] = known.flatten().field("df").to_numpy()
            weight = np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), 16)
            number = pc.match_substring_regex(words, "^[.,]*[0-9][0-9.,]*$").to_numpy(zero_copy_only=False)
            score = np.round((np.log((n + 1) / df) + 1) * weight[code] / 8.0 * np.where(number, 0.75, 1.0)[code], 9)
            order, terms = np.lexsort((-score, row)), b.column("terms").flatten()
            got = [_chosen(order[i:j], i, terms, score, most, least) for i, j in zip(start[:-1].tolist(), start[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([[t for t, _ in x] for x in got], pa.list_(pa.string())), pa.array([round(sum(s for _, s in x), 9) for x in got], pa.float64())], ["item_id", "terms", "score"])

    return run


def _chosen(order: np.ndarray, first: int, terms: pa.Array, score: np.ndarray, most: int, least: int) -> list[tuple[str, float]]:
    """choose() of one item, whose terms are from first on and by score in order; terms become Python objects as far as they are looked at."""
    chosen: dict[str, int] = {}

    def each(at: np.ndarray) -> Iterator[tuple[int, str]]:
        for i in range(0, len(at), 32):
            part = at[i : i + 32]
            yield from zip(part.tolist(), pc.ascii_lower(terms.take(pa.array(part))).to_pylist())

    for i, key in each(order):
        if len(chosen) >= most:
            break
        if not any(key in o or o in key for o in chosen):
            chosen[key] = i
    if len(chosen) < least:
        for i, key in each(np.arange(first, first + len(order))):
            if len(chosen) >= least:
                break
            chosen.setdefault(key, i)
    at = sorted(chosen.values())
    return list(zip(terms.take(pa.array(at)).to_pylist(), score[at].tolist())) if at and len(at) >= least else []


def choose(terms: list[tuple[str, str, int, float]], most: int, least: int) -> list[tuple[str, float]]:
    """(term, score) in order of place: up to `most` by score, skipping those whose key is within one chosen or the other way round; if fewer than `least` are left, more by place until there are `least`; none if there
    aren't so many. terms: (term, key, pos, score)."""
    chosen: dict[str, tuple[int, str, float]] = {}
    for term, key, pos, score in sorted(terms, key=lambda x: (-x[3], x[2])):
        if len(chosen) >= most:
            break
        if not any(key in o or o in key for o in chosen):
            chosen[key] = (pos, term, score)
    if len(chosen) < least:
        for term, key, pos, score in sorted(terms, key=lambda x: x[2]):
            if len(chosen) >= least:
                break
            chosen.setdefault(key, (pos, term, score))
    return [(t, s) for _, t, s in sorted(chosen.values())] if len(chosen) >= least else []


def chosen_terms(scored: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """(item_id, terms, score): choose() over all terms of each item, with the sum of their scores. The greedy choice depends on what was chosen before, so it is a UDF."""
    lists = scored.groupBy("item_id").agg(F.collect_list(F.struct("term", "key", "pos", "score")).alias("ts"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one item's terms at a time become Python objects
            got = [choose(list(zip(*(x.to_pylist() for x in ts.values.flatten()))), most, least) for ts in b.column("ts")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([[t for t, _ in x] for x in got], pa.list_(pa.string())), pa.array([round(sum(s for _, s in x), 9) for x in got], pa.float64())], ["item_id", "terms", "score"])

    return lists.mapInArrow(run, f"item_id {scored.schema['item_id'].dataType.simpleString()}, terms array<string>, score double")


def drafted(chosen: DataFrame, *, ask: bool = False, limit: int = MAX_CHARS) -> DataFrame:
    """chosen with its query: the terms, or a question about them, cut at the last space within limit characters. Items without terms have none."""
    terms = F.array_join("terms", " ")
    return chosen.where(F.size("terms") > 0).withColumn("query", trim_query(question(terms) if ask else terms, limit))


def page_cases(chosen: DataFrame) -> DataFrame:
    """(case_id, query, item_id): a question about the chosen terms of each item."""
    return drafted(chosen, ask=True).select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("case_id"), "query", "item_id")


def first_per(cases: DataFrame, keys: list[Column], *order: str | Column) -> DataFrame:
    """The first case of each key."""
    rank = "__lodestrand_case"
    return cases.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch):
            row, _, code, _, keys = _found(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.ListArray.from_arrays(pa.array(_starts(row, b.num_rows).astype(np.int32)), keys.take(pa.array(code)))], ["item_id", "t"])


def target_overlap(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, overlap): share of a query's terms that its target has."""
    q = cases.select("case_id", "item_id", salient_terms(F.col("query")).alias("q"))
    t = texts.select("item_id", "text").mapInArrow(_keys, f"item_id {texts.schema['item_id'].dataType.simpleString()}, t array<string>")
    return q.join(t, "item_id").select("case_id", ratio(F.size(F.array_intersect("q", "t")), F.size("q")).alias("overlap"))
