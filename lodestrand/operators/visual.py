"""What concerns assets: tiles, jobs, results of visual models and their repair."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence, ratio


def tiles(pages: DataFrame, rows: int, cols: int, overlap: float) -> DataFrame:
    """Each page's rows x cols boxes in 0..1, each wider by overlap of its size on every side, clipped to the page; adds (tile, row, col, x0, y0, x1, y1)."""
    if not (rows > 0 and cols > 0 and 0 <= overlap < 0.5):
        raise ValueError("rows and cols above 0, overlap in [0, 0.5)")
    x = pages.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    r, c = F.floor(F.col("tile") / cols).cast("int"), F.col("tile") % cols
    low = lambda i, n: F.round(F.greatest((i - overlap) / n, F.lit(0.0)), 6)
    high = lambda i, n: F.round(F.least((i + 1 + overlap) / n, F.lit(1.0)), 6)
    return x.select("*", r.alias("row"), c.alias("col"), low(c, cols).alias("x0"), low(r, rows).alias("y0"), high(c, cols).alias("x1"), high(r, rows).alias("y1"))


def job_order(jobs: DataFrame) -> list[Column]:
    return [F.desc("priority"), F.asc("page_no"), F.asc("tile"), F.asc("asset_id")]


def run_summary(results: DataFrame) -> DataFrame:
    """For each operation and backend: results, how many completed, durations. results(operation, backend, status, seconds)."""
    done = F.col("status") == "completed"
    return results.groupBy("operation", "backend").agg(
        F.count("*").alias("results"), F.sum(done.cast("int")).alias("completed"), F.round(ratio(F.sum(done.cast("int")), F.count("*")), 6).alias("completion_rate"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
        F.round(F.percentile("seconds", 0.5), 6).alias("p50_seconds"), F.round(F.percentile("seconds", 0.95), 6).alias("p95_seconds"),
    )


def run_score(weights: dict[str, float]) -> Column:
    """Weighted mean of the metrics that are there, their weights made to sum to 1; 0 where none is."""
    top, below = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        v = F.col(c).cast("double")
        top = top + F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * w, F.lit(0.0))
        below = below + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.coalesce(F.try_divide(top, below), F.lit(0.0))


def job_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): which of two runs has each job: 'both', 'first' or 'second'."""
    x, y = a.select(F.col(key).alias("k1")).distinct(), b.select(F.col(key).alias("k2")).distinct()
    side = F.when(F.col("k2").isNull(), "first").when(F.col("k1").isNull(), "second").otherwise("both")
    return x.join(y, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), side.alias("side"))


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


_STRING = r'"((?:\\.|[^"\\])*)"'
#: Fields that a broken answer is searched for: strings, and lists with how many of their strings count.
_FIELDS, _LISTS = ("page_type", "title", "summary"), {"key_points": 5, "visual_elements": 6, "entities": 8}
_FIELD_AT = {k: re.compile(rf'"{k}"\s*:\s*{_STRING}', re.DOTALL) for k in _FIELDS}
_LIST_AT = {k: re.compile(rf'"{k}"\s*:\s*\[') for k in _LISTS}
#: What a bracketed list may go on with: a whole string, another bracket, anything else.
_INSIDE = re.compile(rf'{_STRING}|[\[\]]|[^"\[\]]+|"', re.DOTALL)


def _candidates(text: str) -> Iterator[str]:
    """What may be the answer's JSON: the first fence, the whole, what lies between the first brace and the last, the same with brackets."""
    fence = _FENCE.search(text)
    if fence:
        yield fence[1].strip()
    if text[:1] in ("{", "["):
        yield text
    for first, last in ("{}", "[]"):
        i, j = text.find(first), text.rfind(last)
        if 0 <= i < j:
            yield text[i : j + 1]


def _unquoted(raw: str) -> str:
    try:
        return " ".join(json.loads(f'"{raw}"', strict=False).split())
    except ValueError:
        return ""


def _repaired(text: str) -> dict[str, object]:
    """The known fields that a broken object has whole: each is looked for once, so the time is linear in the text."""
    out: dict[str, object] = {}
    for k, at in _FIELD_AT.items():
        if (m := at.search(text)) and (v := _unquoted(m[1])):
            out[k] = v
    for k, at in _LIST_AT.items():
        if not (m := at.search(text)):
            continue
        depth, found = 1, {}
        for x in _INSIDE.finditer(text, m.end()):
            depth += (x[0] == "[") - (x[0] == "]")
            if not depth:
                break
            if x[1] is not None and (v := _unquoted(x[1])):
                found.setdefault(v.casefold(), v)
        if found:
            out[k] = list(found.values())[: _LISTS[k]]
    return out if any(k in out for k in ("title", "summary", *_LISTS)) else {}


def parse_output(text: str | None) -> tuple[str, str | None]:
    """(status, JSON) of a model's answer: the first of _candidates() that is JSON; else what is whole of a broken object's known fields; else the raw text."""
    t = (text or "").strip()
    dump = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)
    for candidate in _candidates(t):
        try:
            v = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        return "json_object" if isinstance(v, dict) else "json_list" if isinstance(v, list) else "json_scalar", dump(v)
    v = _repaired(t) if "{" in t else {}
    return ("json_repaired", dump(v)) if v else ("raw_text", None)


def parsed(text: Column) -> Column:
    """parse_output() as a column: struct(status, body)."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([parse_output(x) for x in s], columns=["status", "body"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "struct<status:string,body:string>")(text)


_LABELS = ("label", "name", "object", "title", "type", "text")
_BOXES = ("bbox", "box", "bounding_box", "coordinates", "rect")


def object_column(body: Column) -> Column:
    """A JSON object seen on an asset as struct(label, description, location, confidence, box): label and box under any of their names."""
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object(body, f"$.{n}")), F.lit("")) for n in names])
    box = F.from_json(get(*_BOXES), "array<double>")
    return F.struct(get(*_LABELS).alias("label"), get("description").alias("description"), get("location", "position", "region").alias("location"), confidence(get("confidence", "score"), percent=True, strict=True).alias("confidence"), F.when(F.size(box) == 4, box).alias("box"))


def missing_texts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks with the parts that their text lacks appended in order; a part that an appended one holds isn't added again. wanted(chunk_id, ord, part)."""
    parts = wanted.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("ps"))
    grown = F.aggregate(F.coalesce("ps", F.array().cast("array<struct<ord:int,part:string>>")), F.coalesce("text", F.lit("")), lambda t, p: F.when(F.contains(F.lower(t), F.lower(p["part"])), t).otherwise(F.concat(t, F.lit("\n"), p["part"])))
    return chunks.join(parts, "chunk_id", "left").withColumn("text", grown).drop("ps")
