"""The column functions by name in SQL: register(spark), then SELECT source_family('bm25').

What built-in functions can say becomes a SQL function, which Catalyst inlines; splitting and hashed vectors are Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .splitter import subchunks
from .vectors import hashed

_SPACES = r"'(?U)\\s+'"
_QUOTES = "\"\\'“”‘’`"
_ENTITY = f"trim(regexp_replace(regexp_replace(trim(x), '^[{_QUOTES}]+|[{_QUOTES}]+$', ''), {_SPACES}, ' '))"
#: Name, parameters, type of the result, and what it is.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "lex_tokens": ("x STRING", "ARRAY<STRING>", "transform(regexp_extract_all(x, '[가-힣A-Za-z0-9_]+', 0), w -> lower(w))"),
    "norm_entity": ("x STRING", "STRING", _ENTITY),
    "norm_predicate": ("x STRING", "STRING", rf"trim(BOTH '_' FROM regexp_replace(regexp_replace(lower({_ENTITY}), '(?U)[^\\w]+', '_'), '_+', '_'))"),
    "source_family": ("x STRING", "STRING", """CASE WHEN contains(lower(trim(x)), 'triple_dense') THEN 'graph' WHEN lower(x) RLIKE '(caption|object|image)_dense' THEN 'visual' WHEN lower(trim(x)) = 'dense' OR contains(lower(x), 'text_dense') THEN 'dense_text'
        WHEN startswith(lower(trim(x)), 'rerank:') THEN 'reranker' WHEN lower(trim(x)) = 'bm25' OR contains(lower(x), 'lexical') THEN 'lexical' WHEN lower(trim(x)) = 'graph' THEN 'graph' WHEN trim(x) = '' THEN 'unknown' ELSE substring_index(lower(trim(x)), ':', 1) END"""),
    "bbox_region": ("b ARRAY<DOUBLE>", "STRING", """CASE WHEN size(b) = 4 AND get(b, 0) >= 0 AND get(b, 1) >= 0 AND get(b, 2) <= 1 AND get(b, 3) <= 1 AND get(b, 2) > get(b, 0) AND get(b, 3) > get(b, 1) THEN CASE WHEN abs((get(b, 0) + get(b, 2)) / 2 - 0.5D) <= 0.5D - 1D / 3 AND abs((get(b, 1) + get(b, 3)) / 2 - 0.5D) <= 0.5D - 1D / 3 THEN 'center' ELSE
        concat(CASE WHEN (get(b, 1) + get(b, 3)) / 2 < 1D / 3 THEN 'upper' WHEN (get(b, 1) + get(b, 3)) / 2 > 2D / 3 THEN 'lower' ELSE 'middle' END, ' ', CASE WHEN (get(b, 0) + get(b, 2)) / 2 < 1D / 3 THEN 'left' WHEN (get(b, 0) + get(b, 2)) / 2 > 2D / 3 THEN 'right' ELSE 'center' END) END END"""),
    "uuid5_url": ("x STRING", "STRING", """transform(array(sha1(concat(unhex('6ba7b8119dad11d180b400c04fd430c8'), encode(x, 'utf-8')))), h -> concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), concat('5', substring(h, 14, 3)),
        concat(substring('89ab', CAST(conv(substring(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substring(h, 18, 3)), substring(h, 21, 12)))[0]"""),
    "text_quality": ("x STRING", "STRING", r"""transform(array(trim(coalesce(x, ''))), t -> CASE WHEN t = '' THEN 'empty' WHEN round((regexp_count(t, '\\p{C}') - regexp_count(t, '[\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{85}]')) / length(t), 6) > 0.02
        OR length(t) >= 40 AND round(regexp_count(t, '[\\p{L}\\p{Nd}]') / length(t), 6) < 0.2 THEN 'degraded' ELSE 'good' END)[0]"""),
}


def _split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([[t for _, _, t in subchunks(x, 1600, 180, 180)] for x in s], dtype=object)


def _embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(list(hashed(s.tolist())), dtype=object)


def register(spark: SparkSession) -> None:
    """All functions as temporary ones of the session."""
    for name, (takes, gives, what) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {what}")
    for name, f, gives in (("split_text", _split, "array<string>"), ("hash_embed", _embed, "array<double>")):
        f.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        spark.udf.register(name, F.pandas_udf(f, gives))
