"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, langid, lines, media, mixing, mux, near, packing, pii, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.index_tracks(mux.muxed(table(spark, sf_dir, "pages"), "page_id", "html"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language(docs, langid.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_ids(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_media, op3_exact_dedup, op4_pii, op5_near_copies, op6_chat_format, op7_language, op8_toxicity, op9_mixing, op10_packing)}

SQL: dict[str, str] = {
    "op1_line_dedup": """
        WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
        lines AS (SELECT doc_id, i, p[i] AS line, trim(p[i], ' ' || chr(9) || chr(13)) AS k
                  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
        ranked AS (SELECT doc_id, i, line, k = '' OR row_number() OVER (PARTITION BY k ORDER BY doc_id, i) = 1 AS keep FROM lines),
        cut AS (SELECT doc_id, coalesce(string_agg(CASE WHEN keep THEN line END, chr(10) ORDER BY i), '') AS text,
                       CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS INTEGER) AS removed
                FROM ranked GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE c.text END AS text, coalesce(c.removed, CAST(0 AS INTEGER)) AS removed
        FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id""",
    "op3_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id,
               CAST(CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 1 ELSE 0 END AS INTEGER) AS is_copy
        FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT doc_id, doc_id AS keep_id, CAST(0 AS INTEGER) AS is_copy FROM documents WHERE text IS NULL""",
    "op6_chat_format": """
        WITH turns AS (SELECT DISTINCT conv_id, turn, replace(replace(coalesce(role, ''), '<|im_', '< |im_'), '|im_end|', '|im_end |') AS role, replace(replace(coalesce(text, ''), '<|im_', '< |im_'), '|im_end|', '|im_end |') AS text FROM conversations WHERE conv_id IS NOT NULL),
        chats AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
                         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
                  FROM turns GROUP BY conv_id),
        firsts AS (SELECT min(conv_id) AS conv_id, n_turns, chat FROM chats GROUP BY n_turns, chat)
        SELECT f.conv_id, f.n_turns, f.chat FROM firsts f
        WHERE NOT EXISTS (SELECT 1 FROM firsts o WHERE o.n_turns > f.n_turns AND starts_with(o.chat, f.chat))""",
}
