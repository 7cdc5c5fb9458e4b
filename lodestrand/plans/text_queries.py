"""Queries over text: profiling, cleaning, tokens, page ranges, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.splitter import split_column
from .corpus import ASKED, PAGES, asked, numbered, pages, table
from .registry import query

_WORDS = "list_transform(regexp_extract_all({}, '[가-힣A-Za-z0-9_]+'), lambda x: lower(x))"


@query(r"""
    SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, CAST(c AS INTEGER) AS control,
           CASE WHEN length(t) = 0 THEN 0.0 ELSE round(CAST(c AS DOUBLE) / length(t), 6) END AS control_ratio,
           CASE WHEN length(t) = 0 THEN 0.0 ELSE round(CAST(g AS DOUBLE) / length(t), 6) END AS letter_ratio,
           CASE WHEN length(t) = 0 THEN 'empty' WHEN CAST(c AS DOUBLE) / length(t) > 0.02 OR (length(t) >= 40 AND CAST(g AS DOUBLE) / length(t) < 0.2) THEN 'degraded' ELSE 'good' END AS quality,
           CASE WHEN length(t) = 0 THEN '' ELSE concat_ws(',', CASE WHEN CAST(c AS DOUBLE) / length(t) > 0.02 THEN 'high_control_char_ratio' END,
               CASE WHEN length(t) >= 40 AND CAST(g AS DOUBLE) / length(t) < 0.2 THEN 'low_letter_or_number_ratio' END) END AS reasons
    FROM (SELECT doc_id, trim(text) AS t, length(regexp_replace(trim(text), '[^\p{C}]', '', 'g')) - length(regexp_replace(trim(text), '[^\t\n\v\f\r\x1c-\x1f\x{85}]', '', 'g')) AS c,
                 len(regexp_extract_all(trim(text), '[\p{L}\p{Nd}]')) AS g FROM documents)""")
def b01_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select("doc_id", text.text_quality(F.col("text")).alias("q"))
    return q.select("doc_id", "q.chars", "q.control", "q.control_ratio", "q.letter_ratio", "q.quality", F.array_join("q.reasons", ",").alias("reasons"))


@query(r"""SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 0.0 ELSE round(CAST(len(regexp_extract_all(trim(text), '[\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]')) AS DOUBLE) / length(trim(text)), 6) END AS cjk_ratio FROM documents""")
def b02_cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cjk_ratio(F.col("text")).alias("cjk_ratio"))


@query("""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS clean FROM documents""")
def b03_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_lines(F.col("text"))).alias("clean"))


@query(r"""WITH s AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(text) AS raw FROM benchmark)
    SELECT item_id, t AS squeezed, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '...' END AS ellipsis,
           CASE WHEN length(raw) <= 60 THEN raw ELSE rtrim(substr(raw, 1, 57)) || '...' END AS context,
           CASE WHEN length(t) <= 60 THEN t WHEN instr(substr(t, 1, 60), ' ') > 0 THEN regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') ELSE substr(t, 1, 60) END AS query FROM s""")
def b05_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.squeeze_ws(t).alias("squeezed"), text.trim_ellipsis(t, 60).alias("ellipsis"), text.trim_context(t, 60).alias("context"), text.trim_query(t, 60).alias("query"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents)")
def b06_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_GRAMS = "flatten(list_transform({w}, lambda x: list_concat(CASE WHEN length(x) >= 2 THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [] END, CASE WHEN length(x) >= 3 THEN list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) ELSE [] END)))".format(w=_WORDS.format("text"))


@query(f"SELECT item_id, CAST(len(g) AS INTEGER) AS n, md5(array_to_string(g, ' ')) AS grams FROM (SELECT item_id, {_GRAMS} AS g FROM benchmark)")
def b07_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.char_ngrams(F.col("text"), 2, 3).alias("g")).select("item_id", F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("grams"))


@query(f"SELECT item_id, CAST(len(list_distinct(t)) AS INTEGER) AS n, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS tokens FROM (SELECT item_id, list_concat({_WORDS.format('text')}, {_GRAMS}) AS t FROM benchmark)")
def b08_mixed_tokens_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.mixed_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens"))


@query(f"""WITH {ASKED} SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+|[가-힣]{{2,}}|[一-龥]{{2,}}|[0-9]{{2,}}'), lambda x: lower(x)))), ' ') AS terms FROM asked""")
def b10_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.array_join(F.array_sort(text.audit_terms(F.col("text"))), " ").alias("terms"))


_MARKED = "'# ' || text || ' [x](y) `c` *b* > _q_' || chr(10) || 'Full page render for page 3' || chr(10) || 'end'"


@query(rf"""WITH m AS (SELECT item_id, {_MARKED} AS t FROM benchmark) SELECT item_id, trim(regexp_replace(regexp_replace(t, '[|#*_`>\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS query,
    trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT contains(x, 'Full page render for page')), ' '), '[|#*_`>\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS meaning FROM m""")
def b11_query_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with Markdown and a placeholder line added."""
    t = F.concat(F.lit("# "), "text", F.lit(" [x](y) `c` *b* > _q_\nFull page render for page 3\nend"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.normalise_query(t).alias("query"), text.meaningful_text(t).alias("meaning"))


@query(f"""WITH {PAGES} SELECT doc_id, CASE WHEN starts_with(text, p) THEN md5(text) ELSE md5(p || chr(10) || chr(10) || text) END AS prefixed
    FROM (SELECT doc_id, text, 'Section: ' || lang || ' > ' || CAST((page_no - 1) // 10 AS VARCHAR) || chr(10) || 'Page range: ' || page_no || '-' || page_no AS p FROM pg)""")
def b16_context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    section = F.struct(F.col("lang").alias("chapter"), F.floor((F.col("page_no") - 1) / 10).cast("string").alias("section"), F.lit("").alias("subsection"), F.lit(None).cast("string").alias("issue"))
    return p.select("doc_id", F.md5(text.with_prefix(F.col("text"), text.context_prefix(text.section_label(section), F.col("page_no"), F.col("page_no")))).alias("prefixed"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\w]+', '_', 'g'), '_+', '_', 'g'), '_') AS predicate, p_brand || ' ' || replace(trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\w]+', '_', 'g'), '_+', '_', 'g'), '_'), '_', ' ') || ' ' || p_type AS triple FROM part""")
def b26_predicate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text.normalise_predicate(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("predicate"), text.triple_text(F.col("p_brand"), p, F.col("p_type")).alias("triple"))


@query(f"""WITH {PAGES} SELECT doc_id, substr(sha256(doc || ':' || page_no || ':' || page_no || ':text:0'), 1, 20) AS chunk_id, substr(sha256(lower(trim(doc))), 1, 24) AS node_id,
    substr(sha256(substr(sha256(doc || ':' || page_no || ':' || page_no || ':text:0'), 1, 20) || ':semantic:1'), 1, 20) AS sub_id FROM pg""")
def b00_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ids.chunk_id(F.col("doc"), F.col("page_no"), F.col("page_no"), F.lit("text"), F.lit(0))
    return pages(spark, sf_dir).select("doc_id", c.alias("chunk_id"), ids.node_id(F.col("doc")).alias("node_id"), ids.sha_id(20, c, F.lit("semantic"), F.lit(1)).alias("sub_id"))


@query("""WITH w AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS x FROM documents) WHERE x <> '')
    SELECT x AS word, CAST((CAST('0x' || substr(sha256(x), 57, 8) AS BIGINT) + 256 * (
        CAST('0x' || substr(sha256(x), 1, 8) AS BIGINT) + CAST('0x' || substr(sha256(x), 9, 8) AS BIGINT) + CAST('0x' || substr(sha256(x), 17, 8) AS BIGINT) + CAST('0x' || substr(sha256(x), 25, 8) AS BIGINT)
        + CAST('0x' || substr(sha256(x), 33, 8) AS BIGINT) + CAST('0x' || substr(sha256(x), 41, 8) AS BIGINT) + CAST('0x' || substr(sha256(x), 49, 8) AS BIGINT))) % 384 AS BIGINT) AS slot FROM w""")
def b34_hash_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", ids.hash_slot(F.col("word")).alias("slot"))


@query(f"""WITH {PAGES}, q AS (SELECT doc, lang, page_no, length(trim(text)) AS n FROM pg)
    SELECT doc, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars, round(avg(n), 1) AS mean_chars, median(CAST(n AS DOUBLE)) AS median_chars,
           count(DISTINCT lang) AS langs, coalesce(array_to_string(list_transform(list_sort(list(page_no) FILTER (WHERE n > 5000)), lambda x: CAST(x AS VARCHAR)), ','), '') AS long_pages FROM q GROUP BY doc""")
def e01_profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim("text"))
    return pages(spark, sf_dir).groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(n), 1).alias("mean_chars"), F.percentile(n.cast("double"), 0.5).alias("median_chars"), F.count_distinct("lang").alias("langs"),
        F.array_join(F.array_sort(F.collect_list(F.when(n > 5000, F.col("page_no")))), ",").alias("long_pages"),
    )


@query("""SELECT lang, count(*) AS n, CAST(min(n_chars) AS BIGINT) AS low, CAST(max(n_chars) AS BIGINT) AS high, round(avg(n_chars), 6) AS mean,
    quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95 FROM documents GROUP BY lang""")
def e04_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n.cast("double"), 0.5).alias("p50"), F.round(F.percentile(n.cast("double"), 0.95), 6).alias("p95"))


def page_ranges(df: DataFrame, keys: list[str], page: str = "page_no") -> DataFrame:
    """Pages of each group as a spec such as 1-3,7: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(page)
    island = df.select(*keys, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w))
    runs = island.groupBy(*keys, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", part.alias("part")))), lambda x: x["part"]), ",").alias("spec"))


def parse_ranges(spec: str) -> list[int]:
    """The pages of a spec such as 1-3,7."""
    out: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        low, _, high = part.partition("-")
        if not low.isdigit() or (high and not high.isdigit()) or (_ and not high) or int(low) < 1 or int(high or low) < int(low):
            raise ValueError(f"no page range: {part}")
        out |= set(range(int(low), int(high or low) + 1))
    return sorted(out)


@query(f"""WITH {PAGES}, i AS (SELECT doc, lang, page_no, page_no - row_number() OVER (PARTITION BY doc, lang ORDER BY page_no) AS island FROM pg),
    r AS (SELECT doc, lang, min(page_no) AS a, max(page_no) AS b FROM i GROUP BY doc, lang, island)
    SELECT doc, lang, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY doc, lang""")
def b39_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ranges(pages(spark, sf_dir), ["doc", "lang"])


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_WORDS.format('text')})) AS token FROM documents), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
    SELECT token AS term, count(*) AS df, round((ln((n.n + 1) / count(*)) + 1) * least(length(token), 16) / 8.0 * CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 0.75 ELSE 1.0 END, 6) AS score
    FROM t, n GROUP BY token, n.n""")
def f15_salient_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    df = d.select(F.explode(F.array_distinct(text.word_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    score = (F.log((F.col("n") + 1) / F.col("df")) + 1) * F.least(F.length("term"), F.lit(16)) / 8.0 * F.when(F.col("term").rlike("^[0-9]+$"), 0.75).otherwise(1.0)
    return df.crossJoin(F.broadcast(d.agg(F.count("*").cast("double").alias("n")))).select("term", "df", F.round(score, 6).alias("score"))  # one row


@query()
def b13_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page split at boundaries: (doc_id, idx, total, chars, text)."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(split_column(F.col("text"))).alias("p"))
    return parts.select("doc_id", "p.idx", "p.total", F.length("p.text").alias("chars"), "p.text")


@query(f"""WITH {PAGES} SELECT doc, page_no, doc_id FROM pg""")
def b00_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id"), "doc", "doc_id").select("doc", "page_no", "doc_id")
