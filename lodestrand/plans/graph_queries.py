"""Queries of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.components import connected_components
from .corpus import PAGES, TRIPLES, pages, triples
from .registry import query

_NOISY = f"""{TRIPLES}, nt AS (SELECT * FROM tr UNION ALL SELECT triple_id || 'u', chunk_id, ' ' || upper(subject) || ' ', 'Located In', object, confidence + 0.05 FROM tr WHERE predicate = 'located_in' AND CAST(substr(chunk_id, 2) AS BIGINT) % 5 = 0
    UNION ALL SELECT triple_id || 'e', chunk_id, subject, 'is', '', 1.5 FROM tr WHERE predicate = 'located_in' AND CAST(substr(chunk_id, 2) AS BIGINT) % 11 = 0 UNION ALL SELECT triple_id || 'l', 'lost', subject, 'same_as', subject, NULL FROM tr WHERE predicate = 'part_of'),
  nf AS (SELECT *, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS s, trim(regexp_replace(regexp_replace(lower(trim(predicate)), '[^\\w]+', '_', 'g'), '_+', '_', 'g'), '_') AS p, lower(trim(regexp_replace(object, '\\s+', ' ', 'g'))) AS o FROM nt)"""


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples with copies in other letters, empty ones, and loops of no chunk."""
    t = triples(spark, sf_dir).select("triple_id", "chunk_id", "subject", "predicate", "object", "confidence")
    n = F.try_to_number(F.substring("chunk_id", 2, 18), F.lit("999999999999999999")).cast("long")
    own = t.where("predicate = 'located_in'")
    loud = own.where(n % 5 == 0).select(F.concat("triple_id", F.lit("u")).alias("triple_id"), "chunk_id", F.concat(F.lit(" "), F.upper("subject"), F.lit(" ")).alias("subject"), F.lit("Located In").alias("predicate"), "object", (F.col("confidence") + 0.05).alias("confidence"))
    empty = own.where(n % 11 == 0).select(F.concat("triple_id", F.lit("e")).alias("triple_id"), "chunk_id", "subject", F.lit("is").alias("predicate"), F.lit("").alias("object"), F.lit(1.5).alias("confidence"))
    loops = t.where("predicate = 'part_of'").select(F.concat("triple_id", F.lit("l")).alias("triple_id"), F.lit("lost").alias("chunk_id"), "subject", F.lit("same_as").alias("predicate"), F.col("subject").alias("object"), F.lit(None).cast("double").alias("confidence"))
    return t.unionByName(loud).unionByName(empty).unionByName(loops)


@query(f"WITH {_NOISY} SELECT triple_id, subject, predicate, object, round(confidence, 6) AS confidence, copies FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, s, p, o ORDER BY coalesce(confidence, -1) DESC, triple_id) AS k, count(*) OVER (PARTITION BY chunk_id, s, p, o) AS copies FROM nf) WHERE k = 1")
def j05_triple_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedupe(noisy(spark, sf_dir)).select("triple_id", "subject", "predicate", "object", F.round("confidence", 6).alias("confidence"), "copies")


@query(f"WITH {_NOISY} SELECT chunk_id, s AS subject, p AS predicate, o AS object, copies FROM (SELECT chunk_id, s, p, o, count(*) AS copies FROM nf WHERE s <> '' AND o <> '' AND p <> '' AND p <> 'is' GROUP BY chunk_id, s, p, o)")
def k13_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy triples, the loud ones in full-width letters."""
    n = noisy(spark, sf_dir)
    wide = F.translate("subject", "ABCDEFGHIJKLMNOPQRSTUVWXYZ#", "".join(chr(0xFF21 + i) for i in range(26)) + chr(0xFF03))
    n = n.withColumn("subject", F.when(F.endswith("triple_id", F.lit("u")), wide).otherwise(F.col("subject")))
    return G.normalised(n).select("chunk_id", F.lower("subject").alias("subject"), "predicate", F.lower("object").alias("object"), "copies")


_DEGREES = "en AS (SELECT subject AS label, 1 AS out, predicate, chunk_id FROM nt UNION ALL SELECT object, 0, predicate, chunk_id FROM nt), dg AS (SELECT substr(sha256(lower(trim(label))), 1, 24) AS node_id, min(label) AS label, CAST(sum(out) AS BIGINT) AS out_degree, CAST(sum(1 - out) AS BIGINT) AS in_degree, count(*) AS degree, count(DISTINCT chunk_id) AS chunks, count(DISTINCT predicate) AS predicates FROM en WHERE trim(label) <> '' GROUP BY 1)"


@query(f"WITH {_NOISY}, {_DEGREES} SELECT * FROM dg")
def e19_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(noisy(spark, sf_dir))


@query(f"WITH {_NOISY}, {_DEGREES} SELECT (SELECT count(*) FROM nt) AS triples, (SELECT count(DISTINCT predicate) FROM nt) AS predicates, count(*) AS nodes, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM dg")
def e20_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(noisy(spark, sf_dir))


@query(f"WITH {_NOISY}, {_DEGREES} SELECT node_id, label, degree FROM dg ORDER BY degree DESC, lower(label), node_id LIMIT 10")
def f20_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_nodes(noisy(spark, sf_dir), 10).select("node_id", "label", "degree")


@query(f"""WITH {_NOISY} SELECT (SELECT count(*) FROM nt) AS triples, count(*) FILTER (WHERE trim(subject) = '' OR trim(predicate) = '' OR trim(object) = '') AS empty, count(*) FILTER (WHERE confidence < 0 OR confidence > 1) AS bad_confidence, count(*) FILTER (WHERE p = 'is') AS empty_predicates,
    count(*) FILTER (WHERE trim(regexp_replace(subject, '\\s+', ' ', 'g')) <> subject OR p <> predicate OR trim(regexp_replace(object, '\\s+', ' ', 'g')) <> object) AS changed,
    (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM nf GROUP BY chunk_id, s, p, o)) AS duplicates, count(*) FILTER (WHERE chunk_id = 'lost') AS orphans FROM nf""")
def e21_triple_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit(noisy(spark, sf_dir), triples(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRIPLES}, ed AS (SELECT DISTINCT lower(subject) AS a, lower(object) AS b FROM tr), un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), nd AS (SELECT DISTINCT a AS n FROM un),
    cc AS (SELECT n, n AS m FROM nd UNION SELECT un.b, cc.m FROM cc JOIN un ON un.a = cc.n WHERE cc.m < un.b) SELECT n AS node, min(m) AS component FROM cc GROUP BY n""")
def e29_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = triples(spark, sf_dir).select(F.lower("subject").alias("a"), F.lower("object").alias("b"))
    return connected_components(e)


@query(f"""WITH {PAGES}, r AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc, CASE WHEN page_no % 7 <> 0 THEN 'chapter ' || (page_no - 1) // 50 END AS c, 'section ' || (page_no - 1) // 10 AS s, CASE WHEN page_no % 3 = 0 THEN 'issue ' || page_no % 4 END AS i FROM pg),
    x AS (SELECT chunk_id, doc, doc AS subject, 'includes_chapter' AS predicate, c AS object FROM r WHERE c IS NOT NULL UNION ALL SELECT chunk_id, doc, coalesce(c, doc), 'includes_issue', i FROM r WHERE i IS NOT NULL UNION ALL SELECT chunk_id, doc, chunk_id, 'belongs_to_section', concat_ws(' > ', c, s, i) FROM r)
    SELECT substr(sha256(chunk_id || ':' || subject || ':' || predicate || ':' || object), 1, 24) AS triple_id, chunk_id, doc, subject, predicate, object, CAST(0.75 AS DOUBLE) AS confidence FROM x""")
def k10_section_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of 50 pages but for every seventh page, sections of 10, an issue on every third page."""
    part = lambda n, name: F.concat(F.lit(name), F.floor((F.col("page_no") - 1) / n).cast("string"))
    section = F.struct(F.when(F.col("page_no") % 7 != 0, part(50, "chapter ")).alias("chapter"), part(10, "section ").alias("section"), F.lit("").alias("subsection"), F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("issue "), (F.col("page_no") % 4).cast("string"))).alias("issue"))
    return G.section_triples(pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "doc", section.alias("section")))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, event_id % 5 AS k FROM events), t AS (SELECT 'c' || user_id AS chunk_id, 'd' || user_id % 7 AS doc, 'user ' || user_id AS subject, event_type AS predicate, 'event ' || event_id AS object, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 0.0 END AS confidence, CASE WHEN k = 3 THEN 'place=top' ELSE '' END AS qualifiers FROM e WHERE k <> 4)
    SELECT substr(sha256(chunk_id || ':' || subject || ':' || predicate || ':' || object), 1, 24) AS triple_id, doc, chunk_id, subject, predicate, object, CAST(confidence AS DOUBLE) AS confidence, qualifiers FROM t""")
def k11_model_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a model's JSON: confidence as a number, beyond 1, as a word, below 0; every fifth lacks its object."""
    from .corpus import table

    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    body = F.to_json(F.struct(F.concat(F.lit(" user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.when(k == 4, " ").otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("object"), F.when(k == 0, "0.5").when(k == 1, "7").when(k == 2, "sure").otherwise("-1").alias("confidence"), F.when(k == 3, "top").alias("place")))
    chunk = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    c = e.select(chunk.alias("chunk_id"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("doc")).distinct()
    t = G.triples_from_json(c, e.select(chunk.alias("chunk_id"), body.alias("body")))
    return t.withColumn("qualifiers", F.array_join(F.transform(F.map_entries("qualifiers"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


@query(f"WITH {TRIPLES} SELECT triple_id, substr(sha256(lower(trim(subject))), 1, 24) AS source, substr(sha256(lower(trim(object))), 1, 24) AS target, predicate, confidence FROM tr")
def k18_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.export(triples(spark, sf_dir))[1].select("triple_id", "source", "target", "predicate", "confidence")


@query("SELECT p_partkey, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS label FROM part")
def b25_entity_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in full-width letters come back to plain ones."""
    from .corpus import table

    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return table(spark, sf_dir, "part").select("p_partkey", G.norm_entity(F.concat(F.lit(' "'), wide, F.lit('" '))).alias("label"))


@query("""WITH a AS (SELECT p_partkey, p_name AS caption, string_split(p_name, ' ') AS ent, string_split(lower(p_type), ' ') AS el, [p_brand] AS ob FROM part),
    d AS (SELECT p_partkey, caption, 0 AS k, 'mentions_entity' AS predicate, unnest(ent) AS o, generate_subscripts(ent, 1) AS i, 0.62 AS c FROM a UNION ALL SELECT p_partkey, caption, 1, 'contains_visual_element', unnest(el), generate_subscripts(el, 1), 0.58 FROM a UNION ALL SELECT p_partkey, caption, 2, 'contains_object', unnest(ob), generate_subscripts(ob, 1), 0.6 FROM a),
    f AS (SELECT * FROM d WHERE trim(o) <> '' AND NOT (k = 2 AND p_partkey % 2 = 0)), u AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(caption), predicate, lower(o) ORDER BY k, i) AS r FROM f),
    t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k, i) AS n FROM u WHERE r = 1)
    SELECT p_partkey AS asset_id, caption AS subject, predicate, o AS object, CAST(c AS DOUBLE) AS confidence FROM t WHERE n <= 12 UNION ALL SELECT p_partkey, caption, 'contains_object', ob[1], 0.9 FROM a WHERE p_partkey % 2 = 0""")
def k12_derived_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets; even ones say themselves what they contain."""
    from .corpus import table

    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("caption"), F.split("p_name", " ").alias("entities"), F.split(F.lower("p_type"), " ").alias("elements"), F.array("p_brand").alias("objects"))
    said = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("subject"), F.lit("contains_object").alias("predicate"), F.col("p_brand").alias("object"), F.lit(0.9).alias("confidence"))
    return G.derived_triples(a, said)
