"""Queries over the record sets of a package and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text
from ..operators import chunks as C
from ..operators import links as L
from ..operators import records as R
from .corpus import ASSET_TRIPLES, PACKAGE, PAGES, asset_triples, assets, chunks, links, pages, table
from .registry import query


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of 50 pages, and sections of 10 of which every third is missing."""
    last = pages(spark, sf_dir).groupBy("doc").agg(F.max("page_no").alias("m"))
    ks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / n)))
    part = lambda n, name, base: last.select("doc", ks(n).alias("k")).select("doc", (F.col("k") * n + 1).alias("page_start"), (F.col("k") * n + n).alias("page_end"), (F.col("k") + base).alias("ord"), F.concat(F.lit(name), F.col("k").cast("string")).alias("section"))
    return part(50, "chapter ", 0).unionByName(part(10, "section ", 1000).where("(ord - 1000) % 3 <> 2"))


_SECTIONS = """la AS (SELECT doc, max(page_no) AS m FROM pg GROUP BY doc), se AS (SELECT doc, k * 50 + 1 AS ps, k * 50 + 50 AS pe, k AS ord, 'chapter ' || k AS section FROM (SELECT doc, unnest(range(0, (m - 1) // 50 + 1)) AS k FROM la)
    UNION ALL SELECT doc, k * 10 + 1, k * 10 + 10, k + 1000, 'section ' || k FROM (SELECT doc, unnest(range(0, (m - 1) // 10 + 1)) AS k FROM la) WHERE k % 3 <> 2),
  ws AS (SELECT doc_id, section FROM (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY ps DESC, ord) AS r FROM pg LEFT JOIN se ON pg.doc = se.doc AND page_no BETWEEN ps AND pe) WHERE r = 1)"""


@query(f"WITH {PAGES}, {_SECTIONS} SELECT doc_id, section FROM ws")
def d01_section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_section(pages(spark, sf_dir).select("doc", "page_no", "doc_id"), sections(spark, sf_dir)).select("doc_id", "section")


@query(f"WITH {PACKAGE} SELECT ch.doc_id, quality, kind IS NOT NULL AS has_asset, kind FROM ch LEFT JOIN labels USING (doc_id) LEFT JOIN ast ON ch.doc_id = page_id")
def d02_page_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "kind")
    x = chunks(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(a, "doc_id", "left")
    return x.select("doc_id", "quality", F.col("kind").isNotNull().alias("has_asset"), "kind")


@query(f"WITH {PACKAGE}, sp AS (SELECT doc, (page_no - 1) // 2 AS k, min(page_no) AS a, max(page_no) AS b FROM pg GROUP BY ALL) SELECT sp.doc || '/' || k AS chunk_id, string_agg(asset_id, ',' ORDER BY asset_id) AS assets FROM sp JOIN ast ON sp.doc = ast.doc AND page_no BETWEEN a AND b GROUP BY ALL")
def d03_page_asset_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two pages and the assets on them."""
    k = F.floor((F.col("page_no") - 1) / 2).alias("k")
    spans = pages(spark, sf_dir).groupBy("doc", k).agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end")).withColumn("chunk_id", F.concat_ws("/", "doc", F.col("k").cast("string")))
    return L.assets_by_span(spans, assets(spark, sf_dir)).select("chunk_id", F.array_join("assets", ",").alias("assets"))


@query(f"WITH {PACKAGE} SELECT DISTINCT chunk_id, x AS asset_id FROM (SELECT chunk_id, unnest(list_concat(CASE WHEN doc_id % 3 = 0 THEN [asset_id] ELSE [] END, CASE WHEN doc_id % 2 = 0 THEN [asset_id] ELSE [] END)) AS x FROM ch JOIN ast ON doc_id = page_id)")
def d04_chunk_asset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ids, by references, or by both."""
    x = chunks(spark, sf_dir).join(assets(spark, sf_dir).select("asset_id", "page_id"), F.col("doc_id") == F.col("page_id"))
    refs = F.when(F.col("doc_id") % 2 == 0, F.array("source_id", F.concat(F.lit("asset:"), F.col("asset_id")))).otherwise(F.array("source_id"))
    return L.asset_links(x.select("chunk_id", F.when(F.col("doc_id") % 3 == 0, F.array("asset_id")).alias("asset_ids"), refs.alias("refs")))


@query(f"WITH {PACKAGE} SELECT kind, doc, arg_min(chunk_id, (page_start, chunk_id)) AS chunk_id FROM ch JOIN ast ON doc_id = page_id AND ch.doc = ast.doc GROUP BY ALL".replace("SELECT kind, doc,", "SELECT kind, ch.doc AS doc,"))
def d05_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk that shows an asset of each kind, in every document."""
    x = links(spark, sf_dir).join(assets(spark, sf_dir).select("asset_id", "kind"), "asset_id").join(chunks(spark, sf_dir).select("chunk_id", "doc", "page_start"), "chunk_id")
    return L.first_by(x.withColumn("key", F.concat_ws("|", "kind", "doc")), "key", "page_start", "chunk_id").select("kind", "doc", "chunk_id")


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES} SELECT alias, chunk_id FROM al")
def d06_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.aliases(chunks(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(asset_triples(spark, sf_dir), L.aliases(chunks(spark, sf_dir)), links(spark, sf_dir))


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES} SELECT triple_id, chunk_id, CAST(place AS INTEGER) AS place FROM rs")
def d07_triple_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(f"""WITH {PACKAGE}, {ASSET_TRIPLES}, nw AS (SELECT substr(sha256(rs.chunk_id || ':' || subject || ':' || predicate || ':' || object), 1, 24) AS triple_id, rs.chunk_id, subject, predicate, object, triple_id AS was FROM rs JOIN atr USING (triple_id) WHERE place = 1)
    SELECT triple_id, chunk_id, subject, predicate, object, was FROM (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY was DESC) AS r FROM nw) WHERE r = 1""")
def d09_triple_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.remap(asset_triples(spark, sf_dir), _resolved(spark, sf_dir))


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES} SELECT triple_id, subject, object FROM atr WHERE triple_id NOT IN (SELECT triple_id FROM rs)")
def d10_orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asset_triples(spark, sf_dir).join(_resolved(spark, sf_dir), "triple_id", "left_anti").select("triple_id", "subject", "object")


@query(f"WITH {PACKAGE} SELECT doc, page_no FROM pg EXCEPT SELECT doc, page_no FROM ast")
def d11_uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc", "page_no").join(assets(spark, sf_dir).select("doc", "page_no"), ["doc", "page_no"], "left_anti")


@query(f"WITH {PACKAGE} SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY parent_id) % 2 = 0 THEN parent_id ELSE chunk_id END AS canonical FROM ch")
def d16_parent_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk stands for its parent if that is in the corpus: here, of parents whose first row is even."""
    c = chunks(spark, sf_dir)
    there = c.groupBy("parent_id").agg(F.min("doc_id").alias("d")).where("d % 2 = 0").select(F.col("parent_id").alias("there"))
    return c.join(there, F.col("parent_id") == F.col("there"), "left").select("doc_id", F.coalesce("there", "chunk_id").alias("canonical"))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
    SELECT a.conv_id, a.turn, b.turn AS near_turn, CAST(b.place - a.place AS INTEGER) AS distance FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.place <> b.place AND abs(a.place - b.place) <= 2""")
def d17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns before and after each turn."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("item_id"))
    items = c.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("item_id")))
    return L.neighbours(items, c, 2).select(F.col("doc").alias("conv_id"), F.col("item_id").alias("turn"), F.col("near_id").alias("near_turn"), "distance")


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES}, hit AS (SELECT chunk_id FROM ch) SELECT 'asset' AS kind, asset_id AS id FROM ast WHERE asset_id IN (SELECT asset_id FROM lk JOIN hit USING (chunk_id)) UNION ALL SELECT 'triple', triple_id FROM atr WHERE triple_id IN (SELECT triple_id FROM rs JOIN hit USING (chunk_id))")
def d18_context_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets and triples of the chunks of a context that holds them all."""
    hit = chunks(spark, sf_dir).select("chunk_id")
    a = assets(spark, sf_dir).join(links(spark, sf_dir).join(hit, "chunk_id"), "asset_id", "left_semi").select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"))
    t = asset_triples(spark, sf_dir).join(_resolved(spark, sf_dir).join(hit, "chunk_id"), "triple_id", "left_semi").select(F.lit("triple"), "triple_id")
    return a.union(t)


_AFTER = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' (revised)' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 100000000, text, lang FROM documents WHERE doc_id % 9 = 0"


def _after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang"))
    return d, old.unionByName(d.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 100000000))


@query(f"""WITH b AS ({_AFTER}) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM documents a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang""")
def d22_package_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.delta(*_after(spark, sf_dir), "doc_id")


@query(f"WITH b AS ({_AFTER}) SELECT doc_id, 'added' AS change FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'removed' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM b)")
def j07_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.select("doc_id") for x in _after(spark, sf_dir))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


@query(f"WITH b AS ({_AFTER}) SELECT doc_id, md5(text) AS text, lang FROM b UNION ALL SELECT doc_id, md5(text), lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def a17_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _after(spark, sf_dir)
    return L.upsert(a, b, ["doc_id"]).select("doc_id", F.md5("text").alias("text"), "lang")


@query(r"""WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status FROM events)
    SELECT user_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'completed' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END, event_id) AS k FROM r) WHERE k = 1""")
def j03_merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    r = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"))
    return L.merge_best(r, "user_id", order="event_id").select("user_id", "event_id", "status")


_PAGE_CHUNKS = f"""{PACKAGE}, {_SECTIONS}, pk AS (SELECT doc_id, doc, page_no, section, CASE WHEN length(trim(text)) > 0 THEN 'text' ELSE 'page_summary' END AS kind,
    CASE WHEN length(trim(text)) > 0 THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) ELSE 'Page ' || page_no || ' has no usable text.' END AS text FROM pg JOIN ws USING (doc_id))"""


@query(f"WITH {_PAGE_CHUNKS} SELECT substr(sha256(doc || ':' || page_no || ':' || page_no || ':' || kind || ':0'), 1, 20) AS chunk_id, kind, section, md5(text) AS text, kind = 'page_summary' AS needs_ocr FROM pk")
def k01_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_chunks(pages(spark, sf_dir), sections(spark, sf_dir)).select("chunk_id", "kind", "section", F.md5("text").alias("text"), "needs_ocr")


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets with all that is said of them: the whole body as what was read off them; its long words as entities and objects, one of them twice; some with a place, some with a box."""
    a = written(assets(spark, sf_dir).withColumn("w", F.slice(F.array_distinct(F.transform(F.filter(F.split("body", " "), lambda w: F.length(w) >= 6), lambda w: F.lower(w))), 1, 12)))
    word = lambda i: F.try_element_at("w", F.lit(i))
    box = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.3, 0.3)])
    none = F.lit(None).cast("string")

    def seen(label: Column, attributes: Column, description: Column, location: Column, boxed: Column, source: str) -> Column:
        return F.struct(label.alias("label"), attributes.alias("attributes"), description.alias("description"), location.alias("location"), F.when(boxed, box).alias("bbox"), none.alias("bbox_region"), F.lit(0.5).alias("confidence"), F.lit(source).alias("source_key"))

    i = F.col("page_id")
    first = lambda label: seen(label, F.array_compact(F.array(word(2), F.upper(word(2)))), word(3), F.when(i % 4 == 0, "top"), i % 5 == 0, "objects")
    objects = F.array(first(word(1)), first(F.upper(word(1))), seen(F.col("kind"), F.array().cast("array<string>"), none, none, F.lit(True), "detections"))
    return a.select(
        "asset_id", "page_id", "doc", "page_no", "kind", "caption", F.col("body").alias("ocr_text"), F.when(i % 3 == 0, F.concat(F.lit("Summary of "), "caption")).alias("vlm_summary"), F.col("kind").alias("page_type"), F.array().cast("array<string>").alias("key_points"),
        F.col("w").alias("entities"), F.when(i % 2 == 0, F.array("kind", F.lit("Frame"), F.lit(" frame "))).otherwise(F.array().cast("array<string>")).alias("visual_elements"), objects.alias("objects"),
    )


_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_RICH = rf"""wl AS (SELECT *, list_transform(list_filter(string_split(body, ' '), lambda w: length(w) >= 6), lambda w: lower(w)) AS ws FROM ast), wd AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w FROM wl),
  ob AS (SELECT *, page_id % 4 = 0 AS top, page_id % 5 = 0 AS boxed, CASE WHEN page_id % 3 = 0 THEN 'Summary of ' || caption END AS summary FROM wd),
  ph AS (SELECT *, CASE WHEN w[1] IS NOT NULL THEN w[1] || CASE WHEN coalesce(w[2], w[3], CASE WHEN top THEN 'top' END, CASE WHEN boxed THEN 'b' END) IS NULL THEN '' ELSE ': ' || concat_ws(', ', w[2], w[3], CASE WHEN top THEN 'top' WHEN boxed THEN 'upper left' END) END END AS p1 FROM ob),
  rw AS (SELECT *, list_filter([trim(coalesce(caption, '')), trim(body), trim(coalesce(summary, '')), 'Page type: ' || kind, CASE WHEN len(w) > 0 THEN 'Entities: ' || array_to_string(w[1:8], '; ') ELSE '' END, CASE WHEN page_id % 2 = 0 THEN 'Visual elements: ' || kind || '; Frame' ELSE '' END,
         'Objects: ' || concat_ws('; ', p1, kind || ': upper left')], lambda x: x <> '') AS raw FROM ph),
  tx AS (SELECT *, list_filter(raw, lambda x, i: list_position(list_transform(raw, lambda y: lower({_SQUEEZED.format('y')})), lower({_SQUEEZED.format('x')})) = i) AS parts FROM rw),
  cs AS (SELECT ch.*, section, CASE WHEN section IS NULL THEN '' ELSE 'Section: ' || section || chr(10) END || 'Page range: ' || page_start || '-' || page_end AS lead FROM ch JOIN ws USING (doc_id)),
  pr AS (SELECT tx.*, lk.chunk_id AS parent, coalesce(cs.lead, 'Page range: ' || page_no || '-' || page_no) AS lead, CASE kind WHEN 'chart' THEN 'figure' ELSE kind END AS ckind FROM tx LEFT JOIN (SELECT * FROM lk WHERE ord % 7 <> 0) lk ON tx.asset_id = lk.asset_id LEFT JOIN cs ON lk.chunk_id = cs.chunk_id)"""
_SAID = f"{PACKAGE}, {_SECTIONS}, {_RICH}"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with their section, and links of which every seventh is missing."""
    c = chunks(spark, sf_dir).drop("source_id", "parent_id").withColumn("kind", F.lit("text"))
    return L.with_section(c.withColumn("page_no", F.col("page_start")), sections(spark, sf_dir)).drop("page_no"), links(spark, sf_dir).where("ord % 7 <> 0")


@query(f"WITH {_SAID} SELECT asset_id, CAST(len(parts) AS INTEGER) AS n, md5(array_to_string(parts, chr(10))) AS text FROM tx")
def b20_asset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich(spark, sf_dir).select("asset_id", F.size(R.asset_parts()).alias("n"), F.md5(R.asset_text()).alias("text"))


@query(rf"""WITH {_SAID}, b AS (SELECT chunk_id, {_SQUEEZED.format("'- ' || kind || ' page ' || page_no || ': ' || array_to_string(parts, ' ')")} AS t FROM lk JOIN tx USING (asset_id))
    SELECT chunk_id, CASE WHEN length(t) <= 700 THEN t ELSE rtrim(substr(t, 1, 699)) || '...' END AS context FROM b""")
def k03_visual_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.visual_context(links(spark, sf_dir).select("chunk_id", "asset_id", F.lit(0).alias("pos")), rich(spark, sf_dir))


@query(f"WITH {_SAID} SELECT substr(sha256(coalesce(parent, 'unlinked') || ':visual:' || asset_id), 1, 20) AS chunk_id, asset_id, ckind AS kind, parent IS NULL AS unlinked, md5(lead || chr(10) || 'Visual asset kind: ' || kind || chr(10) || 'Asset page: ' || page_no || chr(10) || array_to_string(parts, chr(10))) AS text FROM pr")
def k04_asset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.asset_chunks(rich(spark, sf_dir), *_placed(spark, sf_dir)).select("chunk_id", "asset_id", "kind", "unlinked", F.md5("text").alias("text"))


@query(f"WITH {_SAID} SELECT count(*) AS chunks, count(DISTINCT asset_id) AS assets FROM pr WHERE parent IS NULL")
def e07_standalone_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.standalone(R.asset_chunks(rich(spark, sf_dir), *_placed(spark, sf_dir)))


_OBJECTS = f"""{_SAID}, o0 AS (SELECT pr.*, 0 AS ord0, w[1] AS label, '' AS feature, concat_ws(chr(10), 'Object: ' || w[1], 'Attributes: ' || w[2], 'Description: ' || w[3], CASE WHEN top THEN 'Location: top' END, CASE WHEN boxed THEN 'Bbox region: upper left' END, 'Source field: objects') AS head FROM pr WHERE w[1] IS NOT NULL
    UNION ALL SELECT pr.*, 1, kind, '', concat_ws(chr(10), 'Object: ' || kind, 'Bbox region: upper left', 'Source field: detections') FROM pr
    UNION ALL SELECT pr.*, 2 + i, CASE i WHEN 0 THEN kind ELSE 'Frame' END, 'visual_element', concat_ws(chr(10), 'Visual feature: ' || CASE i WHEN 0 THEN kind ELSE 'Frame' END, 'Feature type: visual_element', 'Source field: visual_elements') FROM pr, (VALUES (0), (1)) x(i) WHERE page_id % 2 = 0),
  o1 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord0) - 1 AS idx, concat_ws(chr(10), head, 'Page type: ' || kind, CASE WHEN caption <> '' THEN rtrim('Caption: ' || caption) END, rtrim('VLM summary: ' || summary)) AS otext FROM o0)"""


@query(f"WITH {_OBJECTS} SELECT asset_id || ':object:' || idx AS object_id, asset_id, CAST(idx AS INTEGER) AS object_index, label, feature, md5(otext) AS text FROM o1")
def k07_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.object_records(rich(spark, sf_dir)).select("object_id", "asset_id", "object_index", F.col("o.label").alias("label"), "feature", F.md5("text").alias("text"))


@query(f"WITH {_OBJECTS} SELECT substr(sha256(coalesce(parent, 'unlinked') || ':visual-object:' || asset_id || ':object:' || idx), 1, 20) AS chunk_id, asset_id, ckind AS kind, md5(lead || chr(10) || 'Visual object: ' || label || chr(10) || 'Visual asset kind: ' || kind || chr(10) || 'Asset page: ' || page_no || chr(10) || otext) AS text FROM o1")
def k05_object_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.object_chunks(R.object_records(rich(spark, sf_dir)), *_placed(spark, sf_dir)).select("chunk_id", "asset_id", "kind", F.md5("text").alias("text"))


@query(rf"""WITH {_SAID}, m AS (SELECT ch.chunk_id, CASE WHEN parts IS NULL THEN [text] ELSE list_concat([text], parts) END AS ps FROM ch LEFT JOIN lk USING (chunk_id) LEFT JOIN tx USING (asset_id)),
    q AS (SELECT chunk_id, ps, list_transform(ps, lambda y: {_SQUEEZED.format('y')}) AS ks FROM m)
    SELECT chunk_id, md5(array_to_string(list_filter(ps, lambda x, i: ks[i] <> '' AND list_position(ks, ks[i]) = i), chr(10))) AS text FROM q""")
def k09_lexical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_text(chunks(spark, sf_dir), links(spark, sf_dir).select("chunk_id", "asset_id", F.lit(0).alias("pos")), rich(spark, sf_dir)).select("chunk_id", F.md5("text").alias("text"))


@query()
def k02_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five chunking strategies over all pages: (strategy, kind, chunks, chars)."""
    f = R.strategies(*_package_chunks(spark, sf_dir))
    return f.groupBy("strategy", "kind").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def _package_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = written(C.page_chunks(pages(spark, sf_dir), sections(spark, sf_dir)))  # read several times
    a = rich(spark, sf_dir)
    at = p.select("chunk_id", "doc", F.col("page_start").alias("page_no"))
    k = a.where("page_id % 7 <> 0").join(at, ["doc", "page_no"]).select("chunk_id", F.col("page_id").alias("ord"), "asset_id")
    return p, a, k


@query()
def k06_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a, k = _package_chunks(spark, sf_dir)
    return R.hierarchy(R.contextualised(p), R.visual_context(k.select("chunk_id", "asset_id", F.lit(0).alias("pos")), a))


@query(rf"""WITH {_SAID}, pt AS (SELECT asset_id, unnest(parts) AS part FROM tx), nm AS (SELECT asset_id, part, lower({_SQUEEZED.format('part')}) AS p FROM pt), nc AS (SELECT chunk_id, lower({_SQUEEZED.format('text')}) AS t FROM ch),
    lp AS (SELECT asset_id, part, coalesce(max(CASE WHEN contains(t, p) OR length(p) > 80 AND contains(t, substr(p, 1, 80)) THEN 1 ELSE 0 END), 0) AS seen FROM nm LEFT JOIN lk USING (asset_id) LEFT JOIN nc USING (chunk_id) GROUP BY ALL)
    SELECT count(DISTINCT asset_id) AS assets, count(*) AS parts, CAST(sum(seen) AS BIGINT) AS covered, round(CAST(sum(seen) AS DOUBLE) / count(*), 6) AS part_coverage FROM lp""")
def e06_visual_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the assets' parts a linked chunk holds, or of a long part its opening, but for case and white space."""
    plain = lambda c: F.lower(text.squeeze_ws(F.col(c)))
    a = rich(spark, sf_dir).select("asset_id", F.explode(R.asset_parts()).alias("part")).withColumn("p", plain("part"))
    x = a.join(links(spark, sf_dir).select("asset_id", "chunk_id"), "asset_id", "left").join(chunks(spark, sf_dir).select("chunk_id", plain("text").alias("t")), "chunk_id", "left")
    holds = F.contains("t", F.col("p")) | ((F.length("p") > 80) & F.contains("t", F.left("p", F.lit(80))))
    s = x.groupBy("asset_id", "part").agg(F.coalesce(F.max(holds.cast("int")), F.lit(0)).alias("seen"))
    return s.agg(F.count_distinct("asset_id").alias("assets"), F.count("*").alias("parts"), F.sum("seen").alias("covered"), F.round(F.sum("seen") / F.count("*"), 6).alias("part_coverage"))


@query(f"WITH {PACKAGE} SELECT doc, count(*) AS pages, count(DISTINCT CASE WHEN doc_id IN (SELECT page_id FROM ast) THEN page_start END) AS covered, round(count(DISTINCT CASE WHEN doc_id IN (SELECT page_id FROM ast) THEN page_start END) / CAST(count(*) AS DOUBLE), 6) AS share FROM ch GROUP BY doc")
def e05_page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("doc", "page_no").distinct().groupBy("doc").agg(F.count("*").alias("covered"))
    p = pages(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("pages")).join(a, "doc", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return p.select("doc", "pages", "covered", F.round(F.col("covered") / F.col("pages"), 6).alias("share"))


@query(f"WITH {PACKAGE} SELECT kind, count(*) AS assets, count(DISTINCT doc) AS docs, CAST(sum(length(body)) AS BIGINT) AS chars, round(avg(length(caption)), 6) AS mean_caption FROM ast GROUP BY kind")
def e24_asset_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("assets"), F.count_distinct("doc").alias("docs"), F.sum(F.length("body")).alias("chars"), F.round(F.avg(F.length("caption")), 6).alias("mean_caption"))


@query(f"WITH {PACKAGE}, {ASSET_TRIPLES} SELECT 'pages' AS record, count(*) AS n FROM pg UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'assets', count(*) FROM ast UNION ALL SELECT 'triples', count(*) FROM atr UNION ALL SELECT 'links', count(*) FROM lk")
def e26_package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"pages": pages, "chunks": chunks, "assets": assets, "triples": asset_triples, "links": links}
    out = None
    for name, f in sets.items():
        n = f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(name).alias("record"), "n")
        out = n if out is None else out.unionByName(n)
    return out
