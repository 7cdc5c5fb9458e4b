"""The graph of triples: normal form, duplicates, degrees, audit, section and derived triples."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id, sha_id
from ..functions.text import confidence, normalise_entity, normalise_predicate, ratio, section_label

#: Predicates that say nothing of their own.
EMPTY_PREDICATES = tuple("a 가 과 는 등 및 에 와 은 의 이 is or of to in on at by be an and are for the from with".split())


def norm_entity(label: Column) -> Column:
    """normalise_entity() of the NFKC form, for which there is no built-in function; labels of ASCII letters alone are spared the way through Python."""

    def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    nfkc.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    wide = label.rlike(r"[^\x00-\x7F]")
    return normalise_entity(F.when(wide, F.pandas_udf(nfkc, "string")(F.when(wide, label))).otherwise(label))


def norm_predicate(label: Column) -> Column:
    return normalise_predicate(norm_entity(label))


def spo_key() -> Column:
    """What makes two triples say the same."""
    return F.struct(F.lower(norm_entity(F.col("subject"))).alias("s"), norm_predicate(F.col("predicate")).alias("p"), F.lower(norm_entity(F.col("object"))).alias("o"))


def dedupe(triples: DataFrame) -> DataFrame:
    """One triple for each meaning in a chunk: the most confident (none counts as -1), the first by triple_id on ties; with how many there were."""
    best = F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.col("triple_id"))
    own = triples.withColumn("spo", spo_key())
    return own.groupBy("chunk_id", "spo").agg(F.min_by(F.struct(*triples.columns), best).alias("t"), F.count("*").alias("copies")).select("t.*", "copies")


def normalised(triples: DataFrame) -> DataFrame:
    """Labels and predicates in normal form, triple_id made of them; triples with an empty part or an empty predicate go; then one of each meaning in a chunk is kept."""
    n = triples.withColumns({"subject": norm_entity(F.col("subject")), "predicate": norm_predicate(F.col("predicate")), "object": norm_entity(F.col("object")), "confidence": confidence(F.col("confidence"))})
    own = n.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("predicate") != "") & ~F.col("predicate").isin(*EMPTY_PREDICATES))
    return dedupe(own.withColumn("triple_id", sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object"))))


def degrees(triples: DataFrame) -> DataFrame:
    """(node_id, label, out_degree, in_degree, degree, chunks, predicates) of every end; a loop counts twice. Nodes are the same if their trimmed lower-case labels are; the smallest label is shown."""
    end = lambda c, out: triples.select(F.col(c).alias("label"), F.lit(out).alias("out"), "predicate", "chunk_id")
    both = end("subject", 1).unionByName(end("object", 0)).where("trim(label) <> ''")
    return both.groupBy(node_id(F.col("label")).alias("node_id")).agg(
        F.min("label").alias("label"), F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"), F.count("*").alias("degree"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("predicate").alias("predicates")
    )


def top_nodes(triples: DataFrame, n: int) -> DataFrame:
    return degrees(triples).orderBy(F.desc("degree"), F.lower("label"), "node_id").limit(n)


def summary(triples: DataFrame) -> DataFrame:
    """One row: triples, nodes, predicates, mean degree."""
    t = triples.agg(F.count("*").alias("triples"), F.count_distinct("predicate").alias("predicates"))
    d = degrees(triples).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))
    return t.crossJoin(d)


def audit(triples: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """One row of counts: duplicates, empty parts, orphans, invalid confidences, empty predicates, what normal form would change."""
    copies = triples.groupBy("chunk_id", spo_key().alias("spo")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    orphans = triples.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti").agg(F.count("*").alias("orphans"))
    yes = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    empty = (F.trim("subject") == "") | (F.trim("predicate") == "") | (F.trim("object") == "")
    changed = (norm_entity(F.col("subject")) != F.col("subject")) | (norm_predicate(F.col("predicate")) != F.col("predicate")) | (norm_entity(F.col("object")) != F.col("object"))
    own = triples.agg(F.count("*").alias("triples"), yes(empty, "empty"), yes((F.col("confidence") < 0) | (F.col("confidence") > 1), "bad_confidence"), yes(norm_predicate(F.col("predicate")).isin(*EMPTY_PREDICATES), "empty_predicates"), yes(changed, "changed"))
    return own.crossJoin(copies).crossJoin(orphans)  # one row each


def section_triples(chunks: DataFrame) -> DataFrame:
    """A chunk's place in its document as triples, each once: the document has its chapter, the chapter (else the document) its issue, the chunk its section. chunks(chunk_id, doc, section: struct<chapter, section, subsection, issue>)."""
    part = lambda name: F.nullif(F.trim(F.coalesce(F.col(f"section.{name}"), F.lit(""))), F.lit(""))
    row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    rows = F.array(row(F.col("doc"), "includes_chapter", part("chapter")), row(F.coalesce(part("chapter"), "doc"), "includes_issue", part("issue")), row(F.col("chunk_id"), "belongs_to_section", section_label(F.col("section"))))
    t = chunks.select("chunk_id", "doc", F.explode(rows).alias("t")).select("chunk_id", "doc", "t.*").where("object <> ''")
    named = t.select(sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object")).alias("triple_id"), "*", F.lit(0.75).alias("confidence"))
    return named.dropDuplicates(["triple_id"])


def triples_from_json(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Triples that a model gave as JSON objects: (triple_id, doc, chunk_id, subject, predicate, object, confidence, qualifiers). found(chunk_id, body), chunks(chunk_id, doc).

    Those that lack a part go; confidence is clamped to 0..1, null where it is no number; every other field is a qualifier, as a map of strings.
    """
    fields = F.from_json("body", "map<string,string>")
    get = lambda name: F.trim(F.coalesce(F.col("m")[name], F.lit("")))
    t = found.select("chunk_id", fields.alias("m")).where("m is not null").select("chunk_id", get("subject").alias("subject"), get("predicate").alias("predicate"), get("object").alias("object"), confidence(F.col("m")["confidence"]).alias("confidence"), F.map_filter("m", lambda k, v: ~k.isin("subject", "predicate", "object", "confidence")).alias("qualifiers"))
    own = t.where("subject <> '' and predicate <> '' and object <> ''").join(chunks.select("chunk_id", "doc"), "chunk_id")
    return own.select(sha_id(24, F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object")).alias("triple_id"), "doc", "chunk_id", "subject", "predicate", "object", "confidence", "qualifiers")


#: Predicate and confidence of what is read off an asset.
DERIVED = (("mentions_entity", "entities", 0.62), ("contains_visual_element", "elements", 0.58), ("contains_object", "objects", 0.6))


def derived_triples(assets: DataFrame, explicit: DataFrame, limit: int = 12) -> DataFrame:
    """Explicit triples of each asset and up to limit derived ones that say something else, in order of kind and place.

    assets(asset_id, chunk_id, caption, entities, elements, objects: arrays), explicit(asset_id, subject, predicate, object, confidence).
    """

    def read(k: int, predicate: str, column: str, sure: float) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.lit(predicate).alias("predicate"), x.alias("object"), F.lit(sure).alias("confidence")))

    kinds = [read(k, *d) for k, d in enumerate(DERIVED)]
    found = assets.select("asset_id", F.col("caption").alias("subject"), F.explode(F.concat(*kinds)).alias("d")).select("asset_id", "subject", "d.*").where("trim(object) <> ''")
    said = explicit.select(F.col("asset_id").alias("a"), spo_key().alias("said")).distinct()
    fresh = found.withColumn("spo", spo_key()).join(said, (F.col("asset_id") == F.col("a")) & (F.col("spo") == F.col("said")), "left_anti")
    one = fresh.withColumn("n", F.row_number().over(Window.partitionBy("asset_id", "spo").orderBy("kind", "i"))).where("n = 1")
    top = one.withColumn("n", F.row_number().over(Window.partitionBy("asset_id").orderBy("kind", "i"))).where(F.col("n") <= limit)
    cols = ("asset_id", "subject", "predicate", "object", "confidence")
    return explicit.select(*cols).unionByName(top.select(*cols))


def coverage(derived: DataFrame, present: DataFrame) -> DataFrame:
    """One row: how many derived triples the package has, by meaning."""
    d = derived.select(spo_key().alias("spo")).distinct()
    missing = d.join(present.select(spo_key().alias("spo")).distinct(), "spo", "left_anti").agg(F.count("*").alias("missing"))
    return d.agg(F.count("*").alias("expected")).crossJoin(missing).withColumn("coverage", 1 - ratio(F.col("missing"), F.col("expected")))


def export(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a graph viewer."""
    edges = triples.select(node_id(F.col("subject")).alias("source"), node_id(F.col("object")).alias("target"), "predicate", "triple_id", "confidence")
    return degrees(triples), edges
