"""What is said of assets, objects and triples as text; chunks and vector records made of it.

assets: (asset_id, doc, page_no, kind, caption, ocr_text, vlm_summary, page_type, key_points, entities, visual_elements: arrays of strings, objects: array of OBJECT).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import kept, written
from ..functions.ids import sha_id
from ..functions.text import bbox_region, casefold, squeeze_ws, trim_ellipsis
from ..functions.vectors import hashed_vector
from .chunks import split_chunks

OBJECT = "struct<label:string,attributes:array<string>,description:string,location:string,bbox:array<double>,bbox_region:string,confidence:double,source_key:string>"
#: Items of one kind that an asset's text names, and objects of an asset that become records, at most.
ITEMS, ATTRIBUTES, OBJECTS = 8, 6, 32
_STRINGS = "array<string>"
_BLANKS = " \t\n\r\f\x0b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _plain(c: Column) -> Column:
    return squeeze_ws(F.coalesce(c, F.lit("")))


def _first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items of an array of strings whose key none before them has. For short arrays; items and keys are evaluated once."""
    pairs = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(pairs, none, lambda acc, z: F.when(F.exists(acc, lambda y: y["k"] == z["k"]), acc).otherwise(F.array_append(acc, z)))
    return F.transform(kept, lambda z: z["v"])


def distinct_items(items: Column, limit: int) -> Column:
    """The first `limit` items that differ in more than case and white space, which is squeezed. For short arrays."""
    tidy = F.filter(F.transform(F.coalesce(items, F.array().cast(_STRINGS)), _plain), lambda x: x != "")
    return F.slice(_first_of_each(tidy, casefold), 1, limit)


def kept_parts(parts: list[Column]) -> Column:
    """The parts that say something, each once but for case and white space, stripped, in order."""
    all_ = F.filter(F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    return _first_of_each(all_, lambda x: casefold(squeeze_ws(x)))


def _named(label: str, items: Column, sep: str = "; ") -> Column:
    return let(F.array_join(items, sep), lambda t: F.when(t != "", F.concat(F.lit(f"{label}: "), t)))


def _region(o: Column) -> Column:
    return F.coalesce(F.nullif(_plain(o["bbox_region"]), F.lit("")), bbox_region(o["bbox"]))


def object_phrase(o: Column) -> Column:
    """An object in one line: its label and what distinguishes it; its region only where no place is named."""
    one = lambda c: F.array_compact(F.array(F.nullif(_plain(c), F.lit(""))))
    where = F.when(_plain(o["location"]) == "", _region(o)).otherwise(o["location"])
    more = F.slice(F.array_union(F.array_union(distinct_items(o["attributes"], ATTRIBUTES), one(o["description"])), one(where)), 1, ATTRIBUTES)
    tail = let(F.array_join(more, ", "), lambda t: F.when(t != "", F.concat(F.lit(": "), t)).otherwise(""))
    return F.when(_plain(o["label"]) != "", F.concat(_plain(o["label"]), tail))


def asset_parts() -> Column:
    """All that an asset says, part by part: caption, text read off it, summary, then its named lists."""
    objects = distinct_items(F.array_compact(F.transform(F.coalesce("objects", F.array().cast(f"array<{OBJECT}>")), object_phrase)), ITEMS)
    lists = [_named("Key points", distinct_items(F.col("key_points"), ATTRIBUTES)), _named("Entities", distinct_items(F.col("entities"), ITEMS)), _named("Visual elements", distinct_items(F.col("visual_elements"), ITEMS)), _named("Objects", objects)]
    kind = F.when(_plain(F.col("page_type")) != "", F.concat(F.lit("Page type: "), _plain(F.col("page_type"))))
    return kept_parts([F.col("caption"), F.col("ocr_text"), F.col("vlm_summary"), kind, *lists])


def asset_text() -> Column:
    return F.array_join(asset_parts(), "\n")


def spoken(assets: DataFrame) -> DataFrame:
    """assets with all that each says as column said, a written table: what is made of many assets in many ways makes their texts once."""
    return assets if "said" in assets.columns else written(assets.withColumn("said", asset_text()))


def _said(assets: DataFrame) -> Column:
    return F.col("said") if "said" in assets.columns else asset_text()


def object_records(assets: DataFrame, cap: int = OBJECTS) -> DataFrame:
    """assets with one row for each object, and each visual element taken for one: (object_id, object_index, o, feature, text).

    Objects are the same if they agree, but for case and white space, in label, attributes, description, place, region, source and kind of feature, and in their box. Of an asset's, the first cap stay, in its order.
    """
    element = F.transform(F.coalesce("visual_elements", F.array().cast(_STRINGS)), lambda x: F.struct(F.struct(x.alias("label"), F.lit(None).cast(_STRINGS).alias("attributes"), *[F.lit(None).cast("string").alias(c) for c in ("description", "location")], F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("bbox_region"), F.lit(None).cast("double").alias("confidence"), F.lit("visual_elements").alias("source_key")).cast(OBJECT).alias("o"), F.lit("visual_element").alias("feature")))
    own = F.transform(F.coalesce("objects", F.array().cast(f"array<{OBJECT}>")), lambda x: F.struct(x.cast(OBJECT).alias("o"), F.lit("").alias("feature")))

    def key(x: Column) -> Column:
        o = x["o"]
        low = lambda c: casefold(_plain(c))
        parts = [low(o["label"]), casefold(F.array_join(distinct_items(o["attributes"], ATTRIBUTES), "\x1f")), low(o["description"]), low(o["location"]), low(_region(o)), low(o["source_key"]), x["feature"], F.coalesce(F.to_json(o["bbox"]), F.lit(""))]
        return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\x1e")

    shape = f"struct<k:string,v:struct<o:{OBJECT},feature:string>>"
    named = F.filter(F.concat(own, element), lambda x: _plain(x["o"]["label"]) != "")
    pairs = F.transform(named, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    kept = F.aggregate(pairs, F.array().cast(f"array<{shape}>"), lambda acc, z: F.when(F.exists(acc, lambda y: y["k"] == z["k"]), acc).otherwise(F.array_append(acc, z.cast(shape))))
    first = F.slice(F.transform(kept, lambda z: z["v"]), 1, cap)
    x = assets.select("*", F.posexplode(first).alias("object_index", "__x")).select(*assets.columns, "object_index", F.col("__x.o").alias("o"), F.col("__x.feature").alias("feature"))
    return x.select(F.concat_ws(":", F.col("asset_id"), F.lit("object"), F.col("object_index").cast("string")).alias("object_id"), "*", object_text().alias("text"))


def object_text() -> Column:
    """All that an object's record says, line by line: columns o, feature and the asset's."""
    o = F.col("o")
    line = lambda label, c: F.when(_plain(c) != "", F.concat(F.lit(f"{label}: "), _plain(c)))
    attributes = distinct_items(o["attributes"], ATTRIBUTES)
    told = F.when(~F.exists(attributes, lambda x: x == _plain(o["description"])), o["description"])
    region = F.when(~F.coalesce(_region(o), F.lit("")).eqNullSafe(_plain(o["location"])), _region(o))
    return F.array_join(kept_parts([
        F.concat(F.when(F.col("feature") != "", "Visual feature: ").otherwise("Object: "), _plain(o["label"])), line("Feature type", F.col("feature")), _named("Attributes", attributes), line("Description", told), line("Location", o["location"]),
        line("Bbox region", region), line("Source field", o["source_key"]), line("Page type", F.col("page_type")),
        F.when(F.col("caption") != "", F.concat(F.lit("Caption: "), F.col("caption"))), F.when(F.col("vlm_summary") != "", F.concat(F.lit("VLM summary: "), F.col("vlm_summary"))),
    ]), "\n")


def prefix(section: Column, first: Column, last: Column) -> Column:
    return F.concat(F.when(_plain(section) != "", F.concat(F.lit("Section: "), section, F.lit("\n"))).otherwise(""), F.lit("Page range: "), first.cast("string"), F.lit("-"), last.cast("string"))


def contextualised(chunks: DataFrame) -> DataFrame:
    """chunks(text, section, page_start, page_end) whose texts begin with their section and pages, once."""
    p = prefix(F.col("section"), F.col("page_start"), F.col("page_end"))
    return chunks.withColumn("text", F.when(F.startswith("text", p), F.col("text")).otherwise(F.btrim(F.concat(p, F.lit("\n"), "text"), F.lit(_BLANKS))))


def visual_context(links: DataFrame, assets: DataFrame, limit: int = 700) -> DataFrame:
    """(chunk_id, context): a line for each linked asset that says something, in order of pos, cut at limit characters. links(chunk_id, asset_id, pos)."""
    # of a chunk's lines only what fits is told: no more than the first limit + 2 characters of each line count
    head = F.concat(F.lit("- "), "kind", F.lit(" page "), F.col("page_no").cast("string"), F.lit(": "))
    short = assets.select("asset_id", let(_said(assets), lambda t: F.when(t != "", F.left(squeeze_ws(F.concat(head, t)), F.lit(limit + 2)))).alias("line")).where("line is not null")
    x = links.join(short, "asset_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "asset_id", "line"))).alias("ls"))
    return x.select("chunk_id", trim_ellipsis(F.array_join(F.transform("ls", lambda s: s["line"]), " "), limit).alias("context"))


def with_context(chunks: DataFrame, context: DataFrame, sep: str = "\n\n") -> DataFrame:
    """chunks with what is seen on them at the end of their text, unless it is in it."""
    block = F.concat(F.lit("Visual context:\n"), "context")
    text = F.when(F.col("context").isNull() | (F.col("context") == "") | F.contains("text", block), F.col("text")).otherwise(F.concat(F.rtrim("text"), F.lit(sep), block))
    return chunks.join(context, "chunk_id", "left").withColumn("text", text).drop("context")


def _kind() -> Column:
    return F.when(F.col("kind").isin("table", "map", "figure"), F.col("kind")).when(F.col("kind") == "chart", "figure").otherwise("page_summary")


def _under(assets: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """assets with the first chunk, by its order, that links each: (parent_id, parent_doc, lead)."""
    first = links.groupBy("asset_id").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("parent_id"))
    c = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("doc").alias("parent_doc"), prefix(F.col("section"), F.col("page_start"), F.col("page_end")).alias("parent_lead"))
    at = assets.join(first, "asset_id", "left").join(c, "parent_id", "left")
    return at.withColumn("lead", F.coalesce("parent_lead", prefix(F.lit(""), F.col("page_no"), F.col("page_no"))))


def _visual(rows: DataFrame, ident: Column, title: Column) -> DataFrame:
    text = F.concat_ws("\n", "lead", title, F.concat(F.lit("Visual asset kind: "), "kind"), F.concat(F.lit("Asset page: "), F.col("page_no").cast("string")), "said")
    return rows.where("said <> ''").select(ident.alias("chunk_id"), F.coalesce("parent_doc", "doc").alias("doc"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), _kind().alias("kind"), text.alias("text"), "asset_id", F.col("parent_id").isNull().alias("unlinked"))


def asset_chunks(assets: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """A chunk for each asset that says something: (chunk_id, doc, page_start, page_end, kind, text, asset_id, unlinked). links(chunk_id, ord, asset_id)."""
    at = _under(assets.withColumn("said", _said(assets)), chunks, links)
    return _visual(at, sha_id(20, F.coalesce("parent_id", F.lit("unlinked")), F.lit("visual"), F.col("asset_id")), F.lit(None).cast("string"))


def object_chunks(objects: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """A chunk for each object, as asset_chunks() for each asset. objects: object_records()."""
    at = _under(objects, chunks, links).withColumn("said", F.col("text"))
    return _visual(at, sha_id(20, F.coalesce("parent_id", F.lit("unlinked")), F.lit("visual-object"), F.col("object_id")), F.concat(F.lit("Visual object: "), _plain(F.col("o.label"))))


def hierarchy(chunks: DataFrame, context: DataFrame, limit: int = 900, pieces: DataFrame | None = None, **split: int) -> DataFrame:
    """Parents, each chunk's text cut at limit characters with what is seen on it, and their children, the pieces of text and context, made here if not given: (chunk_id, parent_id, role, kind, doc, page_start, page_end, text, section)."""
    pid = sha_id(20, F.col("chunk_id"), F.lit("hierarchical"), F.lit("parent"))
    cols = ("kind", "doc", "page_start", "page_end", "text", "section")
    short = chunks.withColumn("text", trim_ellipsis(F.col("text"), limit))
    parents = with_context(short, context).withColumn("kind", F.when(F.col("kind") == "text", "page_summary").otherwise(F.col("kind")))
    parents = parents.select(pid.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("role"), *cols)
    pieces = split_chunks(with_context(chunks, context), **split) if pieces is None else pieces
    source = F.coalesce("parent_id", "chunk_id")
    kids = pieces.select(sha_id(20, source, F.lit("hierarchical"), F.lit("child"), F.coalesce("idx", F.lit(0))).alias("chunk_id"), sha_id(20, source, F.lit("hierarchical"), F.lit("parent")).alias("parent_id"), F.lit("child").alias("role"), *cols)
    return parents.unionByName(kids)


def both_splits(chunks: DataFrame, context: DataFrame, **split: int) -> tuple[DataFrame, DataFrame]:
    """split_chunks() of chunks, and of chunks with what is seen on them: a written table of both, in which a text that has nothing more is split once."""
    x = with_context(chunks.withColumn("__plain", F.col("text")), context)
    same = F.col("text").eqNullSafe(F.col("__plain"))
    texts = F.when(same, F.array(F.struct(F.lit("both").alias("of"), F.col("text").alias("text")))).otherwise(F.array(F.struct(F.lit("plain").alias("of"), F.col("__plain").alias("text")), F.struct(F.lit("seen").alias("of"), F.col("text").alias("text"))))
    x = x.select(*[c for c in chunks.columns if c != "text"], F.explode(texts).alias("__x")).select(*[c for c in chunks.columns if c != "text"], F.col("__x.text").alias("text"), F.col("__x.of").alias("__of"))
    pieces = written(split_chunks(x, **split))
    return tuple(pieces.where(F.col("__of").isin("both", of)).drop("__of") for of in ("plain", "seen"))


def strategies(chunks: DataFrame, assets: DataFrame, links: DataFrame, **split: int) -> DataFrame:
    """Every strategy's chunks in one table: (strategy, chunk_id, doc, page_start, page_end, kind, text).

    page: chunks with their prefix. semantic: these split. multimodal: split with what is seen on them, and the assets' chunks. object_aware: that and the objects' chunks.
    hierarchical: parents and children, and the chunks of assets that no chunk links. chunks(chunk_id, doc, page_start, page_end, kind, text, section), links(chunk_id, ord, asset_id).
    """
    chunks, links, assets = kept(chunks), written(links), spoken(assets)  # each is read by several strategies
    lead = contextualised(chunks)
    context = written(visual_context(links.select("chunk_id", "asset_id", F.lit(0).alias("pos")), assets))
    plain, seen = both_splits(lead, context, **split)
    visual, objects = written(asset_chunks(assets, chunks, links)), object_chunks(object_records(assets), chunks, links)
    parts = {"page": [lead], "semantic": [plain], "multimodal": [seen, visual], "object_aware": [seen, visual, objects], "hierarchical": [hierarchy(lead, context, pieces=seen), visual.where("unlinked")]}
    out = None
    for name, own in parts.items():
        for p in own:
            q = p.select(F.lit(name).alias("strategy"), "chunk_id", "doc", "page_start", "page_end", "kind", "text")
            out = q if out is None else out.unionByName(q)
    return out


def triple_text() -> Column:
    """A triple with its qualifiers as text: columns subject, predicate, object, evidence, attributes, description, location, bbox, bbox_region, source_field, source_key."""
    attributes = distinct_items(F.col("attributes"), ATTRIBUTES)
    say = lambda label, c: F.when(_plain(c) != "", F.concat(F.lit(f"{label} "), _plain(c)))
    region = F.coalesce(F.nullif(_plain(F.col("bbox_region")), F.lit("")), bbox_region(F.col("bbox")))
    parts = [F.col("subject"), F.replace(F.col("predicate"), F.lit("_"), F.lit(" ")), F.col("object"), say("evidence", F.col("evidence")), F.when(F.size(attributes) > 0, F.concat(F.lit("attributes "), F.array_join(attributes, " "))),
             say("description", F.when(~F.array_contains(attributes, _plain(F.col("description"))), F.col("description"))), say("location", F.col("location")), F.when(_plain(F.col("location")) == "", say("bbox region", region)),
             say("source field", F.col("source_field")), F.when(_plain(F.col("source_key")) != _plain(F.col("source_field")), say("source key", F.col("source_key")))]
    return F.array_join(F.filter(F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: F.trim(x)), lambda x: x != ""), " ")


def vector_records(rows: DataFrame, name: str, key: str, dim: int = 384) -> DataFrame:
    """(vector_name, target_kind, target_id, chunk_id, doc, text, vector): hashed vectors of rows(key, kind, chunk_id, doc, text). Rows of empty text have none."""
    return rows.where("trim(text) <> ''").select(F.lit(name).alias("vector_name"), F.col("kind").alias("target_kind"), F.col(key).cast("string").alias("target_id"), F.col("chunk_id"), F.col("doc"), F.col("text"), hashed_vector(F.col("text"), dim).alias("vector"))


def record_sets(chunks: DataFrame, assets: DataFrame, links: DataFrame, triples: DataFrame, images: DataFrame | None = None, dim: int = 384) -> DataFrame:
    """The five sets of vector records: text_dense of chunks, caption_dense of assets, object_dense of objects, triple_dense of triples, image_dense as given in images(asset_id, vector).

    A record's chunk_id is its chunk, the asset's id where it is an asset, and for triples the first chunk that they are of. triples(triple_id, chunk_id, doc, and the columns of triple_text()).
    """
    assets = spoken(assets)
    text = vector_records(chunks.select("chunk_id", "kind", "doc", "text"), "text_dense", "chunk_id", dim)
    said = assets.select("asset_id", "kind", "doc", F.col("said").alias("text"), F.col("asset_id").alias("chunk_id"))
    objects = object_records(assets).select("object_id", F.lit("visual_object").alias("kind"), "doc", "text", F.col("asset_id").alias("chunk_id"))
    told = triples.select("triple_id", F.lit("graph_triple").alias("kind"), "doc", "chunk_id", triple_text().alias("text"))
    out = text.unionByName(vector_records(said, "caption_dense", "asset_id", dim)).unionByName(vector_records(objects, "object_dense", "object_id", dim)).unionByName(vector_records(told, "triple_dense", "triple_id", dim))
    if images is None:
        return out
    i = images.join(assets.select("asset_id", "kind", "doc"), "asset_id").select(F.lit("image_dense").alias("vector_name"), F.col("kind").alias("target_kind"), F.col("asset_id").alias("target_id"), F.col("asset_id").alias("chunk_id"), "doc", F.lit(None).cast("string").alias("text"), F.col("vector").cast("array<double>").alias("vector"))
    return out.unionByName(i)



def lexical_text(chunks: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """(chunk_id, text): what the lexical index reads of a chunk, its own text and the parts of its assets in order of pos, each once but for white space. links(chunk_id, asset_id, pos)."""
    more = links.join(assets.select("asset_id", asset_parts().alias("parts")), "asset_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "asset_id", "parts"))).alias("ps"))
    parts = F.concat(F.array(F.coalesce("text", F.lit(""))), F.flatten(F.transform(F.coalesce("ps", F.array().cast("array<struct<pos:int,asset_id:string,parts:array<string>>>")), lambda p: p["parts"])))
    own = chunks.select("chunk_id", "text").join(more, "chunk_id", "left")
    tidy = F.filter(parts, lambda x: x.rlike(r"(?U)\S"))
    return own.select("chunk_id", F.array_join(_first_of_each(tidy, squeeze_ws), "\n").alias("text"))


def standalone(visual: DataFrame) -> DataFrame:
    """One row: chunks of assets that no chunk links, and how many assets these are. visual(asset_id, unlinked)."""
    return visual.where("unlinked").agg(F.count("*").alias("chunks"), F.count_distinct("asset_id").alias("assets"))
