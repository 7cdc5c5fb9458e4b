"""Reading and writing packages: five tables in a folder, as Parquet or JSON lines, with a manifest of what is in them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.links import upsert


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line, blank lines skipped; a line that isn't one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page_start, page_end, ord, section) of a section map: JSON lines, a JSON list, or an object with the list under 'sections'; names nested under 'section' or flat."""
    part = "struct<chapter:string,section:string,subsection:string,issue:string>"
    row = "struct<doc:string,page_start:bigint,page_end:bigint,section:string,chapter:string,subsection:string,issue:string>"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    body = F.when(F.startswith("v", F.lit("[")), F.col("v")).when(F.get_json_object("v", "$.sections").isNotNull(), F.get_json_object("v", "$.sections")).otherwise(F.concat(F.lit("["), F.array_join(F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    flat = raw.select(F.posexplode(F.from_json(body, f"array<{row}>")).alias("ord", "r"))
    nested = F.from_json(F.col("r.section"), part)
    pick = lambda c: F.coalesce(nested[c], F.col(f"r.{c}") if c != "section" else F.when(~F.startswith(F.trim("r.section"), F.lit("{")), F.col("r.section")))
    return flat.select("r.doc", "r.page_start", "r.page_end", F.col("ord").cast("long").alias("ord"), F.concat_ws(" > ", *[F.nullif(pick(c), F.lit("")) for c in ("chapter", "section", "subsection", "issue")]).alias("section"))


@dataclass(frozen=True)
class Package:
    pages: DataFrame
    chunks: DataFrame
    assets: DataFrame
    links: DataFrame
    triples: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str, format: str = "parquet") -> "Package":
        return Package(*[spark.read.format(format).load(f"{path}/{f.name}") for f in fields(Package)])

    def write(self, path: str, format: str = "parquet", mode: str = "errorifexists") -> DataFrame:
        """Writes all tables and the manifest; what was there under other names is left. Returns the manifest."""
        spark = self.pages.sparkSession
        for f in fields(self):
            getattr(self, f.name).write.format(format).mode(mode).save(f"{path}/{f.name}")
        manifest = summary(spark, path, format)
        manifest.write.mode("overwrite").json(f"{path}/manifest")
        return spark.read.schema(manifest.schema).json(f"{path}/manifest")

    def refreshed(self, **new: DataFrame) -> "Package":
        """With rows replaced by key: chunks=..., assets=... and so on."""
        key = {"pages": ["doc", "page_no"], "chunks": ["chunk_id"], "assets": ["asset_id"], "links": ["chunk_id", "asset_id"], "triples": ["triple_id"]}
        return Package(**{f.name: upsert(getattr(self, f.name), new[f.name], key[f.name]) if f.name in new else getattr(self, f.name) for f in fields(self)})


def summary(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(record, rows) of a written package."""
    out = None
    for f in fields(Package):
        n = spark.read.format(format).load(f"{path}/{f.name}").agg(F.count("*").alias("rows")).select(F.lit(f.name).alias("record"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def clear(spark: SparkSession, path: str, names: list[str]) -> None:
    """Deletes stale tables of a package."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for n in names:
        p = hadoop(f"{path}/{n}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_vectors(records: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Vector records by vector name; returns a manifest (vector_name, records, dim, dims, ids): dims, how many sizes its vectors have, which should be 1; ids, the SHA-256 over the sorted digests of the ids' SHA-256 by first byte, so that no task sorts all of them."""
    records.write.mode(mode).partitionBy("vector_name").parquet(path)
    back = records.sparkSession.read.parquet(path)
    counts = back.groupBy("vector_name").agg(F.count("*").alias("records"), F.max(F.size("vector")).alias("dim"), F.count_distinct(F.size("vector")).alias("dims"))
    named = back.select("vector_name", F.sha2(F.col("target_id").cast("string"), 256).alias("h"))
    # how often each id occurs counts too; a digest is built up from slices of the hashes' order, each sorted by itself
    once = named.groupBy("vector_name", "h").agg(F.count("*").alias("n"))
    for width in (4, 2, 0):
        once = once.groupBy("vector_name", F.left("h", F.lit(width)).alias("slice")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "h", F.col("n").cast("string")))), "\n"), 256).alias("digest"))
        once = once.select("vector_name", F.concat("slice", "digest").alias("h"), F.lit(1).alias("n"))
    return counts.join(once.select("vector_name", F.col("h").alias("ids")), "vector_name")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256, lines) of the files under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit("\n")).alias("lines"))


BLOCKED = (".env", ".pem", ".key", ".p12", ".sqlite", ".safetensors")


def file_audit(spark: SparkSession, path: str, terms: list[str], *, glob: str = "*", most: int = 5_000_000, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(path, issue): files of a blocked kind, too large, or with one of the terms in them, letter case aside."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.lower(F.decode("content", "ISO-8859-1"))
    kinds = [F.when(F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.endswith(F.lower("path"), b)), F.lit("blocked kind")), F.when(F.col("length") > most, F.lit("too large"))]
    kinds += [F.when((F.col("length") <= most) & F.contains(text, F.lit(t.encode().decode("latin-1").lower())), F.lit(f"term: {t}")) for t in terms]
    return f.select("path", F.explode(F.array_compact(F.array(*kinds))).alias("issue"))


def documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(doc_id, name, title, text) of a folder of texts; the title is the first line, else the name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode("content", "utf-8")
    first = F.trim(F.element_at(F.split(text, "\n"), 1))
    return f.select(F.left(F.sha2(F.concat(F.encode(name, "utf-8"), F.col("content")), 256), F.lit(16)).alias("doc_id"), name.alias("name"), F.when(first != "", first).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), text.alias("text"))
