"""Incremental ingest: new page files become chunks of a table as they arrive, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunks import page_chunks


def read_pages(spark: SparkSession, path: str, schema: StructType | str = "doc string, page_no long, text string, version long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def newest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ingest(pages: DataFrame, out: str, checkpoint: str, *, buckets: int = 64, once: bool = True) -> StreamingQuery:
    """Chunks of every page that arrives, in out/epoch=<batch>/bucket=<n>: a batch that runs again after a failure writes its own folder again, so each page counts once. current() reads the newest of each."""

    def save(batch: DataFrame, epoch: int) -> None:
        latest = newest(batch, ["doc", "page_no"], "version")
        c = page_chunks(latest).join(latest.select("doc", F.col("page_no").alias("page_start"), "version"), ["doc", "page_start"])
        c.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/epoch={epoch}")

    w = pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest chunk of every page: of equal versions the one that came last."""
    w = Window.partitionBy("doc", "page_start").orderBy(F.desc("version"), F.desc("epoch"))
    return spark.read.parquet(out).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "bucket", "epoch")
