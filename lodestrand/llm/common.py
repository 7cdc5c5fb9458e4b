"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of a slice stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trim() -> None:
    """Gives freed memory back: Python workers live on from task to task, and what one task needed would stay with them."""
    pa.default_memory_pool().release_unused()
    libc = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if libc:
        libc(0)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, rows: int = ROWS) -> DataFrame:
    """each() over slices of df's rows, JVM to Python and back in Arrow batches, one task per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = each(b)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: set for the input's size by whoever runs the query."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text for a shard of its hashes, about.
SHARD_BYTES = 32 << 20


def shards(docs: DataFrame, each: int = SHARD_BYTES) -> int:
    """Shards for what is taken from the column text: by its bytes, counted, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(tasks(docs.sparkSession), -(-size // each))
