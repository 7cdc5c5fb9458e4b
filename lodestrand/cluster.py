"""What operators need from the cluster: a shared folder, written tables, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have for a broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: spark.checkpoint.dir. Only where that is unset (local tests) one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: set[tuple] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def written(df: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor. Deleted as the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrand-tables/{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)
    _written.add((spark, path))
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    out._lodestrand_written = True
    return out


def kept(df: DataFrame) -> DataFrame:
    """df itself if it is a table of written(), else written."""
    return df if getattr(df, "_lodestrand_written", False) else written(df)


def drop_written(*dfs: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in dfs:
        for f in df.inputFiles()[:1]:
            for spark, path in list(_written):
                if path.split("://", 1)[-1].lstrip("/") in f:
                    _remove(spark, path)
                    _written.discard((spark, path))


def sized(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, hinted for broadcast if its rows at row_bytes each stay within limit; else as it is, to be joined by shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """df in two: the rows whose key no other row has, and the others, None if there are none. Only keys are shuffled where they are all different; null counts as a key."""
    more = written(df.groupBy(F.col(key).alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"))
    if not more.take(1):
        return df, None
    at = sized(more, 64)
    same = F.col(key).eqNullSafe(F.col("__again"))
    return df.join(at, same, "left_anti"), df.join(at, same, "left_semi")


#: Rows of an Arrow batch, at most: rows here are whole texts, of which 10,000 would fill a task's memory outside the heap.
ARROW_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, wherever they run, once for each application, and bounds the session's Arrow batches."""
    import zipfile
    from pathlib import Path

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:  # the driver's own, only until Spark has taken the file to serve it
        name = Path(d) / "lodestrand-package.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        served = f"{shared_dir(spark)}/lodestrand-tables/{uuid.uuid4().hex}.zip"
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(served)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(hadoop.Path(str(name)), path)
    sc.addPyFile(served)
    _shipped.add(sc.applicationId)
