"""Connected components of an undirected graph, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import drop_written, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, component being the smallest node of it: a written table.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until nothing changes, in about log(nodes) rounds; each
    round is written to the shared folder, so the plan stays short and lost executors cost one round at most. Edges with a null end
    are ignored; self-loops give a component of one node.
    """
    nodes = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    alone = nodes.where("u = v").select("u").distinct()
    now = written(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.withColumn("m", F.min("v").over(w))
        small = m.select("u", F.col("m").alias("v")).union(m.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(small)
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if tuple(new) == sign:
            break
        sign = tuple(new)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    lone = alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(own.select("node"), "node", "left_anti")
    return written(own.union(lone).distinct())
