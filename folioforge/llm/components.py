"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``edges(a, b)``.

    Each round only aggregates and joins on a node, and what it keeps is written to the shared folder: no group is
    held by a task or the driver, and the driver sees a count and a checksum.

    Edges with a null end and loops are ignored, so a node that has nothing else is not in the result.  Repeated edges and
    both directions of an edge count once.  The least node is unique, so there are no ties.  No edges: no rows.  Extra
    columns are ignored.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (new := _mark(after)) == mark:
            break
        now, mark = after, new
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
