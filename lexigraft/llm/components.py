"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of an edge of (u, v) with two different ends; comp is its smallest node.

    Each step links the larger neighbours of a node (large star), or the smaller ones and itself
    (small star), to the smallest it knows. Steps are written to the shared folder, as the next ones
    read them several times; a handful suffices even for long chains. Loops, nulls and repeated edges
    are ignored. No edges give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        at = scratch_path(spark, "components")
        df.write.parquet(at)
        return spark.read.parquet(at)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    comp = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comp.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
