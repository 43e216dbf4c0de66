"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.core.lineage import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of `edges` (a, b): root is the smallest node reachable.

    Each step points nodes to the least neighbour and is written, so lineage stays short and
    lost executors cost one step. Hubs are combined before the shuffle by the running
    minimum; the join back is one that the adaptive planner can split."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        """Large: each node's larger neighbours go to its least one; small: the smaller ones and itself do."""
        if large:
            both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
        joined = both.join(least, F.col("a") == F.col("u"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (seen := state(now)) != before:
        before = seen
        if seen[0] == 0:
            break
        now = written(star(star(now, large=True), large=False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
