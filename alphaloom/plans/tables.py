"""Panels derived from the star-schema tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.panel import Panel

DAY_STEP = 2**40  # above any price in cents


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trade_bars(spark: SparkSession, folder: str) -> Panel:
    """Weekly bars per brand from line items.

    Every aggregate has a map-side partial with a fixed-width buffer, so the job is
    one hash aggregation and a brand or week with a third of all trades shuffles
    only its partial bars.  Prices average in whole cents, which sums exactly in any
    order.  The open is the lowest price of the first day traded, packed with the day
    into one number so that its minimum is a plain aggregate too.
    """
    day = F.col("l_shipdate").cast("date")  # day arithmetic is integer arithmetic
    trades = table(spark, folder, "lineitem").select(
        "l_partkey", "l_extendedprice", "l_quantity",
        F.date_sub(day, F.weekday(day)).alias("ts"), F.weekday(day).alias("weekday"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"),
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    bars = (
        trades.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("asset", "ts")
        .agg(
            F.min(F.col("weekday") * F.lit(DAY_STEP) + F.col("cents")).alias("first"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            (F.sum("cents") / F.count("cents") / 100.0).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .withColumn("open", F.col("first") % F.lit(DAY_STEP) / 100.0)
        .drop("first")
    )
    return Panel(bars, keys=("asset",), ts="ts", grain="week")


def industries(spark: SparkSession, folder: str) -> DataFrame:
    """A label per brand: the first part type in the alphabet among its parts."""
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("asset")).agg(
        F.min_by("p_type", "p_partkey").alias("industry")
    )


def hourly_ticks(spark: SparkSession, folder: str) -> Panel:
    """Hourly bars per event type from the event stream."""
    at = F.struct("ts", "event_id")
    bars = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("hour"))
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.count("*").alias("volume"),
        )
        .withColumnRenamed("hour", "ts")
    )
    return Panel(bars, keys=("asset",), ts="ts", grain="hour")
