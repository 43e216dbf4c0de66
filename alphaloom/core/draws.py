"""Random draws that depend on ids only.

Digests serve where a draw is made per row; where a task makes many draws at once they come
from counters by integer mixing (`mixed`), in numpy, or in SQL as plain 64-bit arithmetic.

`rand()` depends on how rows happen to be partitioned and changes when a lost
task is run again.  A digest of (seed, ids) gives the same draw on every run and
on every engine.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import col, join_groups

HEX_DIGITS = 10


def uniforms(n: int, seed: int, *ids: str | Column) -> list[Column]:
    """Up to three independent uniforms in [0, 1) from one digest of the ids."""
    if not 1 <= n <= 3:
        raise ValueError("one digest gives one to three draws")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))
    return [
        F.conv(F.substring(digest, 1 + HEX_DIGITS * i, HEX_DIGITS), 16, 10).cast("double")
        / float(16**HEX_DIGITS)
        for i in range(n)
    ]


# The steps of a published 32-bit integer mixer, both factors below 2^31, so that
# the products fit in 63 bits on every engine.
MIX_SHIFTS, MIX_FACTORS = (15, 12, 15), (0x2C1B3C6D, 0x297A2D39)
UNIT = float(2**32)


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit integers (held in 64 bits) to well-spread ones, one to one."""
    a, b, c = (np.uint64(k) for k in MIX_SHIFTS)
    low = np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> a)) * np.uint64(MIX_FACTORS[0]) & low
    x = (x ^ (x >> b)) * np.uint64(MIX_FACTORS[1]) & low
    return x ^ (x >> c)


def stream_base(seed: int, *ids: str | Column) -> Column:
    """32 bits of a digest of seed and ids: where the counters of a key begin, BIGINT."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def trial_draws(base: np.ndarray, trial: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (base, trial, item), broadcast: a number to sort by, and two uniforms in [0, 1)."""
    base, trial, item = (np.asarray(x).astype(np.uint64) for x in (base, trial, item))
    order = mixed(mixed(base ^ trial) ^ item)
    return order, mixed(order ^ np.uint64(1)) / UNIT, mixed(order ^ np.uint64(2)) / UNIT


def hash_order(
    df: DataFrame, by: list[str], name: str, seed: int, ids: list[str], *, small: bool = False
) -> DataFrame:
    """Zero-based position of each row of a group in the order of a digest of its ids:
    a random permutation, or a dense index to draw from.

    The leading digits of a digest are evenly spread and keep its order, so they cut
    any group into 256 buckets that are numbered by themselves; `small=True` (groups
    with a known bound) numbers each group in one window.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))
    # sixty bits sort as a number and keep the order of the text
    df = df.withColumn("_digest", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    if small:
        pos = F.row_number().over(Window.partitionBy(*by).orderBy("_digest")) - 1
        return df.withColumn(name, pos.cast("bigint")).drop("_digest")
    df = df.withColumn("_bucket", F.shiftright("_digest", 52))
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_c")).select(
        *by, "_bucket", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_below")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest")) - 1
    return (
        join_groups(df.withColumn("_in", inside), sizes, [*by, "_bucket"])
        .withColumn(name, (F.col("_below") + F.col("_in")).cast("bigint"))
        .drop("_digest", "_bucket", "_below", "_in")
    )


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread rows that are about to be multiplied over all shuffle partitions.

    A given number of partitions is kept by AQE, which would merge the still small
    input and so let a few tasks make all the copies.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
