"""Exact ranks and quantiles inside groups of any size, by one plan.

A rank window or an exact percentile over a group would send it to one task.  Instead equal
values collapse map-side and the distinct (group, value) rows are range-partitioned by group
and value, so that a group with a third of all rows lies in a third of the ranges.  Each
range is sorted by Spark and passes through its task in blocks of bounded size.  A block
counts its groups by itself and is written.  A group that ends inside its block is done; only
the first and the last group of a block can go on in a neighbour, so what earlier blocks hold
of them is a table of two rows per block.
NULL keys form a group like any other, and values keep their own type.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col, join_groups
from .lineage import written

FIRST, LAST = 1, 2  # bits of _edge: the group is the first or the last of its block
BLOCK = 1 << 16  # rows of a range that a task holds at a time


def _changes(a: pa.Array) -> np.ndarray:
    """Does each element differ from the one before it? NULL equals NULL, NaN equals NaN."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    differ = pc.fill_null(pc.not_equal(x, y), pc.xor(x.is_null(), y.is_null()))
    if pa.types.is_floating(a.type):
        nan = lambda z: pc.fill_null(pc.is_nan(z), False)
        differ = pc.and_not(differ, pc.and_(nan(x), nan(y)))
    return np.r_[True, differ.to_numpy(zero_copy_only=False)]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of at most `rows` rows."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            if n + part.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _count_range(keys: list[str], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts inside one sorted range, block by block; one block is held as Arrow columns at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in enumerate(_blocks(batches, rows)):
            n = t.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                new |= _changes(pa.concat_arrays(t.column(k).chunks))
            start = np.flatnonzero(new)
            weight = t.column("_w").to_numpy()
            upto = np.cumsum(weight)
            before = upto - weight
            sizes = np.diff(np.r_[start, n])
            total = upto[np.r_[start[1:] - 1, n - 1]] - before[start]
            edge = np.zeros(len(start), np.int32)
            edge[0] |= FIRST
            edge[-1] |= LAST
            more = {
                "_lt": before - np.repeat(before[start], sizes), "_n": np.repeat(total, sizes),
                "_edge": np.repeat(edge, sizes), "_range": np.full(n, TaskContext.get().partitionId(), np.int32),
                "_block": np.full(n, block, np.int64),
            }
            for name, values in more.items():
                t = t.append_column(name, pa.array(values))
            yield from t.to_batches()

    return run


def positions(df: DataFrame, keys: list[str], value: str | Column, *, ranges: int | None = None) -> DataFrame:
    """One row per (keys, distinct value): _v, _eq (rows), _lt (rows with smaller values) and
    _n (rows of the group), all of non-NULL values. A group's NULL values are one row with
    _v NULL, so that no group is lost. `ranges` fixes the number of ranges."""
    keys = list(keys)
    counted = df.select(*keys, col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_eq"))
    counted = counted.withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_eq")).otherwise(0))
    order = [*keys, "_v"]
    spread = counted.repartitionByRange(ranges, *order) if ranges else counted.repartitionByRange(*order)
    schema = T.StructType([
        *spread.schema.fields, T.StructField("_lt", T.LongType()), T.StructField("_n", T.LongType()),
        T.StructField("_edge", T.IntegerType()), T.StructField("_range", T.IntegerType()),
        T.StructField("_block", T.LongType()),
    ])
    local = written(spread.sortWithinPartitions(*order).mapInArrow(_count_range(keys, BLOCK), schema), "ranges")
    # what a block holds of its first and its last group, and what earlier blocks hold of them
    parts = local.where("_edge > 0").groupBy(*keys, "_range", "_block", "_edge").agg(F.sum("_w").alias("_c"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range", "_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = written(parts.select(
        F.col("_range").alias("_r"), F.col("_block").alias("_b"), F.col("_edge").alias("_e"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_carried"), F.sum("_c").over(group).alias("_whole"),
    ), "carry")
    same = (F.col("_range") == F.col("_r")) & (F.col("_block") == F.col("_b")) & (F.col("_edge") == F.col("_e"))
    joined = local.join(carry, same, "left")
    return joined.select(
        *keys, "_v", "_eq", (F.col("_lt") + F.coalesce("_carried", F.lit(0))).alias("_lt"),
        F.coalesce("_whole", "_n").alias("_n"),
    )


def tally(
    df: DataFrame, keys: list[str], value: str | Column, prefix: str = "", *, at: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add `{prefix}lt`, `{prefix}eq`, `{prefix}n`: smaller, equal and all
    non-NULL values of the row's group.  NULL for NULL input.  `at`: the positions, if
    they are known already."""
    keys = list(keys)
    at = positions(df, keys, value, ranges=ranges) if at is None else at
    pos = at.filter(F.col("_v").isNotNull()).select(
        *keys, F.col("_v").alias("_val"), F.col("_lt").alias(f"{prefix}lt"), F.col("_eq").alias(f"{prefix}eq"),
        F.col("_n").alias(f"{prefix}n"),
    )
    return join_groups(df.withColumn("_val", col(value)), pos, [*keys, "_val"], "left").drop("_val")


def average_rank(prefix: str = "", pct: bool = True) -> Column:
    """Average rank of ties from `tally` columns, as a share of the count or plain."""
    r = F.col(f"{prefix}lt") + (F.col(f"{prefix}eq") + 1) / 2.0
    return r / F.col(f"{prefix}n") if pct else r


def _holds(k: Column) -> Column:
    """Does the row's value stand at the zero-based place k of its sorted group?"""
    return F.col("_v").isNotNull() & (F.col("_lt") <= k) & (k < F.col("_lt") + F.col("_eq"))


def _wanted(at: DataFrame, places: list[Column]) -> DataFrame:
    """The few rows that hold a place, and one row of each group besides."""
    keep = F.col("_lt") == 0
    for k in places:
        keep = keep | _holds(k)
    return at.where(keep)


def group_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], *, at: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group."""
    keys = list(keys)
    at = positions(df, keys, value, ranges=ranges) if at is None else at
    x = F.col("_v").cast("double")
    outs, places = [], []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        value_at = lambda k: F.max(F.when(_holds(k), x))
        places += [F.floor(h), F.ceil(h)]
        lo, hi = value_at(F.floor(h)), value_at(F.ceil(h))
        outs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    return _wanted(at, places).groupBy(*keys).agg(*outs)


def group_values_at(
    df: DataFrame, keys: list[str], value: str | Column, places: dict, *, at: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Sorted values at positions per group: `{name: function of the count column}`."""
    at = positions(df, list(keys), value, ranges=ranges) if at is None else at
    wanted = {name: k(F.col("_n")) for name, k in places.items()}
    outs = [F.max(F.when(_holds(k), F.col("_v"))).alias(name) for name, k in wanted.items()]
    return _wanted(at, list(wanted.values())).groupBy(*keys).agg(*outs)
