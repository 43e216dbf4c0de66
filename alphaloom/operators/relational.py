"""Joins and row selection in the forms the research tables need."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows present on both sides."""
    return left.join(right, on, "inner")


def merge_vendor(cores: DataFrame, dailies: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
    """Core rows that have a daily price, with the vendor rank where there is one."""
    return cores.join(dailies, on, "inner").join(ranks, on, "left")


def occurring(panel: DataFrame, trades: DataFrame, on: list[str]) -> DataFrame:
    """Panel rows whose key occurs among the trades."""
    return panel.join(trades.select(*on), on, "left_semi")


def missing(trades: DataFrame, panel: DataFrame, on: list[str]) -> DataFrame:
    """Trades without a panel row."""
    return trades.join(panel.select(*on), on, "left_anti")


def asof_latest(
    targets: DataFrame, records: DataFrame, *, at: str, effective: str, by: list[str] = (),
    values: list[str] = (), block: str = "month",
) -> DataFrame:
    """For each target the latest record with effective <= at, per `by`.

    No pair of every target with every earlier record is made.  Both sides are laid
    on one time line and cut into calendar blocks; inside a block a running last
    value fills forward, and the last record of earlier blocks is carried in from a
    table with one row per block.  Targets without a record keep NULL values.
    """
    by, values = list(by), list(values)
    rec = records.select(
        *by, F.col(effective).alias("_t"), F.lit(0).alias("_side"),
        F.struct(F.col(effective), *values).alias("_rec"), F.lit(None).cast(
            targets.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_row"),
    )
    tgt = targets.select(
        *by, F.col(at).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(rec.schema["_rec"].dataType).alias("_rec"), F.struct("*").alias("_row"),
    )
    line = rec.unionByName(tgt).withColumn("_b", F.date_trunc(block, F.col("_t").cast("timestamp")))
    inside = Window.partitionBy(*by, "_b").orderBy("_t", "_side").rowsBetween(
        Window.unboundedPreceding, 0
    )
    line = line.withColumn("_in", F.last("_rec", ignorenulls=True).over(inside))
    ends = line.filter("_side = 0").groupBy(*by, "_b").agg(F.max_by("_rec", "_t").alias("_end"))
    blocks = line.select(*by, "_b").distinct().join(ends, by + ["_b"], "left")
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *by, "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")
    )
    got = F.coalesce("_in", "_carry")
    return (
        line.filter("_side = 1")
        .join(carried, by + ["_b"])
        .select("_row.*", *[got[c].alias(c) for c in [effective, *values]])
    )


def within_event_window(rows: DataFrame, events: DataFrame, *, ts: str, date: str, days: int = 3) -> DataFrame:
    """Rows dated within +-`days` of any event: offsets explode to distinct dates,
    a table the calendar bounds, and the rows meet it in a semi join."""
    near = events.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add(F.col(date), k)
            )
        ).alias("_near")
    ).distinct()
    return rows.join(near, F.col(ts).cast("date") == F.col("_near"), "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in a stated order.

    `min_by` over a struct keeps one candidate per key and map task, so a key with
    many copies never meets in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    )
    return best.select(*keys, "_best.*").select(*df.columns)


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest(df: DataFrame, order: list[str], n: int, *, ascending_output: bool = False) -> DataFrame:
    """The last n rows in the given order (a top-k, not a sort of everything)."""
    top = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return top.orderBy(*order) if ascending_output else top
