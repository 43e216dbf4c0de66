"""Long panels and the time frames that window features run on.

A panel is a DataFrame with key columns (asset, strategy, fold, ...), a time
column and values, one row per (keys, ts).  Window features never name their own
partition: they ask a `Frame` for lags and row frames, so the same feature runs
per asset, per (fold, asset) or per (probe, asset), and on slices of one asset's
history when that history is too long for one task.

How a frame is partitioned depends on what is known of the panel, never on its size:

* A panel of calendar bars (`grain` = week, day, ...) cannot hold more rows per
  key than the calendar has bars, whatever the volume of raw data behind it;
  its windows are partitioned by key.
* Without a grain the history of every key is cut into segments of about
  SEGMENT_ROWS rows; a short history is one segment.  Cut points come from a (key,
  calendar block) count, a small pre-aggregated table.  Every segment also receives
  the neighbouring blocks that its look-back and look-ahead rows can reach, so each
  window result on a core row is exact; halo rows are dropped at the end.  A key that
  holds a third of all rows becomes many tasks.  NULL keys and times are kept.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .expr import col, join_groups

SEGMENT_ROWS = 2_000_000

# Bars per key over 150 years of an always-open market.
GRAIN_ROWS = {
    "month": 150 * 12,
    "week": 150 * 53,
    "day": 150 * 366,
    "hour": 150 * 366 * 24,
}


@dataclass(frozen=True)
class Frame:
    """Rows ready for window expressions, and the partition they run in."""

    df: DataFrame
    part: tuple[str, ...]
    ts: str
    segmented: bool = False

    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(self.ts)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.order().rowsBetween(start, end)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.order())

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.order())

    def with_df(self, df: DataFrame) -> "Frame":
        return replace(self, df=df)

    def core(self, df: DataFrame | None = None) -> DataFrame:
        """Drop halo rows and bookkeeping columns."""
        df = self.df if df is None else df
        if not self.segmented:
            return df
        return df.filter("_core").drop("_core", "_seg")


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    keys: tuple[str, ...] = ("asset",)
    ts: str = "ts"
    grain: str | None = None
    block: str = "month"
    segment_rows: int = field(default=SEGMENT_ROWS)

    @property
    def bounded(self) -> bool:
        """No key can hold more than `segment_rows` rows, by its calendar."""
        return self.grain in GRAIN_ROWS and GRAIN_ROWS[self.grain] <= self.segment_rows

    def with_df(self, df: DataFrame, *, keys: tuple[str, ...] | None = None) -> "Panel":
        return replace(self, df=df, keys=self.keys if keys is None else tuple(keys))

    def select(self, *cols) -> "Panel":
        return self.with_df(self.df.select(*self.keys, self.ts, *cols))

    def frame(self, back: int = 0, ahead: int = 0) -> Frame:
        """A frame whose windows may look `back` / `ahead` rows from each row."""
        if self.bounded:
            return Frame(self.df, self.keys, self.ts)
        return Frame(
            _segment(self, back, ahead), self.keys + ("_seg",), self.ts, segmented=True
        )


def _segment(panel: Panel, back: int, ahead: int) -> DataFrame:
    keys, ts = list(panel.keys), panel.ts
    rows = max(panel.segment_rows, 1)
    block = F.date_trunc(panel.block, F.col(ts).cast("timestamp"))

    counts = panel.df.groupBy(*keys, block.alias("_block")).agg(F.count("*").alias("_n"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    before = F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    blocks = counts.withColumn("_before", before).withColumn(
        "_home", F.floor(F.col("_before") / rows)
    )
    # Which other segments can reach into this block: those whose rows lie within
    # `back` rows after it, and those within `ahead` rows before it.
    by_pos = Window.partitionBy(*keys).orderBy("_before")
    blocks = blocks.withColumn(
        "_reach", F.max("_home").over(by_pos.rangeBetween(0, max(back - 1, 0)))
    ).withColumn("_prev", F.coalesce(F.lag("_home").over(by_pos), F.col("_home")))
    last = F.coalesce(F.lead("_reach").over(by_pos), F.col("_home")) if back else F.col("_home")
    first = (
        F.min("_prev").over(by_pos.rangeBetween(-max(ahead - 1, 0), 0)) if ahead else F.col("_home")
    )
    blocks = blocks.select(
        *keys, "_block", "_home", F.sequence(first, last).alias("_segs")
    )
    placed = join_groups(panel.df.withColumn("_block", block), blocks, keys + ["_block"])
    return (
        placed.withColumn("_seg", F.explode("_segs"))
        .withColumn("_core", F.col("_seg") == F.col("_home"))
        .drop("_block", "_home", "_segs")
    )
