"""Cumulative columns along time that do not need a key's history in one task.

On a segmented frame a running value is the local running value inside the
segment combined with the total of all earlier segments.  The totals table has
one row per segment.  The rows feed both the totals and the join, so they are
checkpointed once instead of being computed twice per pass.
"""
from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .expr import col, join_groups
from .lineage import checkpointed
from .panel import Frame

_AGG = {
    "sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, earlier: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        both = earlier + local
    elif kind == "product":
        both = earlier * local
    elif kind == "last":
        return F.coalesce(local, earlier)
    else:
        return F.greatest(earlier, local) if kind == "max" else F.least(earlier, local)
    return F.coalesce(both, local, earlier)


def cumulative(frame: Frame, outs: dict[str, tuple[str, str | Column]]) -> Frame:
    """Add running columns `{name: (kind, column)}`, NULL inputs skipped."""
    upto = frame.rows(Window.unboundedPreceding, 0)
    local = {n: _AGG[k](col(c)).over(upto) for n, (k, c) in outs.items()}
    if not frame.segmented:
        return frame.with_df(frame.df.withColumns(local))

    df = checkpointed(
        frame.df.filter("_core").withColumns({f"_l_{n}": c for n, c in local.items()})
    )
    keys = [k for k in frame.part if k != "_seg"]
    def total(kind: str, c) -> Column:
        if kind == "last":
            return F.max_by(col(c), F.when(col(c).isNotNull(), F.col(frame.ts)))
        return _AGG[kind](col(c))

    totals = df.groupBy(*frame.part).agg(
        *[total(k, c).alias(f"_t_{n}") for n, (k, c) in outs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(
        Window.unboundedPreceding, -1
    )
    fold = {"count": F.sum}
    prefix = totals.select(
        *frame.part,
        *[
            fold.get(k, _AGG[k])(F.col(f"_t_{n}")).over(earlier).alias(f"_p_{n}")
            for n, (k, _) in outs.items()
        ],
    )
    df = join_groups(df, prefix, list(frame.part))
    df = df.withColumns(
        {
            n: _combine(k, F.col(f"_p_{n}"), F.col(f"_l_{n}"))
            for n, (k, _) in outs.items()
        }
    ).drop(*[f"_l_{n}" for n in outs], *[f"_p_{n}" for n in outs])
    return frame.with_df(df)


def numbered(frame: Frame, name: str = "rn") -> Frame:
    """Zero-based row number along time per key, BIGINT."""
    out = cumulative(frame, {name: ("count", F.lit(1))})
    return out.with_df(out.df.withColumn(name, (F.col(name) - 1).cast("bigint")))
