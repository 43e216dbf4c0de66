"""Bar spacing, annualisation, sessions and trading costs."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.expr import col, join_groups, ratio
from ..core.panel import Panel
from ..core.ranks import group_quantiles

# Canonical bar lengths in seconds and bars per trading day.
BAR_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400,
}
BARS_PER_DAY = {"1d": 1, "4h": 2, "1h": 7, "30m": 13, "15m": 26, "5m": 78, "1m": 390}


def infer_interval(panel: Panel, name: str = "interval") -> DataFrame:
    """Bar label per key: median spacing within 20% of a standard bar, else 1d."""
    frame = panel.frame(back=1)
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    ts = F.col(panel.ts)
    spaced = frame.core(
        frame.df.withColumn("_gap", secs(ts) - secs(frame.lag(panel.ts, 1)))
    ).select(*panel.keys, "_gap")
    keys = list(panel.keys)
    counts = spaced.groupBy(*keys).agg(F.count("*").alias("n_bars"))
    stats = join_groups(counts, group_quantiles(spaced, keys, "_gap", {"median_seconds": 0.5}), keys, "left")
    label = F.lit("1d")
    for bar, s in BAR_SECONDS.items():
        near = (F.col("median_seconds") >= 0.8 * s) & (F.col("median_seconds") <= 1.2 * s)
        label = F.when(near & (F.col("n_bars") >= 10), bar).otherwise(label)
    return stats.withColumn(name, label)


def annualization(interval: str | Column, *, days: int = 252, per_day: int | None = None) -> Column:
    """Bars per year for a bar label; `per_day` overrides the session length."""
    if per_day is not None:
        return F.lit(days * per_day)
    table = F.create_map(*[F.lit(v) for v in chain(*BARS_PER_DAY.items())])
    return F.lit(days) * F.coalesce(F.try_element_at(table, col(interval)), F.lit(1))


def crypto_annualization(interval: str | Column) -> Column:
    """An always-open market: 365 days, 24 hourly bars."""
    return F.when(col(interval) == "1h", 365 * 24).otherwise(365)


def in_session(df: DataFrame, ts: str = "ts", start: str = "09:30:00", end: str = "16:00:00") -> DataFrame:
    """Bars whose time of day lies in the session, both ends included."""
    clock = F.date_format(ts, "HH:mm:ss.SSSSSS")
    return df.filter((clock >= f"{start}.000000") & (clock <= f"{end}.000000"))


def cost_bps(spread: float = 2.0, commission: float = 1.0, slippage: float = 5.0) -> float:
    """Round-turn cost in basis points."""
    if min(spread, commission, slippage) < 0:
        raise ValueError("cost components must be non-negative")
    return spread + commission + slippage


def market_impact_bps(size: str | Column, adv: str | Column, coefficient: float = 10.0) -> Column:
    """coefficient * sqrt(size / ADV); a non-positive ADV gives NULL."""
    part = ratio(F.greatest(col(size), F.lit(0.0)), F.when(col(adv) > 0, col(adv)))
    return coefficient * F.sqrt(part)
