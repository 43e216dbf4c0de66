"""Many-asset books: weights from cross sections, returns on gross exposure."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.expr import clip, join_groups, ratio
from ..core.panel import Panel
from ..core.ranks import average_rank, group_quantiles, positions, tally
from ..core.scan import numbered
from ..functions.crosssection import with_group
from .backtest import BacktestConfig, performance


def bar_numbers(panel: Panel) -> DataFrame:
    """Zero-based number of every distinct bar time: one row per bar of the calendar,
    numbered in one window where the calendar is known or counted to be short, in
    segments otherwise."""
    ts = panel.ts
    times = panel.df.select(ts).distinct().withColumn("_all", F.lit(1))
    frame = replace(panel, df=times, keys=("_all",)).frame()
    return numbered(frame, "bar").core().select(ts, "bar")


def portfolio_returns(
    panel: Panel, config: BacktestConfig = BacktestConfig(), *, book: tuple[str, ...] = ("strategy_id",),
    asset: str = "asset", position: str = "position", ret: str = "ret", normalize: bool = True,
) -> Panel:
    """Net return, turnover and exposures per book and bar.

    Each weight is sent to the bars it matters for: the bar it is held into
    (`execution_lag` later) and the one after, where it is unwound or kept.  Asset
    bars then meet in one grouping, with no window and no filled-up matrix: an asset
    whose next bar is missing is still held into it and sold after it.
    """
    ts, lag = panel.ts, config.execution_lag
    bars = bar_numbers(panel)
    weight = F.coalesce(clip(position, *config.bounds), F.lit(0.0))
    rows = panel.df.join(bars, ts).select(
        *book, asset, "bar", weight.alias("_w"), F.coalesce(F.col(ret), F.lit(0.0)).alias("_r")
    )
    zero = F.lit(0.0)
    sent = rows.select(
        *book,
        asset,
        F.explode(
            F.array(
                F.struct(F.col("bar").alias("bar"), F.col("_r").alias("r"), zero.alias("now"), zero.alias("was")),
                F.struct((F.col("bar") + lag).alias("bar"), zero.alias("r"), F.col("_w").alias("now"), zero.alias("was")),
                F.struct((F.col("bar") + lag + 1).alias("bar"), zero.alias("r"), zero.alias("now"), F.col("_w").alias("was")),
            )
        ).alias("s"),
    ).select(*book, asset, "s.*")
    cells = sent.groupBy(*book, asset, "bar").agg(
        F.sum("r").alias("r"), F.sum("now").alias("now"), F.sum("was").alias("was")
    )
    per_bar = cells.groupBy(*book, "bar").agg(
        F.sum(F.col("now") * F.col("r")).alias("_pnl"),
        F.sum(F.abs("now")).alias("gross_exposure"),
        F.sum("now").alias("net_exposure"),
        F.sum(F.abs(F.col("now") - F.col("was"))).alias("turnover"),
    ).join(bars, "bar")
    cost = F.col("turnover") * (config.cost_bps / 1e4)
    if normalize:
        earned = F.coalesce(ratio("_pnl", "gross_exposure"), zero)
        cost = F.coalesce(ratio(cost, "gross_exposure"), zero)
    else:
        earned = F.col("_pnl")
    out = per_bar.withColumn("net", earned - cost).drop("_pnl", "bar")
    return Panel(
        out.select(*book, ts, "net", "turnover", "gross_exposure", "net_exposure"),
        keys=tuple(book), ts=ts, grain=panel.grain, segment_rows=panel.segment_rows,
    )


def portfolio_performance(
    panel: Panel, config: BacktestConfig = BacktestConfig(), *, book: tuple[str, ...] = ("strategy_id",),
    asset: str = "asset", **kwargs,
) -> DataFrame:
    """Headline metrics of each book plus universe size and mean exposures."""
    returns = portfolio_returns(panel, config, book=book, asset=asset, **kwargs)
    metrics = performance(returns, turnover="turnover", annualization=config.annualization)
    size = panel.df.groupBy(*book).agg(F.countDistinct(asset).cast("double").alias("n_assets"))
    exposure = returns.df.groupBy(*book).agg(
        F.avg("gross_exposure").alias("mean_gross_exposure"),
        F.avg("net_exposure").alias("mean_net_exposure"),
    )
    return metrics.join(size, list(book)).join(exposure, list(book))


def long_short_quantile(
    df: DataFrame, signal: str, *, by: tuple[str, ...] = ("ts",), long_quantile: float = 0.8,
    short_quantile: float = 0.2, weight: str = "equal", name: str = "position", at: DataFrame | None = None,
) -> DataFrame:
    """Weights from ranks within the bar.

    `equal`: one over the number of names on each side (gross 2).  `signal`: by
    distance from the median, half gross on each side.  `at`: the positions of the
    signal in its bars (`core.ranks.positions`), if they are known already.
    """
    if not 0.0 < short_quantile < long_quantile < 1.0:
        raise ValueError("need 0 < short_quantile < long_quantile < 1")
    if weight not in ("equal", "signal"):
        raise ValueError(f"unknown weight scheme {weight!r}")
    by = list(by)
    at = positions(df, by, signal) if at is None else at
    ranked = tally(df, by, signal, prefix="_q_", at=at)
    pct = average_rank("_q_")
    is_long = F.coalesce(pct >= long_quantile, F.lit(False))
    is_short = F.coalesce(pct <= short_quantile, F.lit(False))
    ranked = ranked.withColumns({"_long": is_long, "_short": is_short})
    if weight == "equal":
        ranked = ranked.withColumn("_c", F.lit(1.0))
        share = 1.0
    else:
        ranked = join_groups(ranked, group_quantiles(df, by, signal, {"_med": 0.5}, at=at), by, "left")
        ranked = ranked.withColumn("_c", F.col(signal) - F.col("_med"))
        share = 0.5
    side = lambda flag: F.when(F.col(flag), F.abs("_c"))
    totals = {"_gl": F.sum(side("_long")), "_gs": F.sum(side("_short"))}
    sized = with_group(ranked, by, totals)
    up = F.when(F.col("_long"), F.coalesce(ratio("_c", "_gl"), F.lit(0.0))).otherwise(0.0)
    short_c = F.col("_c") if weight == "signal" else -F.col("_c")
    down = F.when(F.col("_short"), F.coalesce(ratio(short_c, "_gs"), F.lit(0.0))).otherwise(0.0)
    return sized.withColumn(name, (up + down) * share).drop(
        "_q_lt", "_q_eq", "_q_n", "_long", "_short", "_c", "_gl", "_gs", "_med"
    )


def vol_scaled(
    df: DataFrame, signal: str, vol: str, *, by: tuple[str, ...] = ("ts",), high: float = 0.8,
    low: float = 0.2, cap: float = 20.0, name: str = "position",
) -> DataFrame:
    """+-1 at the rank extremes of the bar, scaled by the inverse volatility up to a cap."""
    ranked = tally(df, list(by), signal, prefix="_q_")
    pct = average_rank("_q_")
    side = F.when(pct >= high, 1.0).when(pct <= low, -1.0).otherwise(0.0)
    scale: Column = F.least(ratio(F.lit(1.0), vol), F.lit(cap))
    scale = F.when(F.col(vol).isNotNull(), F.coalesce(scale, F.lit(cap)))
    return ranked.withColumn(name, F.coalesce(side * scale, F.lit(0.0))).drop(
        "_q_lt", "_q_eq", "_q_n"
    )
