"""Running strategies: execution costs, live diagnosis, kill switches, metrics."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.expr import join_groups, ratio
from ..core.panel import Panel
from ..core.ranks import group_quantiles, group_values_at
from .backtest import performance, with_drawdown
from .splits import counted

# --- execution costs -------------------------------------------------------------------


def shortfalls(fills: DataFrame) -> DataFrame:
    """Signed arrival and implementation shortfall in basis points."""
    bps = lambda ref: ratio((F.col("fill_price") - F.col(ref)) * F.col("side"), ref) * 1e4
    return fills.withColumns(
        {"arrival_bps": bps("arrival_price"), "implementation_bps": bps("decision_price")}
    )


def valid_fills(fills: DataFrame) -> DataFrame:
    """Fills with a side of +-1, a quantity of zero or more and positive prices."""
    price = F.least("fill_price", "arrival_price", "decision_price")
    return fills.filter(F.col("side").isin(-1, 1) & (F.col("quantity") >= 0) & (price > 0))


def tca_report(fills: DataFrame) -> DataFrame:
    """Shortfall statistics per symbol and, with symbol NULL, over all fills.

    A fill counts for its symbol and for the total.
    """
    groups = F.array(
        F.struct(F.lit(False).alias("_total"), "symbol"),
        F.struct(F.lit(True).alias("_total"), F.lit("").alias("symbol")),
    )
    rows = shortfalls(fills).select(F.explode(groups).alias("g"), "arrival_bps", "implementation_bps").select(
        "g.*", "arrival_bps", "implementation_bps"
    )
    by = ["_total", "symbol"]
    stats = [
        F.count("*").alias("n_fills"), F.avg("arrival_bps").alias("mean_arrival_bps"),
        F.avg("implementation_bps").alias("mean_implementation_bps"),
    ]
    q = {"median_arrival_bps": 0.5, "p95_arrival_bps": 0.95}
    out = join_groups(rows.groupBy(*by).agg(*stats), group_quantiles(rows, by, "arrival_bps", q), by)
    return out.withColumn("symbol", F.when(~F.col("_total"), F.col("symbol"))).drop("_total")


def calibrated_cost(fills: DataFrame, percentile: float = 0.5) -> DataFrame:
    """One cost in basis points: the median or 95% shortfall of all fills, any other
    percentile from the symbols' mean shortfalls."""
    rows = shortfalls(fills)
    if percentile in (0.5, 0.95):
        return group_quantiles(rows, [], "arrival_bps", {"cost_bps": percentile})
    means = rows.groupBy("symbol").agg(F.avg("arrival_bps").alias("m"))
    return group_quantiles(means, [], "m", {"cost_bps": percentile})


def slippage_coefficient(fills: DataFrame, adv: DataFrame | None = None) -> DataFrame:
    """k in slippage = k sqrt(quantity / ADV), least squares through the origin; the
    mean shortfall without volumes or with fewer than five usable fills."""
    y = ratio(F.abs(F.col("fill_price") - F.col("arrival_price")), "arrival_price") * 1e4
    if adv is None:
        return fills.agg(F.avg(y).alias("k"))
    ok = fills.join(adv, "symbol").filter((F.col("adv") > 0) & (F.col("quantity") > 0))
    x2 = ratio("quantity", "adv")
    n = F.count("*")
    k = F.coalesce(ratio(F.sum(F.sqrt(x2) * y), F.sum(x2)), F.lit(0.0))
    return ok.agg(F.when(n < 5, F.coalesce(F.avg(y), F.lit(0.0))).otherwise(k).alias("k"))


# --- live diagnosis ---------------------------------------------------------------------


def last_rows(panel: Panel, n: int) -> DataFrame:
    """The last n rows of each key, from row numbers and counts."""
    return counted(panel).filter(F.col("rn") >= F.col("n") - n).drop("rn", "n")


def live_diagnose(baseline: Panel, live: Panel, *, window: int = 60, net: str = "net", annualization: float = 252) -> DataFrame:
    """Last `window` live returns against the backtest: flags per strategy."""
    keys = list(live.keys)
    least = max(20, window // 3)
    recent = live.with_df(last_rows(live.with_df(live.df.filter(F.col(net).isNotNull())), window))
    want = {"sharpe_ratio": "sharpe", "hit_rate": "hit_rate", "max_drawdown": "max_drawdown"}
    part = lambda p, pre: performance(p, net=net, annualization=annualization).select(
        *keys, *([F.lit(True).alias("_based")] if pre == "baseline" else []), *[F.col(m).alias(f"{pre}_{n}") for m, n in want.items()]
    )
    counts = recent.df.groupBy(*keys).agg(F.count("*").alias("n_live_observations"))
    # every live strategy is reported, also one without a return or a baseline
    every = live.df.select(*keys).distinct()
    j = every
    for side in (counts, part(recent, "live"), part(baseline, "baseline")):
        j = join_groups(j, side, keys, "left")
    j = j.withColumn("n_live_observations", F.coalesce("n_live_observations", F.lit(0))).withColumn("_based", F.col("_based").isNotNull())
    drop = F.coalesce(ratio("live_sharpe", "baseline_sharpe"), F.when(F.col("live_sharpe") <= 0, 0.0).otherwise(1.0))
    drift = F.col("live_hit_rate") - F.col("baseline_hit_rate")
    flags = F.array_compact(
        F.array(
            F.when(drop < 0.5, "sharpe_collapse"), F.when(F.abs(drift) > 0.05, "hit_rate_drift"),
            F.when(F.col("live_max_drawdown") < F.col("baseline_max_drawdown") * 1.5, "drawdown_breach"),
        )
    )
    enough = (F.col("n_live_observations") >= least) & F.col("_based")
    out = j.withColumns({"sharpe_ratio_drop": drop, "flags": F.concat_ws(",", flags)})
    status = F.when(~enough, "insufficient_data").when(F.col("flags") == "", "ok").otherwise("degraded")
    measured = ["flags", "live_sharpe", "baseline_sharpe", "sharpe_ratio_drop", "live_hit_rate",
                "baseline_hit_rate", "live_max_drawdown", "baseline_max_drawdown"]
    return out.select(
        *keys, status.alias("status"), "n_live_observations",
        *[F.when(enough, F.col(c)).alias(c) for c in measured],
    )


# --- kill switch --------------------------------------------------------------------------


def kill_switch(
    panel: Panel, *, net: str = "net", max_drawdown: float | None = 0.10, max_loss: float | None = 0.03,
    min_sharpe: float | None = None, window: int = 60, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """First bar at which a rule trips, per strategy, and which rule.

    Rules are tried in order on each bar, so the first in the list names the trip.
    `extra` adds boolean columns as further rules.
    """
    for limit in (max_drawdown, max_loss):
        if limit is not None and limit <= 0:
            raise ValueError("limits must be positive")
    frame = with_drawdown(panel, net)
    if frame.segmented and min_sharpe is not None:
        rolled = panel.frame(back=window - 1)
        rows = rolled.rows(1 - window, 0)
        sr = _rolling_sharpe(net, rows, window)
        extra_sr = rolled.core(rolled.df.withColumn("_sr", sr)).select(*panel.keys, panel.ts, "_sr")
        df = frame.core().join(extra_sr, [*panel.keys, panel.ts])
    else:
        df = frame.df
        if min_sharpe is not None:
            df = df.withColumn("_sr", _rolling_sharpe(net, frame.rows(1 - window, 0), window))
        df = frame.core(df)
    rules: list[tuple[str, Column]] = []
    if max_drawdown is not None:
        rules.append((f"drawdown>{max_drawdown:.2%}", F.col("drawdown") <= -max_drawdown))
    if max_loss is not None:
        rules.append((f"daily_loss>{max_loss:.2%}", F.col(net) <= -max_loss))
    if min_sharpe is not None:
        rules.append((f"sharpe<{min_sharpe}", F.col("_sr") < min_sharpe))
    rules += list((extra or {}).items())
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    trips = df.withColumn("trip_reason", reason)
    return trips.groupBy(*panel.keys).agg(
        F.min(F.when(F.col("trip_reason").isNotNull(), F.struct(panel.ts, "trip_reason"))).alias("_t")
    ).select(
        *panel.keys, F.col("_t").isNotNull().alias("tripped"), F.col(f"_t.{panel.ts}").alias("trip_ts"),
        F.col("_t.trip_reason").alias("trip_reason"),
    )


def _rolling_sharpe(net: str, w, window: int) -> Column:
    full = F.count(net).over(w) == window
    sr = ratio(F.avg(net).over(w), F.stddev_samp(net).over(w)) * math.sqrt(252)
    return F.when(full, sr)


# --- metrics -----------------------------------------------------------------------------


def metrics_rollup(df: DataFrame, *, by: list[str], value: str = "value", order: list[str] = ("ts",)) -> DataFrame:
    """Counter total, last gauge value and histogram summary per metric.

    p50 and p95 are sorted values at n // 2 and floor(0.95 n), taken by position so
    that no metric's values are collected.
    """
    x = F.col(value)
    base = df.groupBy(*by).agg(
        F.sum(x).alias("counter"), F.max_by(x, F.struct(*order)).alias("gauge"), F.count(x).alias("n"),
        F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    cuts = group_values_at(
        df, by, value,
        {
            "p50": lambda n: F.floor(n / 2),
            "p95": lambda n: F.least(n - 1, F.floor(n * 0.95)),
        },
    )
    return join_groups(base, cuts, by)


