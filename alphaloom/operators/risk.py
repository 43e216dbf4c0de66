"""Risk statistics of positions, returns and greeks, per strategy."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.expr import bias_corrected_kurtosis, bias_corrected_skew, join_groups, ratio
from ..core.lineage import written
from ..core.panel import Panel
from ..core.ranks import group_quantiles
from ..functions.crosssection import with_group
from .diagnostics import observed, underwater_runs
from .relational import within_event_window

GREEKS = ("delta", "gamma", "vega", "theta")
NET_GREEKS = ("vega", "gamma", "delta")
ROUNDING = 1e-15  # times the count and the sum of sizes: more than two orders of adding can differ


def position_stats(df: DataFrame, *, by: list[str], position: str = "position") -> DataFrame:
    """Mean and max size, share of bars at or above the 99% size, largest over total."""
    rows = df.filter(F.col(position).isNotNull()).withColumn("_a", F.abs(position))
    cut = group_quantiles(rows, by, "_a", {"_p99": 0.99})
    total = F.sum("_a")
    return join_groups(rows, cut, by).groupBy(*by).agg(
        F.avg("_a").alias("mean_abs_position"),
        F.max("_a").alias("max_abs_position"),
        F.avg((F.col("_a") >= F.col("_p99")).cast("double")).alias("fraction_at_max"),
        F.when(total > 1e-9, F.max("_a") / total).otherwise(0.0).alias("concentration_share"),
    )


def tail_metrics(panel: Panel, net: str = "net") -> DataFrame:
    """Worst 1, 5 and 21 bar sums, drawdown depth and length, shape of returns."""
    rows = observed(panel, net)
    frame = rows.frame(back=20)
    sums = {
        f"_s{k}": F.when(
            F.count(net).over(frame.rows(1 - k, 0)) == k, F.sum(net).over(frame.rows(1 - k, 0))
        )
        for k in (5, 21)
    }
    x, n = F.col(net), F.count(net)
    stats = frame.core(frame.df.withColumns(sums)).groupBy(*panel.keys).agg(
        F.min(x).alias("worst_1d_return"),
        F.coalesce(F.min("_s5"), F.min(x)).alias("worst_5d_return"),
        F.coalesce(F.min("_s21"), F.min(x)).alias("worst_month_return"),
        F.coalesce(F.when(n > 3, bias_corrected_skew(n, F.skewness(x))), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.when(n > 4, bias_corrected_kurtosis(n, F.kurtosis(x))), F.lit(0.0)).alias("excess_kurtosis"),
    )
    return stats.join(underwater_runs(panel, net), list(panel.keys)).withColumnsRenamed(
        {"max_drawdown": "max_drawdown_pct", "drawdown_bars": "max_drawdown_duration_days"}
    )


def greek_summary(df: DataFrame, *, by: list[str], order: list[str] | None = None) -> DataFrame:
    """Mean and max absolute greeks and the sign of the net ones (+-1 is neutral).

    Doubles added up in another order differ in their last digits, which decides the sign of a
    net that lies on the threshold.  With `order` every net counts as the sum of its rows in
    that order: partial sums decide the groups that no order of adding could move over the
    threshold, and only the rows of the others are sorted and added one after the other.
    """
    present = [g for g in GREEKS if g in df.columns]
    nets = [g for g in NET_GREEKS if g in present]
    aggs = [f(F.abs(g)).alias(f"{n}_abs_{g}") for g in present for n, f in (("mean", F.avg), ("max", F.max))]
    sums = [F.sum(g).alias(f"_net_{g}") for g in nets]
    if order is None:
        return _with_signs(df.groupBy(*by).agg(*aggs, *sums), nets)
    near = F.lit(False)
    for g in nets:
        reach = F.count(g) * ROUNDING * F.sum(F.abs(g))
        near = near | F.coalesce(F.abs(F.abs(F.sum(g)) - 1.0) <= reach, F.lit(False))
    out = written(df.groupBy(*by).agg(*aggs, *sums, near.alias("_near")), "greeks")
    rows = join_groups(df, out.where("_near").select(*by), by, "left_semi")
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = rows.select(*by, F.row_number().over(w).alias("_i"), *[F.sum(g).over(upto).alias(f"_upto_{g}") for g in nets])
    last = added.groupBy(*by).agg(*[F.max_by(f"_upto_{g}", "_i").alias(f"_last_{g}") for g in nets], F.lit(True).alias("_added"))
    both = join_groups(out, last, by, "left")
    exact = {f"_net_{g}": F.when(F.col("_added"), F.col(f"_last_{g}")).otherwise(F.col(f"_net_{g}")) for g in nets}
    return _with_signs(both.withColumns(exact).drop("_near", "_added", *[f"_last_{g}" for g in nets]), nets)


def _with_signs(df: DataFrame, nets: list[str]) -> DataFrame:
    """A net_{g}_sign for each greek in place of the nets; an absent greek is neutral."""
    signs = {}
    for g in NET_GREEKS:
        net = F.col(f"_net_{g}") if g in nets else F.lit(0.0)
        signs[f"net_{g}_sign"] = F.when(net > 1.0, "long").when(net < -1.0, "short").otherwise("neutral")
    return df.withColumns(signs).drop(*[f"_net_{g}" for g in nets])


def concentration(df: DataFrame, *, by: list[str], asset: str = "asset", ts: str = "ts", position: str = "position") -> DataFrame:
    """Assets ever held and the largest share one asset had of a bar's total size.

    The bar total is a grouped sum joined back; only sums per bar are shuffled.
    """
    rows = df.withColumn("_a", F.abs(position))
    shares = with_group(rows, [*by, ts], {"_t": F.sum("_a")})
    return shares.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("_a") > 1e-9, F.col(asset))).alias("n_unique_tickers_held"),
        (F.max(ratio("_a", "_t")) * 100).alias("max_ticker_share_pct"),
        (F.countDistinct(asset) == 1).alias("single_asset"),
    )


def event_window_share(rows: DataFrame, events: DataFrame, *, by: list[str], ts: str = "ts", date: str = "date", days: int = 3) -> DataFrame:
    """Percentage of a strategy's bars within +-`days` of an event."""
    inside = within_event_window(rows, events, ts=ts, date=date, days=days).groupBy(*by).agg(F.count("*").alias("_in"))
    total = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    return total.join(inside, by, "left").select(
        *by, (F.coalesce("_in", F.lit(0)) * 100.0 / F.col("_all")).alias("event_window_pct")
    )
