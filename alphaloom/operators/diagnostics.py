"""Robustness diagnostics of return series."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.expr import bias_corrected_kurtosis, bias_corrected_skew, full_frame, join_groups, ratio, sharpe
from ..core.panel import Panel
from ..core.ranks import group_quantiles
from ..core.scan import cumulative
from .backtest import performance, with_drawdown
from .splits import array_split_fold, counted


def observed(panel: Panel, net: str = "net") -> Panel:
    return panel.with_df(panel.df.filter(F.col(net).isNotNull()))


def underwater_runs(panel: Panel, net: str = "net") -> DataFrame:
    """Per key: deepest drawdown and longest run of bars below the running peak.

    A run is labelled by how many bars at the peak came before it, so its length is
    a grouped sum, not a walk along the series.
    """
    frame = with_drawdown(observed(panel, net), net)
    dd = ratio(F.col("equity") - F.col("peak"), "peak")
    frame = frame.with_df(frame.df.withColumns({"_dd": dd, "_low": F.coalesce(dd < 0, F.lit(False))}))
    frame = cumulative(frame, {"_run": ("sum", F.when(F.col("_low"), 0).otherwise(1))})
    runs = frame.core().groupBy(*panel.keys, "_run").agg(
        F.min("_dd").alias("_dd"), F.sum(F.col("_low").cast("bigint")).alias("_len")
    )
    return runs.groupBy(*panel.keys).agg(
        F.min("_dd").alias("max_drawdown"), F.max("_len").alias("drawdown_bars")
    )


def core_statistics(panel: Panel, net: str = "net", annualization: float = 252) -> DataFrame:
    """Rounded headline statistics with downside deviation of losing bars only."""
    x, n = F.col(net), F.count(net)
    root = math.sqrt(annualization)
    lost = F.stddev_samp(F.when(x < 0, x))
    base = panel.df.groupBy(*panel.keys).agg(
        n.alias("n_bars"),
        sharpe(F.avg(x), F.stddev_samp(x), annualization).alias("_sharpe"),
        F.coalesce(ratio(F.avg(x), lost) * root, F.lit(0.0)).alias("_sortino"),
        (F.avg(x) * annualization).alias("_ret"),
        (F.stddev_samp(x) * root).alias("_vol"),
        bias_corrected_skew(n, F.skewness(x)).alias("_skew"),
        bias_corrected_kurtosis(n, F.kurtosis(x)).alias("_kurt"),
        F.avg((x > 0).cast("double")).alias("_win"),
    )
    out = base.join(underwater_runs(panel, net), list(panel.keys))
    calmar = F.coalesce(ratio("_ret", F.abs("max_drawdown")), F.lit(0.0))
    return out.select(
        *panel.keys,
        "n_bars",
        F.round("_sharpe", 4).alias("sharpe_ratio"),
        F.round("_sortino", 4).alias("sortino_ratio"),
        F.round(calmar, 4).alias("calmar_ratio"),
        F.round("_ret", 5).alias("annual_return"),
        F.round("_vol", 5).alias("annual_vol"),
        F.round("max_drawdown", 5).alias("max_drawdown_pct"),
        F.col("drawdown_bars").alias("max_drawdown_duration_bars"),
        F.round("_skew", 4).alias("skewness"),
        F.round("_kurt", 4).alias("excess_kurtosis"),
        F.round("_win", 4).alias("win_rate"),
    )


def kfold_stability(panel: Panel, *, k: int = 4, net: str = "net", annualization: float = 252) -> DataFrame:
    """Sharpe of k contiguous runs; a status row where fewer than 10 k returns exist."""
    rows = counted(observed(panel, net)).withColumn("fold", array_split_fold("rn", "n", k))
    x = F.col(net)
    folds = rows.groupBy(*panel.keys, "n", "fold").agg(
        F.round(sharpe(F.avg(x), F.stddev_samp(x), annualization), 4).alias("s")
    )
    out = folds.groupBy(*panel.keys, "n").agg(
        F.min("s").alias("min_fold_sharpe"),
        F.max("s").alias("max_fold_sharpe"),
        # a mean of four rounded numbers often ends in an exact half: nudge it outwards
        F.round(F.avg("s") * 1.000000000003, 4).alias("mean_fold_sharpe"),
        F.sum((F.col("s") < 0).cast("int")).alias("n_negative_folds"),
    )
    ok = F.col("n") >= 10 * k
    return out.select(
        *panel.keys,
        F.col("n").alias("n_bars"),
        F.when(ok, "ok").otherwise("insufficient_data").alias("status"),
        *[
            F.when(ok, F.col(c)).alias(c)
            for c in ("min_fold_sharpe", "max_fold_sharpe", "mean_fold_sharpe", "n_negative_folds")
        ],
    )


def degradation(in_sample: str, out_of_sample: str):
    """Out-of-sample over in-sample Sharpe, zero without an in-sample one."""
    return F.coalesce(ratio(out_of_sample, in_sample), F.lit(0.0))


def fold_stability(folds: DataFrame, *, by: list[str], sharpe_col: str = "sharpe") -> DataFrame:
    """Mean, deviation, share of positive folds and t statistic of fold Sharpes."""
    s = F.col(sharpe_col)
    n = F.count(s)
    std = F.coalesce(F.stddev_samp(s), F.lit(0.0))
    return folds.groupBy(*by).agg(
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"),
        std.alias("std"),
        F.coalesce(F.avg((s > 0).cast("double")), F.lit(0.0)).alias("fraction_positive"),
        F.coalesce(ratio(F.avg(s), ratio(std, F.sqrt(n.cast("double")))), F.lit(0.0)).alias("t_stat"),
        n.cast("double").alias("n"),
    )


def regime_breakdown(panel: Panel, regime: str, *, net: str = "net", annualization: float = 252) -> DataFrame:
    """Headline metrics per key and supplied regime label."""
    rows = panel.with_df(panel.df.filter(F.col(regime).isNotNull()), keys=panel.keys + (regime,))
    m = performance(rows, net=net, annualization=annualization)
    return m.select(
        *rows.keys, "n_observations", F.col("annualized_return").alias("ann_return"),
        "sharpe_ratio", "hit_rate", "max_drawdown",
    )


def volatility_regimes(panel: Panel, *, window: int = 21, net: str = "net", annualization: float = 252) -> DataFrame:
    """Mean, Sharpe and count in the terciles of trailing volatility, per key."""
    keys = list(panel.keys)
    frame = observed(panel, net).frame(back=window - 1)
    vol = full_frame(F.stddev_samp(net), net, frame.rows(1 - window, 0), window)
    rows = frame.core(frame.df.withColumn("_vol", vol)).filter("_vol IS NOT NULL")
    cuts = group_quantiles(rows, keys, "_vol", {"_q1": 1 / 3, "_q2": 2 / 3})
    enough = panel.df.groupBy(*keys).agg(F.count(net).alias("_n")).filter("_n >= 30").select(*keys)
    label = F.when(F.col("_vol") <= F.col("_q1"), "low_vol").when(
        F.col("_vol") <= F.col("_q2"), "mid_vol").otherwise("high_vol")
    x = F.col(net)
    return (
        join_groups(join_groups(rows, cuts, keys), enough, keys)
        .groupBy(*keys, label.alias("regime"))
        .agg(
            F.avg(x).alias("mean"),
            sharpe(F.avg(x), F.stddev_samp(x), annualization).alias("sharpe"),
            F.count(x).alias("n"),
        )
    )
