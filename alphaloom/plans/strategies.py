"""Canned strategies: the trial matrix that validation and gates work on."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..functions import timeseries as ts
from ..functions.base import add_features
from ..operators.backtest import BacktestConfig, run_positions
from ..operators.portfolio import long_short_quantile, portfolio_returns
from .tables import trade_bars

WEEKS = 52
LOOKBACK = 12
CONFIG = BacktestConfig(annualization=WEEKS)


def signal_rows(spark: SparkSession, folder: str) -> Panel:
    """Bars with the return into each bar and the three signals.

    Every strategy and basket reads this table, which is tiny next to the trades
    behind it, so it is checkpointed: the trades are scanned once.
    """
    bars = trade_bars(spark, folder).select("close")
    return bars.with_df(checkpointed(
        add_features(
            bars,
            {
                "ret": ts.simple_return(),
                "mom": ts.momentum(LOOKBACK),
                "z": ts.rolling_zscore(LOOKBACK),
                "vol": ts.realized_volatility(LOOKBACK),
            },
        )
    ))


def asset_positions(rows: Panel) -> Panel:
    """Sign momentum and z-score reversion per asset, both from one pass: each bar
    row becomes one row per strategy."""
    sign = F.coalesce(F.signum("mom"), F.lit(0.0))
    z = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("z")))
    revert = F.coalesce(F.when(F.col("z").isNotNull(), -z / 2.0), F.lit(0.0))
    made = F.explode(
        F.array(
            F.struct(F.concat(F.lit("mom:"), "asset").alias("strategy_id"), sign.alias("position")),
            F.struct(F.concat(F.lit("rev:"), "asset").alias("strategy_id"), revert.alias("position")),
        )
    )
    df = rows.df.select("asset", "ts", "ret", made.alias("s")).select("s.strategy_id", "asset", "ts", "ret", "s.position")
    return rows.with_df(df, keys=("strategy_id",))


def strategy_returns(rows: Panel) -> Panel:
    """(strategy_id, ts): position, lagged, turnover, net."""
    return run_positions(asset_positions(rows), CONFIG)


def basket_positions(rows: Panel) -> DataFrame:
    """Cross-sectional baskets: momentum leaders against laggards, low against high
    volatility.  Each basket keeps every asset of the bar, so books share bars."""
    long = rows.df.select(
        "asset", "ts", "ret",
        F.explode(
            F.array(
                F.struct(F.lit("xs_momentum").alias("strategy_id"), F.col("mom").alias("signal")),
                F.struct(F.lit("low_vol").alias("strategy_id"), (-F.col("vol")).alias("signal")),
                F.struct(F.lit("xs_reversion").alias("strategy_id"), (-F.col("z")).alias("signal")),
            )
        ).alias("s"),
    ).select("s.strategy_id", "asset", "ts", "ret", "s.signal")
    return long_short_quantile(long, "signal", by=("strategy_id", "ts"))


def basket_returns(rows: Panel) -> Panel:
    book = rows.with_df(basket_positions(rows), keys=("strategy_id", "asset"))
    return portfolio_returns(book, CONFIG)


def trial_matrix(rows: Panel) -> Panel:
    """Long (strategy_id, ts, net) matrix of the asset strategies and the baskets."""
    assets = strategy_returns(rows).df.select("strategy_id", "ts", "net")
    books = basket_returns(rows).df.select("strategy_id", "ts", "net")
    return Panel(assets.unionByName(books), keys=("strategy_id",), ts="ts", grain="week")
