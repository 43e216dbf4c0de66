"""Positions to returns, costs and performance, many strategies in one pass."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.expr import clip, ratio, sharpe
from ..core.panel import Frame, Panel
from ..core.scan import cumulative
from .bars import cost_bps


@dataclass(frozen=True)
class BacktestConfig:
    cost_bps: float = cost_bps()
    annualization: float = 252
    execution_lag: int = 1
    bounds: tuple[float, float] = (-1.0, 1.0)

    def __post_init__(self):
        if self.execution_lag < 0:
            raise ValueError("execution_lag must be >= 0")
        if self.bounds[0] >= self.bounds[1]:
            raise ValueError("bounds: low must be below high")


def from_signal(signal: str | Column, direction: str = "both") -> Column:
    """Bound a signal to [-1, 1], long only or short only."""
    low, high = {"both": (-1, 1), "long": (0, 1), "short": (-1, 0)}[direction]
    return clip(signal, low, high)


def run_positions(
    panel: Panel, config: BacktestConfig = BacktestConfig(), *, position: str = "position",
    ret: str = "ret",
) -> Panel:
    """Add lagged, gross, turnover and net for every key of the panel.

    A decision earns the return `execution_lag` bars later; cost is charged on the
    change of the held position.  A NULL return leaves net NULL.
    """
    lag = config.execution_lag
    frame = panel.frame(back=lag + 1)
    held = frame.df.withColumn("_p", F.coalesce(clip(position, *config.bounds), F.lit(0.0)))
    frame = frame.with_df(held)
    now = F.coalesce(frame.lag("_p", lag), F.lit(0.0))
    before = F.coalesce(frame.lag("_p", lag + 1), F.lit(0.0))
    df = held.withColumns({"lagged": now, "turnover": F.abs(now - before)}).drop("_p")
    df = df.withColumn("gross", F.col("lagged") * F.col(ret)).withColumn(
        "net", F.col("gross") - F.col("turnover") * (config.cost_bps / 1e4)
    )
    return panel.with_df(frame.core(df))


def with_drawdown(panel: Panel, net: str = "net") -> Frame:
    """Add equity (running product of 1 + net), peak and drawdown."""
    frame = cumulative(panel.frame(), {"equity": ("product", 1 + F.col(net))})
    frame = cumulative(frame, {"peak": ("max", "equity")})
    return frame.with_df(frame.df.withColumn("drawdown", ratio("equity", "peak") - 1))


def equity_curve(panel: Panel, net: str = "net") -> DataFrame:
    """Equity per bar, NULL where the return is."""
    out = with_drawdown(panel, net)
    seen = F.col(net).isNotNull()
    return out.core(
        out.df.withColumns(
            {c: F.when(seen, F.col(c)) for c in ("equity", "peak", "drawdown")}
        )
    )


METRICS = (
    "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio",
    "max_drawdown", "calmar_ratio", "hit_rate", "n_observations", "annual_turnover",
)


def metric_columns(net: str, annualization: float, risk_free: float = 0.0, turnover: str | None = None
                   ) -> dict[str, Column]:
    """Aggregates behind the headline metrics; `drawdown` must be a column."""
    x = F.col(net)
    excess = x - risk_free / annualization
    down = F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(excess, F.lit(0.0)), 2))))
    root = math.sqrt(annualization)
    return {
        "n_observations": F.count(x).cast("double"),
        "annualized_return": F.avg(x) * annualization,
        "annualized_volatility": F.stddev_samp(x) * root,
        "sharpe_ratio": sharpe(F.avg(excess), F.stddev_samp(excess), annualization),
        "sortino_ratio": F.coalesce(ratio(F.avg(excess), down) * root, F.lit(0.0)),
        "max_drawdown": F.min(F.when(x.isNotNull(), F.col("drawdown"))),
        "hit_rate": F.avg((x > 0).cast("double")),
        "annual_turnover": (F.avg(turnover) * annualization if turnover else F.lit(0.0)),
    }


def performance(
    panel: Panel, *, by: tuple[str, ...] | None = None, net: str = "net",
    turnover: str | None = None, annualization: float = 252, risk_free: float = 0.0,
) -> DataFrame:
    """The nine headline metrics per group; all zero below two returns."""
    by = panel.keys if by is None else by
    rows = with_drawdown(panel, net)
    out = rows.core().groupBy(*by).agg(
        *[c.alias(n) for n, c in metric_columns(net, annualization, risk_free, turnover).items()]
    )
    calmar = F.when(
        F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")
    ).otherwise(0.0)
    out = out.withColumn("calmar_ratio", calmar)
    enough = F.col("n_observations") >= 2
    return out.select(*by, *[F.when(enough, F.col(m)).otherwise(0.0).alias(m) for m in METRICS])


def reconcile(left: DataFrame, right: DataFrame, *, by: list[str], ts: str = "ts",
              ret: str = "net", tolerance_bps: float = 5.0) -> DataFrame:
    """Compare two return tables of the same strategies bar by bar."""
    both = left.select(*by, ts, F.col(ret).alias("_a")).join(
        right.select(*by, ts, F.col(ret).alias("_b")), [*by, ts]
    )
    gap = F.product(1 + F.col("_a")) - F.product(1 + F.col("_b"))
    return both.groupBy(*by).agg(
        gap.alias("total_return_gap"),
        (F.max(F.abs(F.col("_a") - F.col("_b"))) * 1e4).alias("max_bar_gap_bps"),
        (F.abs(gap) * 1e4 <= tolerance_bps).cast("double").alias("agrees"),
    )
