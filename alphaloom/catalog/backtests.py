"""Queries over bars, positions, backtests and performance."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.ranks import positions
from ..functions.crosssection import with_group
from ..operators import backtest as bt
from ..operators import bars as br
from ..operators import portfolio as pf
from ..plans import strategies as st
from ..plans.tables import hourly_ticks, trade_bars
from .base import query
from .sqltext import (
    BARS, BASKETS, HOURLY, RETS, SIGNALS, STRAT, book_sql, metrics_sql, pct_rank, with_,
)

METRICS = " ".join(bt.METRICS)
BASE = with_(BARS, RETS, SIGNALS, STRAT)


@query("bar_interval_infer", keys="asset interval", ints="n_bars", nums="median_seconds", sql=with_(HOURLY) + """
SELECT asset, n_bars, median_seconds, CASE WHEN n_bars < 10 THEN '1d'
  WHEN median_seconds BETWEEN 0.8 * 60 AND 1.2 * 60 THEN '1m' WHEN median_seconds BETWEEN 0.8 * 300 AND 1.2 * 300 THEN '5m'
  WHEN median_seconds BETWEEN 0.8 * 900 AND 1.2 * 900 THEN '15m' WHEN median_seconds BETWEEN 0.8 * 1800 AND 1.2 * 1800 THEN '30m'
  WHEN median_seconds BETWEEN 0.8 * 3600 AND 1.2 * 3600 THEN '1h' WHEN median_seconds BETWEEN 0.8 * 14400 AND 1.2 * 14400 THEN '4h'
  ELSE '1d' END AS interval
FROM (SELECT asset, count(*) AS n_bars, quantile_cont(gap, 0.5) AS median_seconds
  FROM (SELECT asset, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY asset ORDER BY ts) AS gap FROM hourly) GROUP BY asset)""")
def _(spark, sf):
    return br.infer_interval(hourly_ticks(spark, sf))


@query("bar_annualization", keys="asset interval", ints="annualization crypto", sql=with_(HOURLY) + """
SELECT asset, interval, CASE interval WHEN '1h' THEN 252 * 7 ELSE 252 END AS annualization,
  CASE interval WHEN '1h' THEN 365 * 24 ELSE 365 END AS crypto
FROM (SELECT asset, CASE WHEN count(*) >= 10 AND quantile_cont(gap, 0.5) BETWEEN 2880 AND 4320 THEN '1h' ELSE '1d' END AS interval
  FROM (SELECT asset, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY asset ORDER BY ts) AS gap FROM hourly) GROUP BY asset)""")
def _(spark, sf):
    out = br.infer_interval(hourly_ticks(spark, sf))
    return out.withColumns(
        {"annualization": br.annualization("interval"), "crypto": br.crypto_annualization("interval")}
    )


@query("bar_session_filter", keys="asset ts", nums="close", sql=with_(HOURLY) + """
SELECT asset, ts, close FROM hourly WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'""")
def _(spark, sf):
    return br.in_session(hourly_ticks(spark, sf).df)


@query("cost_bps", keys="asset ts", nums="cost", sql=with_(BARS) + """
SELECT asset, ts, close * volume * 8.0 / 1e4 AS cost FROM bars""")
def _(spark, sf):
    bars = trade_bars(spark, sf).df
    return bars.withColumn("cost", F.col("close") * F.col("volume") * br.cost_bps() / 1e4)


@query("market_impact_bps", keys="asset ts", nums="impact", sql=with_(BARS) + """
SELECT asset, ts, 10.0 * sqrt(greatest(close * volume, 0) / nullif(avg(close * volume) OVER (PARTITION BY asset), 0)) AS impact FROM bars""")
def _(spark, sf):
    bars = trade_bars(spark, sf).df.withColumn("size", F.col("close") * F.col("volume"))
    return with_group(bars, ["asset"], {"adv": F.avg("size")}).withColumn(
        "impact", br.market_impact_bps("size", "adv")
    )


@query("pos_from_signal", keys="asset ts", nums="two_sided long_only short_only", sql=with_(BARS, RETS, SIGNALS) + """
SELECT asset, ts, CASE WHEN z IS NOT NULL THEN greatest(-1, least(1, z)) END AS two_sided,
  CASE WHEN z IS NOT NULL THEN greatest(0, least(1, z)) END AS long_only,
  CASE WHEN z IS NOT NULL THEN greatest(-1, least(0, z)) END AS short_only FROM signals""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf).df
    return rows.select(
        "asset", "ts", bt.from_signal("z").alias("two_sided"),
        bt.from_signal("z", "long").alias("long_only"), bt.from_signal("z", "short").alias("short_only"),
    )


@query("bt_single", keys="strategy_id ts", nums="lagged turnover gross net equity", sql=BASE + """
SELECT strategy_id, ts, lagged, turnover, gross, net,
  CASE WHEN net IS NOT NULL THEN product(1 + net) OVER (PARTITION BY strategy_id ORDER BY ts) END AS equity FROM strat""")
def _(spark, sf):
    return bt.equity_curve(st.strategy_returns(st.signal_rows(spark, sf)))


@query("bt_metrics", keys="strategy_id", nums=METRICS, sql=BASE + metrics_sql("strat", "strategy_id"))
def _(spark, sf):
    return bt.performance(st.strategy_returns(st.signal_rows(spark, sf)), turnover="turnover", annualization=st.WEEKS)


@query("bt_portfolio", keys="strategy_id", nums=METRICS + " n_assets mean_gross_exposure mean_net_exposure",
       sql=with_(BARS, RETS, SIGNALS, BASKETS, book_sql("basket_pos")) + f"""
SELECT m.*, CAST((SELECT count(DISTINCT asset) FROM basket_pos) AS DOUBLE) AS n_assets, mean_gross_exposure, mean_net_exposure
FROM ({metrics_sql('book', 'strategy_id')}) m JOIN (SELECT strategy_id, avg(gross_exposure) AS mean_gross_exposure,
  avg(net_exposure) AS mean_net_exposure FROM book GROUP BY 1) e USING (strategy_id)""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf)
    book = rows.with_df(st.basket_positions(rows), keys=("strategy_id", "asset"))
    return pf.portfolio_performance(book, st.CONFIG)


@query("pos_long_short_quantile", keys="asset ts", nums="equal_weight signal_weight", sql=with_(BARS, RETS, SIGNALS) + f"""
SELECT asset, ts,
  coalesce(CASE WHEN r >= 0.8 THEN 1.0 / nullif(count(*) FILTER (r >= 0.8) OVER g, 0)
                WHEN r <= 0.2 THEN -1.0 / nullif(count(*) FILTER (r <= 0.2) OVER g, 0) END, 0) AS equal_weight,
  coalesce(CASE WHEN r >= 0.8 THEN 0.5 * c / nullif(sum(abs(c)) FILTER (r >= 0.8) OVER g, 0)
                WHEN r <= 0.2 THEN 0.5 * c / nullif(sum(abs(c)) FILTER (r <= 0.2) OVER g, 0) END, 0) AS signal_weight
FROM (SELECT *, mom - quantile_cont(mom, 0.5) OVER (PARTITION BY ts) AS c, {pct_rank('mom', 'ts')} AS r FROM signals)
WINDOW g AS (PARTITION BY ts)""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf).df
    at = positions(rows, ["ts"], "mom")  # one sort serves both weights
    out = pf.long_short_quantile(rows, "mom", name="equal_weight", at=at)
    return pf.long_short_quantile(out, "mom", weight="signal", name="signal_weight", at=at)


@query("pos_vol_scaled", keys="asset ts", nums="position", sql=with_(BARS, RETS, SIGNALS) + f"""
SELECT asset, ts, coalesce(CASE WHEN r >= 0.8 THEN 1.0 WHEN r <= 0.2 THEN -1.0 ELSE 0.0 END
  * CASE WHEN vol IS NOT NULL THEN coalesce(least(1 / nullif(vol, 0), 20), 20) END, 0) AS position
FROM (SELECT *, {pct_rank('mom', 'ts')} AS r FROM signals)""")
def _(spark, sf):
    return pf.vol_scaled(st.signal_rows(spark, sf).df, "mom", "vol")


@query("bt_reconcile", keys="strategy_id", nums="total_return_gap max_bar_gap_bps agrees", sql=BASE + """
SELECT strategy_id, total_return_gap, max_bar_gap_bps, CASE WHEN abs(total_return_gap) * 1e4 <= 5 THEN 1.0 ELSE 0.0 END AS agrees
FROM (SELECT strategy_id, product(1 + coalesce(net, 0)) - product(1 + coalesce(gross, 0)) AS total_return_gap,
  max(abs(coalesce(net, 0) - coalesce(gross, 0))) * 1e4 AS max_bar_gap_bps FROM strat GROUP BY 1)""")
def _(spark, sf):
    rows = st.strategy_returns(st.signal_rows(spark, sf)).df.fillna(0.0, ["net", "gross"])
    free = rows.select("strategy_id", "ts", F.col("gross").alias("net"))
    return bt.reconcile(rows, free, by=["strategy_id"])


@query("bt_benchmark_strategies", keys="strategy_id ts", nums="net",
       sql=with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos")) + """
SELECT strategy_id, ts, net FROM strat UNION ALL SELECT strategy_id, ts, net FROM book""")
def _(spark, sf):
    return st.trial_matrix(st.signal_rows(spark, sf)).df
