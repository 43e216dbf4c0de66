"""Queries over folds, deflated Sharpe ratios, diagnostics and factors."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..functions import timeseries as ts
from ..functions.base import add_features
from ..operators import diagnostics as dg
from ..operators import factors as fa
from ..operators import meta
from ..operators import significance as sg
from ..operators import splits as sp
from ..operators.backtest import performance
from ..plans import strategies as st
from ..plans.tables import trade_bars
from .base import query
from .sqltext import (
    BARS, BASKETS, NUMBERED, RETS, SIGNALS, STRAT, W, book_sql, cdf_sql, expected_max, full,
    metrics_sql, moments_sql, sharpe_sql, with_,
)

BASE = with_(BARS, RETS, SIGNALS, STRAT)
ROWS = with_(BARS, RETS, SIGNALS, STRAT, NUMBERED)
TRAIN, TEST, PURGE = 104, 26, 4
SPAN = TRAIN + TEST + PURGE
TRIALS = 50  # two strategies on each of 25 brands


def strategy_rows(spark, sf):
    return dg.observed(st.strategy_returns(st.signal_rows(spark, sf)))


@query("wf_splits", keys="strategy_id", ints="fold train_start train_end test_start test_end", sql=ROWS + f"""
SELECT strategy_id, fold, fold * {TEST} AS train_start, fold * {TEST} + {TRAIN} AS train_end,
  fold * {TEST} + {TRAIN + PURGE} AS test_start, fold * {TEST} + {SPAN} AS test_end
FROM (SELECT strategy_id, unnest(range(0, CAST(greatest(floor((n - {TRAIN + PURGE}) / {TEST}), 0) AS BIGINT))) AS fold
  FROM (SELECT strategy_id, count(*) AS n FROM numbered GROUP BY 1))""")
def _(spark, sf):
    counts = strategy_rows(spark, sf).df.groupBy("strategy_id").agg(F.count("*").alias("n"))
    return sp.walk_forward_folds(
        counts, train_size=TRAIN, test_size=TEST, purge=PURGE, strict=False
    )


WF_SQL = f"""rows_ AS (
  SELECT asset, ts, close, ret, row_number() OVER {W} - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n FROM rets
),
inside AS (
  SELECT r.*, f.fold FROM rows_ r JOIN (SELECT asset, unnest(range(0, CAST(greatest(floor((n - {TRAIN + PURGE}) / {TEST}), 0) AS BIGINT))) AS fold
    FROM (SELECT asset, count(*) AS n FROM rows_ GROUP BY 1)) f
  ON r.asset = f.asset AND rn >= fold * {TEST} AND rn < fold * {TEST} + {SPAN}
),
tests AS (
  SELECT asset, fold, ts, coalesce(ret, 0) AS ret, coalesce(CAST(sign(m) AS DOUBLE), 0) AS position FROM (
    SELECT *, lag(close, 1) OVER g / nullif(lag(close, 13) OVER g, 0) - 1 AS m
    FROM inside WINDOW g AS (PARTITION BY asset, fold ORDER BY ts))
  WHERE rn >= fold * {TEST} + {TRAIN + PURGE}
),
wf AS (
  SELECT *, lagged * ret - turnover * 8 / 1e4 AS net FROM (
    SELECT *, coalesce(lag(position, 1) OVER g, 0) AS lagged,
      abs(coalesce(lag(position, 1) OVER g, 0) - coalesce(lag(position, 2) OVER g, 0)) AS turnover
    FROM tests WINDOW g AS (PARTITION BY asset, fold ORDER BY ts))
)"""


def walk_forward(spark, sf) -> Panel:
    bars = trade_bars(spark, sf).select("close")
    rows = bars.with_df(add_features(bars, {"ret": ts.simple_return()}))

    def sign_momentum(p: Panel):
        return add_features(p, {"m": ts.momentum(12)}).withColumn("position", F.signum("m"))

    return sp.walk_forward_evaluate(
        rows, sign_momentum, train_size=TRAIN, test_size=TEST, purge=PURGE, config=st.CONFIG
    )


@query("wf_evaluate", keys="asset", ints="fold", nums="sharpe_ratio annualized_return max_drawdown n_observations",
       sql=with_(BARS, RETS, WF_SQL) + "SELECT * FROM (" + metrics_sql("wf", "asset, fold") + ")")
def _(spark, sf):
    return performance(walk_forward(spark, sf), turnover="turnover", annualization=st.WEEKS)


@query("wf_kfold_stability", keys="strategy_id status", ints="n_bars n_negative_folds",
       nums="min_fold_sharpe max_fold_sharpe mean_fold_sharpe", sql=ROWS + f"""
SELECT strategy_id, n AS n_bars, CASE WHEN n >= 40 THEN 'ok' ELSE 'insufficient_data' END AS status,
  CASE WHEN n >= 40 THEN min(s) END AS min_fold_sharpe, CASE WHEN n >= 40 THEN max(s) END AS max_fold_sharpe,
  CASE WHEN n >= 40 THEN round(avg(s) * 1.000000000003, 4) END AS mean_fold_sharpe,
  CASE WHEN n >= 40 THEN count(*) FILTER (s < 0) END AS n_negative_folds
FROM (SELECT strategy_id, n, fold, round({sharpe_sql('avg(net)', 'stddev_samp(net)')}, 4) AS s
  FROM (SELECT *, CASE WHEN rn < (n % 4) * (n // 4 + 1) THEN rn // (n // 4 + 1)
                       ELSE n % 4 + (rn - (n % 4) * (n // 4 + 1)) // (n // 4) END AS fold FROM numbered)
  GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, sf):
    return dg.kfold_stability(st.strategy_returns(st.signal_rows(spark, sf)), k=4, annualization=st.WEEKS)


def _bound(k: str, parts: int) -> str:
    return f"(CASE WHEN {k} >= {parts} THEN n ELSE CAST(floor(({k}) * (CAST(n AS DOUBLE) / {parts})) AS BIGINT) END)"


@query("cv_purged_kfold", keys="strategy_id ts role", ints="fold", sql=ROWS + f"""
SELECT strategy_id, ts, fold, role FROM (
  SELECT *, CASE WHEN rn >= lo AND rn < hi THEN 'test' WHEN NOT (rn >= lo - 4 AND rn < hi + 2) THEN 'train' END AS role
  FROM (SELECT *, {_bound('fold', 5)} AS lo, {_bound('fold + 1', 5)} AS hi
        FROM (SELECT *, unnest(range(0, 5)) AS fold FROM numbered))) WHERE role IS NOT NULL""")
def _(spark, sf):
    rows = sp.counted(strategy_rows(spark, sf))
    return sp.purged_kfold(rows, n_splits=5, purge=4, embargo=2)


COMBOS = """combos AS (
  SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b
  FROM (SELECT unnest(range(0, 6)) AS a) x JOIN (SELECT unnest(range(0, 6)) AS b) y ON a < b
)"""


@query("cv_combinatorial_purged", keys="strategy_id role", ints="fold n_rows first_rn last_rn",
       sql=with_(BARS, RETS, SIGNALS, STRAT, NUMBERED, COMBOS) + f"""
SELECT strategy_id, fold, role, count(*) AS n_rows, min(rn) AS first_rn, max(rn) AS last_rn FROM (
  SELECT *, CASE WHEN (rn >= la AND rn < ha) OR (rn >= lb AND rn < hb) THEN 'test'
                 WHEN NOT ((rn >= la - 4 AND rn < ha + 2) OR (rn >= lb - 4 AND rn < hb + 2)) THEN 'train' END AS role
  FROM (SELECT *, {_bound('a', 6)} AS la, {_bound('a + 1', 6)} AS ha, {_bound('b', 6)} AS lb, {_bound('b + 1', 6)} AS hb
        FROM numbered CROSS JOIN combos)) WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = sp.counted(strategy_rows(spark, sf)).select("strategy_id", "rn", "n")
    roles = sp.combinatorial_purged(rows, n_groups=6, n_test_groups=2, purge=4, embargo=2)
    return roles.groupBy("strategy_id", "fold", "role").agg(
        F.count("*").alias("n_rows"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn")
    )


@query("cv_oos_sharpe", keys="strategy_id", ints="fold n_obs", nums="sharpe",
       sql=with_(BARS, RETS, SIGNALS, STRAT, NUMBERED, COMBOS) + f"""
SELECT strategy_id, fold, count(*) AS n_obs, {sharpe_sql('avg(net)', 'stddev_samp(net)')} AS sharpe
FROM numbered JOIN combos ON (rn >= {_bound('a', 6)} AND rn < {_bound('a + 1', 6)}) OR (rn >= {_bound('b', 6)} AND rn < {_bound('b + 1', 6)})
GROUP BY 1, 2""")
def _(spark, sf):
    rows = sp.counted(strategy_rows(spark, sf))
    return sp.oos_sharpe(rows, by=["strategy_id"], n_groups=6, n_test_groups=2, annualization=st.WEEKS)


# --- deflated Sharpe -----------------------------------------------------------------

MOM = with_(BARS, RETS, SIGNALS, STRAT, moments_sql())
EMAX = repr(expected_max(TRIALS))
SHAPE = "sqrt(greatest(1 - skew * sr + {w} * sr * sr, 1e-12))"


def strategy_moments(spark, sf):
    return sg.moments(st.strategy_returns(st.signal_rows(spark, sf)).df, by=["strategy_id"])


@query("dsr_moments", keys="strategy_id", ints="n", nums="sr skew kurt", sql=MOM + "SELECT * FROM moments")
def _(spark, sf):
    return strategy_moments(spark, sf)


@query("dsr_expected_max", keys="strategy_id", nums="expected_max", sql=MOM +
       f"SELECT strategy_id, sqrt(1.0 / (n - 1)) * {EMAX} AS expected_max FROM moments")
def _(spark, sf):
    return strategy_moments(spark, sf).withColumn(
        "expected_max", sg.expected_max_sharpe(TRIALS, 1.0 / (F.col("n") - 1))
    )


@query("dsr_deflated", keys="strategy_id", ints="n",
       nums="sharpe_ratio expected_max_sharpe deflated_sharpe_ratio z pvalue", sql=MOM + f"""
SELECT *, 1 - {cdf_sql('z')} AS pvalue FROM (SELECT strategy_id, n, sr * sqrt(52) AS sharpe_ratio,
  sqrt(1.0 / (n - 1)) * {EMAX} * sqrt(52) AS expected_max_sharpe, (sr - sqrt(1.0 / (n - 1)) * {EMAX}) * sqrt(52) AS deflated_sharpe_ratio,
  (sr - sqrt(1.0 / (n - 1)) * {EMAX}) * sqrt(n - 1) / {SHAPE.format(w='kurt / 4')} AS z FROM moments)""")
def _(spark, sf):
    return sg.deflated_sharpe(strategy_moments(spark, sf), TRIALS, annualization=st.WEEKS)


@query("dsr_fork", keys="strategy_id", ints="n_bars",
       nums="per_bar_sharpe annualized_sharpe expected_max_sharpe skewness kurtosis z dsr_probability dsr_pvalue", sql=MOM + f"""
SELECT strategy_id, n AS n_bars, round(sr, 5) AS per_bar_sharpe, round(sr * sqrt(52), 4) AS annualized_sharpe,
  round(star, 5) AS expected_max_sharpe, round(skew, 4) AS skewness, round(kurt + 3, 4) AS kurtosis, z,
  round({cdf_sql('z')}, 4) AS dsr_probability, round(1 - {cdf_sql('z')}, 4) AS dsr_pvalue
FROM (SELECT *, (sr - star) * sqrt(n - 1) / shape AS z FROM (SELECT *, shape / sqrt(n - 1) * {EMAX} AS star
  FROM (SELECT *, {SHAPE.format(w='(kurt + 2) / 4')} AS shape FROM moments)))""")
def _(spark, sf):
    stats = sg.moments(st.strategy_returns(st.signal_rows(spark, sf)).df, by=["strategy_id"], min_obs=3)
    return sg.deflated_sharpe_fork(stats, TRIALS, annualization=st.WEEKS)


@query("dsr_probabilistic", keys="strategy_id", nums="z psr", sql=MOM + f"""
SELECT strategy_id, z, {cdf_sql('z')} AS psr FROM (SELECT strategy_id,
  (sr - 0.5 / sqrt(52)) * sqrt(n - 1) / {SHAPE.format(w='kurt / 4')} AS z FROM moments)""")
def _(spark, sf):
    return sg.probabilistic_sharpe(strategy_moments(spark, sf), benchmark_sharpe=0.5, annualization=st.WEEKS)


@query("dsr_trial_variance", keys="family", ints="n_trials", nums="variance", sql=MOM + """
SELECT substr(strategy_id, 1, 3) AS family, count(*) AS n_trials, var_samp(sr) * 52 AS variance FROM moments GROUP BY 1""")
def _(spark, sf):
    df = st.strategy_returns(st.signal_rows(spark, sf)).df.withColumn("family", F.substring("strategy_id", 1, 3))
    return sg.trial_variance(df, trial=["strategy_id"], by=["family"], annualization=st.WEEKS)


# --- diagnostics ---------------------------------------------------------------------

UNDER = """under AS (
  SELECT *, (equity - peak) / nullif(peak, 0) AS dd FROM (
    SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS peak FROM (
      SELECT *, product(1 + net) OVER (PARTITION BY strategy_id ORDER BY ts) AS equity FROM strat WHERE net IS NOT NULL))
),
dd AS (
  SELECT strategy_id, min(worst) AS max_dd, max(len) AS dur FROM (
    SELECT strategy_id, run, min(dd) AS worst, count(*) FILTER (dd < 0) AS len FROM (
      SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy_id ORDER BY ts) AS run FROM under)
    GROUP BY 1, 2) GROUP BY 1
)"""


@query("stats_core", keys="strategy_id", ints="n_bars max_drawdown_duration_bars",
       nums="sharpe_ratio sortino_ratio calmar_ratio annual_return annual_vol max_drawdown_pct skewness excess_kurtosis win_rate",
       sql=with_(BARS, RETS, SIGNALS, STRAT, UNDER) + f"""
SELECT strategy_id, n_bars, round(sharpe, 4) AS sharpe_ratio, round(sortino, 4) AS sortino_ratio,
  round(coalesce(r / nullif(abs(max_dd), 0), 0), 4) AS calmar_ratio, round(r, 5) AS annual_return, round(v, 5) AS annual_vol,
  round(max_dd, 5) AS max_drawdown_pct, dur AS max_drawdown_duration_bars, round(sk, 4) AS skewness, round(ku, 4) AS excess_kurtosis, round(win, 4) AS win_rate
FROM (SELECT strategy_id, count(net) AS n_bars, {sharpe_sql('avg(net)', 'stddev_samp(net)')} AS sharpe,
  {sharpe_sql('avg(net)', 'stddev_samp(CASE WHEN net < 0 THEN net END)')} AS sortino, avg(net) * 52 AS r, stddev_samp(net) * sqrt(52) AS v,
  skewness(net) AS sk, kurtosis(net) AS ku, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win
  FROM strat WHERE net IS NOT NULL GROUP BY 1) JOIN dd USING (strategy_id)""")
def _(spark, sf):
    return dg.core_statistics(st.strategy_returns(st.signal_rows(spark, sf)), annualization=st.WEEKS)


@query("diag_degradation", keys="strategy_id", nums="is_sharpe oos_sharpe degradation", sql=ROWS + f"""
SELECT strategy_id, i AS is_sharpe, o AS oos_sharpe, coalesce(o / nullif(i, 0), 0) AS degradation FROM (
  SELECT strategy_id, {sharpe_sql('avg(net) FILTER (rn < floor(0.7 * n))', 'stddev_samp(net) FILTER (rn < floor(0.7 * n))')} AS i,
    {sharpe_sql('avg(net) FILTER (rn >= floor(0.7 * n))', 'stddev_samp(net) FILTER (rn >= floor(0.7 * n))')} AS o
  FROM numbered GROUP BY 1)""")
def _(spark, sf):
    from ..core.expr import sharpe

    rows = sp.counted(strategy_rows(spark, sf))
    early = F.col("rn") < F.floor(0.7 * F.col("n"))
    part = lambda flag: F.when(flag, F.col("net"))
    out = rows.groupBy("strategy_id").agg(
        sharpe(F.avg(part(early)), F.stddev_samp(part(early)), st.WEEKS).alias("is_sharpe"),
        sharpe(F.avg(part(~early)), F.stddev_samp(part(~early)), st.WEEKS).alias("oos_sharpe"),
    )
    return out.withColumn("degradation", dg.degradation("is_sharpe", "oos_sharpe"))


@query("diag_fold_stability", keys="asset", nums="mean std fraction_positive t_stat n", sql=with_(BARS, RETS, WF_SQL) + f"""
SELECT asset, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS fraction_positive,
  coalesce(avg(s) / nullif(coalesce(stddev_samp(s), 0) / sqrt(count(s)), 0), 0) AS t_stat, CAST(count(s) AS DOUBLE) AS n
FROM (SELECT asset, fold, {sharpe_sql('avg(net)', 'stddev_samp(net)')} AS s FROM wf GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    folds = performance(walk_forward(spark, sf), turnover="turnover", annualization=st.WEEKS)
    return dg.fold_stability(folds, by=["asset"], sharpe_col="sharpe_ratio")


@query("diag_regime_breakdown", keys="strategy_id regime", nums="n_observations ann_return sharpe_ratio hit_rate max_drawdown",
       sql=with_(BARS, RETS, SIGNALS, STRAT, "labelled AS (SELECT *, 'Q' || quarter(ts) AS regime FROM strat)") + """
SELECT strategy_id, regime, n_observations, annualized_return AS ann_return, sharpe_ratio, hit_rate, max_drawdown FROM (
""" + metrics_sql("labelled", "strategy_id, regime") + ")")
def _(spark, sf):
    p = st.strategy_returns(st.signal_rows(spark, sf))
    p = p.with_df(p.df.withColumn("regime", F.concat(F.lit("Q"), F.quarter("ts").cast("string"))))
    return dg.regime_breakdown(p, "regime", annualization=st.WEEKS)


@query("diag_vol_regime", keys="strategy_id regime", ints="n", nums="mean sharpe", sql=ROWS + f"""
SELECT strategy_id, CASE WHEN vol <= q1 THEN 'low_vol' WHEN vol <= q2 THEN 'mid_vol' ELSE 'high_vol' END AS regime,
  avg(net) AS mean, {sharpe_sql('avg(net)', 'stddev_samp(net)')} AS sharpe, count(*) AS n
FROM (SELECT *, quantile_cont(vol, 1.0 / 3) OVER (PARTITION BY strategy_id) AS q1, quantile_cont(vol, 2.0 / 3) OVER (PARTITION BY strategy_id) AS q2
  FROM (SELECT *, {full('stddev_samp(net)', 'net', '(PARTITION BY strategy_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)', 21)} AS vol
        FROM numbered WHERE n >= 30)) WHERE vol IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return dg.volatility_regimes(st.strategy_returns(st.signal_rows(spark, sf)), annualization=st.WEEKS)


# --- factors and meta labels -----------------------------------------------------------

BOOK = with_(BARS, RETS, SIGNALS, BASKETS, book_sql("basket_pos"))
ALL = with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"))
COV = """names AS (SELECT list(s ORDER BY s) AS names FROM (SELECT DISTINCT strategy_id AS s FROM {src})),
whole AS (SELECT ts FROM {src} WHERE net IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT len(names) FROM names)),
cov AS (
  SELECT a.strategy_id AS l, b.strategy_id AS r, covar_samp(a.net, b.net) AS c
  FROM {src} a JOIN {src} b USING (ts) JOIN whole USING (ts) GROUP BY 1, 2
),
mat AS (SELECT list(row_ ORDER BY l) AS m, sum(tr) AS trace FROM (
  SELECT l, list(c ORDER BY r) AS row_, sum(c) FILTER (l = r) AS tr FROM cov GROUP BY l)),
pow AS (
  SELECT 0 AS step, list_transform(m, lambda x: 1.0 + x[1]) AS v, m, trace FROM mat
  UNION ALL
  SELECT step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))), m, trace FROM (
    SELECT step, list_transform(m, lambda row_: list_dot_product(row_, v)) AS u, m, trace FROM pow WHERE step < 400)
),
pc AS (SELECT v, list_dot_product(v, list_transform(m, lambda row_: list_dot_product(row_, v))) AS lam, trace FROM pow WHERE step = 400)"""


def _recursive(*ctes):
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("factor_pca", keys="strategy_id", nums="abs_loading top_share",
       sql=_recursive(BARS, RETS, SIGNALS, BASKETS, book_sql("basket_pos"), COV.format(src="book")) + """
SELECT unnest(names) AS strategy_id, unnest(list_transform(v, lambda x: abs(x))) AS abs_loading, lam / trace AS top_share FROM pc, names""")
def _(spark, sf):
    out = fa.pca_table(st.basket_returns(st.signal_rows(spark, sf)).df)
    top = F.max(F.when(F.col("component") == 0, F.col("explained_share")))
    share = out.agg(top.alias("top_share"))
    return out.select("strategy_id", F.abs("pc1_loading").alias("abs_loading")).withColumn(
        "top_share", F.lit(share.first()[0])
    )


@query("factor_covariance", keys="series_a series_b", nums="cov", sql=_recursive(
    BARS, RETS, SIGNALS, BASKETS, book_sql("basket_pos"), COV.format(src="book")) +
    'SELECT l AS series_a, r AS series_b, c AS cov FROM cov WHERE l <= r')
def _(spark, sf):
    return fa.covariance(st.basket_returns(st.signal_rows(spark, sf)).df)


CONC = """whole AS (SELECT ts FROM book WHERE net IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT strategy_id) FROM book)),
cov AS (
  SELECT c.strategy_id AS cand, a.strategy_id AS l, b.strategy_id AS r, covar_samp(a.net, b.net) AS c, count(*) AS n
  FROM strat c JOIN book a USING (ts) JOIN book b USING (ts) JOIN whole USING (ts) WHERE c.net IS NOT NULL GROUP BY 1, 2, 3
),
mat AS (SELECT cand, list(row_ ORDER BY l) AS m FROM (SELECT cand, l, list(c ORDER BY r) AS row_ FROM cov GROUP BY 1, 2) GROUP BY 1),
pow AS (
  SELECT 0 AS step, cand, list_transform(m, lambda x: 1.0 + x[1]) AS v, m FROM mat
  UNION ALL
  SELECT step + 1, cand, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))), m FROM (
    SELECT step, cand, list_transform(m, lambda row_: list_dot_product(row_, v)) AS u, m FROM pow WHERE step < 400)
),
weights AS (SELECT cand, unnest((SELECT list(s ORDER BY s) FROM (SELECT DISTINCT strategy_id AS s FROM book))) AS strategy_id, unnest(v) AS w FROM pow WHERE step = 400)"""


@query("factor_concentration", keys="strategy_id", nums="concentration",
       sql=_recursive(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), CONC) + """
SELECT cand AS strategy_id, CASE WHEN count(*) >= 60 THEN coalesce(power(corr(net, s), 2), 0) ELSE 0 END AS concentration
FROM (SELECT c.strategy_id AS cand, c.ts, any_value(c.net) AS net, sum(b.net * w) AS s FROM strat c JOIN whole USING (ts) JOIN book b USING (ts)
      JOIN weights x ON x.cand = c.strategy_id AND x.strategy_id = b.strategy_id WHERE c.net IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf)
    return fa.concentration(st.strategy_returns(rows).df, st.basket_returns(rows).df)


MARKET = "market AS (SELECT ts, avg(ret) AS mkt FROM rets WHERE ret IS NOT NULL GROUP BY ts)"


def with_factors(spark, sf):
    """Strategy returns with two factor columns: the mean asset return of the bar
    and the low-volatility basket.  Both factor tables have one row per bar."""
    signals = st.signal_rows(spark, sf)
    rows = st.strategy_returns(signals).df
    market = signals.df.groupBy("ts").agg(F.avg("ret").alias("mkt"))
    lowvol = st.basket_returns(signals).df.filter("strategy_id = 'low_vol'").select("ts", F.col("net").alias("lowvol"))
    return rows.join(market, "ts").join(lowvol, "ts")


@query("factor_attribution", keys="strategy_id", ints="n_observations",
       nums="alpha annualized_alpha beta_mkt beta_lowvol t_mkt t_lowvol r_squared",
       sql=with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), MARKET) + """
SELECT strategy_id, n AS n_observations, my - b1 * m1 - b2 * m2 AS alpha, (my - b1 * m1 - b2 * m2) * 52 AS annualized_alpha,
  b1 AS beta_mkt, b2 AS beta_lowvol, b1 / sqrt(s2 / (n * (s11 - s12 * s12 / s22))) AS t_mkt, b2 / sqrt(s2 / (n * (s22 - s12 * s12 / s11))) AS t_lowvol, r2 AS r_squared
FROM (SELECT *, n * syy * (1 - r2) / (n - 3) AS s2 FROM (SELECT *, (b1 * s1y + b2 * s2y) / syy AS r2 FROM (
  SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
    SELECT s.strategy_id, count(*) AS n, avg(s.net) AS my, avg(mkt) AS m1, avg(b.net) AS m2, var_pop(s.net) AS syy, var_pop(mkt) AS s11, var_pop(b.net) AS s22,
      covar_pop(mkt, b.net) AS s12, covar_pop(mkt, s.net) AS s1y, covar_pop(b.net, s.net) AS s2y
    FROM strat s JOIN market USING (ts) JOIN book b ON b.ts = s.ts AND b.strategy_id = 'low_vol' WHERE s.net IS NOT NULL GROUP BY 1 HAVING count(*) >= 60))))""")
def _(spark, sf):
    return fa.attribution(with_factors(spark, sf), ["mkt", "lowvol"], by=["strategy_id"], annualization=st.WEEKS)


@query("factor_attribution_single", keys="strategy_id", ints="n_observations", nums="alpha beta r_squared",
       sql=with_(BARS, RETS, SIGNALS, STRAT, MARKET) + """
SELECT strategy_id, count(*) AS n_observations, regr_intercept(net, mkt) AS alpha, regr_slope(net, mkt) AS beta, power(corr(net, mkt), 2) AS r_squared
FROM strat JOIN market USING (ts) WHERE net IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    signals = st.signal_rows(spark, sf)
    rows = st.strategy_returns(signals).df
    market = signals.df.groupBy("ts").agg(F.avg("ret").alias("mkt"))
    return fa.single_factor(rows.join(market, "ts"), "mkt", by=["strategy_id"])


META_SQL = f"""meta AS (
  SELECT asset, ts, CAST(sign(mom) AS DOUBLE) AS side, lead(close, 4) OVER {W} / nullif(close, 0) - 1 AS fwd, z, vol,
    1 / (1 + exp(-z)) AS p FROM signals
)"""


def meta_rows(spark, sf):
    bars = trade_bars(spark, sf)
    df = add_features(
        bars,
        {"mom": ts.momentum(12), "z": ts.rolling_zscore(12), "vol": ts.realized_volatility(12), "fwd": ts.forward_return(4)},
    )
    return df.withColumn("side", F.signum("mom")).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))


@query("meta_targets", keys="asset ts", nums="target", sql=with_(BARS, RETS, SIGNALS, META_SQL) + """
SELECT asset, ts, CASE WHEN side IS NOT NULL THEN CASE WHEN side * fwd > 0 THEN 1.0 ELSE 0.0 END END AS target FROM meta""")
def _(spark, sf):
    return meta_rows(spark, sf).withColumn("target", meta.targets())


META_FOLDS, NEWTON_STEPS = 5, 9


def _newton_sql() -> str:
    """Newton steps of the penalised likelihood per fold, three coefficients, written out step by step."""
    ctes = [f"""folded AS (
  SELECT *, CASE WHEN rn >= lo AND rn < hi THEN 'test' WHEN NOT (rn >= lo - 4 AND rn < hi + 4) THEN 'train' END AS role
  FROM (SELECT *, {_bound('fold', META_FOLDS)} AS lo, {_bound('fold + 1', META_FOLDS)} AS hi FROM (
    SELECT *, row_number() OVER {W} - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n, unnest(range(0, {META_FOLDS})) AS fold FROM meta))
),
train AS (
  SELECT fold, z, vol, CASE WHEN side * fwd > 0 THEN 1.0 ELSE 0.0 END AS y FROM folded
  WHERE role = 'train' AND side IS NOT NULL AND fwd IS NOT NULL AND z IS NOT NULL AND vol IS NOT NULL
),
b0 AS (SELECT fold, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM train GROUP BY 1)"""]
    for k in range(NEWTON_STEPS):
        ctes.append(f"""s{k} AS (
  SELECT fold, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(y - p) AS g0, sum((y - p) * z) - any_value(b) AS g1, sum((y - p) * vol) - any_value(c) AS g2,
    sum(w) AS h00, sum(w * z) AS h01, sum(w * vol) AS h02, sum(w * z * z) + 1 AS h11, sum(w * z * vol) AS h12, sum(w * vol * vol) + 1 AS h22
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(a + b * z + c * vol))) AS p FROM train JOIN b{k} USING (fold))) GROUP BY fold
),
b{k + 1} AS (
  SELECT fold, a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS a,
    b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS c
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d FROM s{k})
)""")
    return ",\n".join(ctes)


@query("meta_fit_predict", keys="asset ts", ints="fold", nums="probability", sql=with_(BARS, RETS, SIGNALS, META_SQL, _newton_sql()) + f"""
SELECT asset, ts, fold, 1 / (1 + exp(-(a + b * z + c * vol))) AS probability FROM folded JOIN b{NEWTON_STEPS} USING (fold) WHERE role = 'test'""")
def _(spark, sf):
    """Each bar is judged by the model of the fold that holds it out; training rows whose forward return
    reaches into the held-out block are purged."""
    rows = Panel(checkpointed(meta_rows(spark, sf).select("asset", "ts", "side", "fwd", "z", "vol")), keys=("asset",), ts="ts", grain="week")
    folds = sp.purged_kfold(sp.counted(rows), n_splits=META_FOLDS, purge=4, embargo=4)
    beta, _gradient = meta.newton_folds(folds.filter("role = 'train'"), ["z", "vol"], META_FOLDS)
    return meta.predict_folds(folds.filter("role = 'test'"), ["z", "vol"], beta)


@query("meta_apply", keys="asset ts", nums="position", sql=with_(BARS, RETS, SIGNALS, META_SQL) + """
SELECT asset, ts, coalesce(side, 0) * CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END AS position FROM meta""")
def _(spark, sf):
    return meta_rows(spark, sf).withColumn("position", meta.apply("side", "p", 0.5))
