"""Queries against chance: permutations, random rules, bootstraps, skew signals."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.expr import ratio
from ..operators import randomized as rz
from ..operators import signals as sgl
from ..plans import options as op
from ..plans import strategies as st
from ..functions import timeseries as ts
from ..functions.base import add_features
from ..plans.tables import trade_bars
from .base import query
from .sqltext import (
    BARS, RETS, SIGNALS, STRAT, W, base_sql, draw, mixed_sql, sharpe_sql, with_,
)

BASE = with_(BARS, RETS, SIGNALS, STRAT)
TRIALS, SEED = 1000, 7


@query("vr_reconstruct_asset_returns", keys="strategy_id ts", nums="asset_ret", sql=BASE + """
SELECT strategy_id, ts, CASE WHEN abs(lag(position) OVER w) > 1e-6 THEN net / lag(position) OVER w END AS asset_ret
FROM strat WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)""")
def _(spark, sf):
    return rz.reconstruct_asset_returns(st.strategy_returns(st.signal_rows(spark, sf))).df


def perm_sql(n: int, seed: int) -> str:
    return f"""base AS (
  SELECT strategy_id, ts, net, prior, CASE WHEN abs(prior) > 1e-6 THEN net / prior END AS asset_r, coalesce(abs(prior) > 1e-6, false) AS active
  FROM (SELECT *, lag(position) OVER (PARTITION BY strategy_id ORDER BY ts) AS prior FROM strat)
),
prof AS (
  SELECT strategy_id, count(*) AS n_bars, count(*) FILTER (active) AS n_active, count(asset_r) AS n_obs,
    avg(CASE WHEN prior > 0 THEN 1.0 ELSE 0.0 END) FILTER (active) AS long_share, {sharpe_sql('avg(net)', 'stddev_samp(net)')} AS actual
  FROM base GROUP BY 1
),
sizes AS (SELECT strategy_id, row_number() OVER (PARTITION BY strategy_id ORDER BY ts) - 1 AS k, abs(prior) AS size FROM base WHERE active),
open_bars AS (
  SELECT b.strategy_id, row_number() OVER (PARTITION BY b.strategy_id ORDER BY b.ts) - 1 AS bar, coalesce(asset_r, 0) AS r, n_bars, n_active, long_share,
    {base_sql(seed, 'b.strategy_id')} AS base_
  FROM base b JOIN prof p USING (strategy_id) WHERE n_active > 0 AND (asset_r IS NOT NULL OR n_obs < n_active)
),
pool AS (
  SELECT *, {mixed_sql('h1', 'xor(base_, trial)')}, {mixed_sql('h2', 'xor(h1, bar)')}, {mixed_sql('h3', 'xor(h2, 1)')}, {mixed_sql('h4', 'xor(h2, 2)')}
  FROM (SELECT *, unnest(range(1, {n + 1})) AS trial FROM open_bars)
),
picked AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, trial ORDER BY h2, bar) - 1 AS pos FROM pool),
held_bars AS (
  SELECT p.*, CAST(floor(h3 / 4294967296.0 * n_active) AS BIGINT) AS k, CASE WHEN h4 / 4294967296.0 < long_share THEN 1.0 ELSE -1.0 END AS side
  FROM picked p WHERE pos < n_active
),
trials AS (
  SELECT strategy_id, trial, CASE WHEN q - s * s / n > 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(52) ELSE 0 END AS sr FROM (
    SELECT strategy_id, trial, sum(size * side * r) AS s, sum(power(size * side * r, 2)) AS q, any_value(n_bars) AS n
    FROM held_bars JOIN sizes USING (strategy_id, k) GROUP BY 1, 2)
)"""


@query("vr_permutation", keys="strategy_id status verdict", ints="n_active_bars",
       nums="actual_sharpe random_sharpe_mean random_sharpe_std random_sharpe_p50 random_sharpe_p95 actual_percentile",
       sql=with_(BARS, RETS, SIGNALS, STRAT, perm_sql(TRIALS, SEED)) + """
SELECT p.strategy_id, CASE WHEN n_active > 0 THEN 'ok' ELSE 'error' END AS status, round(actual, 4) AS actual_sharpe,
  round(mean, 4) AS random_sharpe_mean, round(std, 4) AS random_sharpe_std, round(p50, 4) AS random_sharpe_p50,
  round(p95, 4) AS random_sharpe_p95, round(pct, 2) AS actual_percentile, n_active AS n_active_bars,
  CASE WHEN n_active > 0 THEN CASE WHEN actual > p95 THEN 'pass' WHEN actual > p50 THEN 'borderline' ELSE 'fail' END END AS verdict
FROM prof p LEFT JOIN (SELECT strategy_id, avg(sr) AS mean, stddev_samp(sr) AS std, quantile_cont(sr, 0.5) AS p50,
  quantile_cont(sr, 0.95) AS p95, avg(CASE WHEN sr < actual THEN 100.0 ELSE 0.0 END) AS pct FROM trials JOIN prof USING (strategy_id) GROUP BY 1) t
ON p.strategy_id = t.strategy_id""")
def _(spark, sf):
    return rz.permutation_test(st.strategy_returns(st.signal_rows(spark, sf)), n=TRIALS, seed=SEED, annualization=st.WEEKS)


# --- random rules on the feature panel ---------------------------------------------------

FEATURES = ["mom", "z", "vol"]
RULES = 1000


def _rule_sql():
    opts = ", ".join(
        f"struct_pack(o := {draw(0, 9, 'rule_id', repr(f))}, f := '{f}', "
        f"op := CASE WHEN {draw(1, 9, 'rule_id', repr(f))} < 0.5 THEN '>' ELSE '<' END, "
        f"t := -3.0 + 6.0 * {draw(2, 9, 'rule_id', repr(f))})"
        for f in FEATURES
    )
    pick = lambda values, k, seed: f"(list_value({', '.join(map(repr, values))}))[CAST(floor({draw(k, seed, 'rule_id')} * {len(values)}) AS INTEGER) + 1]"
    return f"""rules AS (
  SELECT *, list_slice(list_sort([{opts}]), 1, stages) AS conds FROM (
    SELECT rule_id, {pick((1, 2, 3), 0, 7)} AS stages, {pick(('long', 'short', 'both'), 1, 7)} AS direction, {pick((1, 2, 3, 5, 7), 0, 8)} AS fresh,
      CAST(floor({draw(1, 8, 'rule_id')} * 10) AS INTEGER) + 1 AS hold, {pick(('none', 'short_only', 'both'), 2, 8)} AS trend
    FROM (SELECT unnest(range(0, {RULES})) AS rule_id))
),
sided AS (SELECT *, CASE WHEN direction = 'short' OR (direction = 'both' AND conds[1].op = '<') THEN -1 ELSE 1 END AS sign FROM rules),
flat AS (SELECT rule_id, fresh, len(conds) AS k, unnest(conds) AS c FROM sided),
bars_ AS (SELECT *, row_number() OVER {W} AS rn, lead(ret) OVER {W} AS earned FROM signals),
seen AS (
  SELECT s.asset, r.rule_id, r.c.f AS f, any_value(k) AS k, s.rn + lag AS rn
  FROM bars_ s JOIN flat r ON (CASE r.c.f WHEN 'mom' THEN mom WHEN 'z' THEN z ELSE vol END > r.c.t AND r.c.op = '>')
     OR (CASE r.c.f WHEN 'mom' THEN mom WHEN 'z' THEN z ELSE vol END < r.c.t AND r.c.op = '<'),
  LATERAL (SELECT unnest(range(0, r.fresh)) AS lag) GROUP BY s.asset, r.rule_id, r.c.f, s.rn + lag
),
entry AS (
  SELECT e.asset, e.rule_id, list(e.rn ORDER BY e.rn) AS at_, any_value(hold) AS hold
  FROM (SELECT asset, rule_id, rn FROM seen GROUP BY ALL HAVING count(*) = any_value(k)) e
  JOIN sided USING (rule_id) JOIN bars_ b ON b.asset = e.asset AND b.rn = e.rn
  WHERE NOT (trend = 'both' OR (trend = 'short_only' AND sign < 0)) OR sign(mom) = sign GROUP BY ALL
),
opened AS (
  SELECT asset, rule_id, hold, unnest(list_reduce(list_transform(at_, lambda x: [x]), lambda acc, x:
    CASE WHEN x[1] >= acc[len(acc)] + hold THEN list_concat(acc, x) ELSE acc END)) AS start FROM entry
),
earned_ AS (
  SELECT o.rule_id, sum(earned) AS s, sum(earned * earned) AS q
  FROM (SELECT asset, rule_id, start + unnest(range(0, hold)) AS rn FROM opened) o JOIN bars_ USING (asset, rn) GROUP BY 1
),
scores AS (
  SELECT rule_id, CASE WHEN q - s * s / n > 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(52) ELSE 0 END AS sr FROM (
    SELECT rule_id, coalesce(sign * e.s, 0) AS s, coalesce(e.q, 0) AS q, (SELECT count(ret) FROM signals) AS n FROM sided LEFT JOIN earned_ e USING (rule_id))
)"""


@query("vr_rule_search", keys="verdict", ints="best_rule_id n_rules", nums="actual_sharpe best_random_sharpe actual_vs_best_pct",
       sql=with_(BARS, RETS, SIGNALS, _rule_sql()) + """
SELECT actual AS actual_sharpe, best AS best_random_sharpe, best_rule_id, n_rules,
  CASE WHEN best > 0 THEN round((actual / best - 1) * 100, 2) END AS actual_vs_best_pct,
  CASE WHEN actual >= (CASE WHEN best > 0 THEN best * 1.1 ELSE best + abs(best) * 0.1 + 1e-9 END) THEN 'pass' WHEN actual >= best THEN 'borderline' ELSE 'fail' END AS verdict
FROM (SELECT max(sr) AS best, arg_max(rule_id, sr) AS best_rule_id, count(*) AS n_rules FROM scores),
  (SELECT avg(ret) / stddev_samp(ret) * sqrt(52) AS actual FROM signals)""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf)
    # the rules stand against being long in everything
    actual = rows.df.agg(ratio(F.avg("ret"), F.stddev_samp("ret")) * st.WEEKS**0.5).first()[0]
    return rz.rule_search(
        rows, rz.random_rules(spark, FEATURES, n=RULES, seed=7), actual, ret="ret", trend="mom", annualization=st.WEEKS
    )


@query("vr_block_bootstrap", keys="asset", ints="replicate n_rows", nums="mean std", sql=with_(BARS, RETS) + f"""
SELECT asset, replicate, count(*) AS n_rows, avg(ret) AS mean, stddev_samp(ret) AS std FROM (
  SELECT asset, replicate, (start + j) % n AS rn FROM (
    SELECT *, CAST(floor({draw(0, 7, 'asset', 'replicate', 'b')} * n) AS BIGINT) AS start, unnest(range(0, 5)) AS j FROM (
      SELECT *, unnest(range(0, (n - 1) // 5 + 1)) AS b FROM (
        SELECT asset, n, unnest(range(1, 51)) AS replicate FROM (SELECT asset, count(*) AS n FROM rets GROUP BY 1))))
  WHERE b * 5 + j < n) x
JOIN (SELECT asset, ret, row_number() OVER {W} - 1 AS rn FROM rets) r USING (asset, rn) GROUP BY 1, 2""")
def _(spark, sf):
    bars = trade_bars(spark, sf).select("close")
    p = bars.with_df(add_features(bars, {"ret": ts.simple_return()}))
    out = rz.block_bootstrap(p, value="ret", replicates=50, block=5, seed=7)
    return out.groupBy("asset", "replicate").agg(
        F.count("*").alias("n_rows"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std")
    )


# --- candidate trades ---------------------------------------------------------------------

CAND = """export AS (
  SELECT o_orderkey AS trade_id, 'Brand#' || (o_custkey % 30 + 1) AS ticker, CAST(date_trunc('week', o_orderdate) AS DATE) AS entry,
    CASE WHEN o_orderstatus = 'F' THEN 'ACCEPTED' WHEN o_orderstatus = 'O' THEN 'BLOCKED_IV' WHEN o_orderkey % 3 = 0 THEN 'BLOCKED_BUDGET'
         WHEN o_orderkey % 3 = 1 THEN 'BLOCKED_EARNINGS' ELSE 'BLOCKED_TREND' END AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BULL' ELSE 'BEAR' END AS side,
    CASE WHEN o_orderkey % 2 = 0 THEN 'CONSENSUS SHORT' ELSE 'CONSENSUS LONG' END AS direction,
    (cents % 2001 - 990) / 100.0 / 100.0 AS net,
    CASE o_orderkey % 3 WHEN 0 THEN 'BULL' WHEN 1 THEN 'BEAR' ELSE '' END AS m1, CASE o_custkey % 3 WHEN 0 THEN 'BULL' WHEN 1 THEN 'BEAR' ELSE '' END AS m2,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS stall, CASE WHEN o_custkey % 5 < 2 THEN 'Y' ELSE 'N' END AS divergence,
    CAST(cents % 101 AS DOUBLE) AS iv, CAST(cents % 97 AS DOUBLE) AS rr, CAST(o_custkey % 100 AS DOUBLE) AS put, CAST((o_orderkey * 7) % 100 AS DOUBLE) AS call
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
),
years AS (SELECT greatest((max(entry) - min(entry)) / 365.25, 1e-9) AS y FROM export)"""


def candidates(spark, sf):
    return rz.candidate_panel(op.candidate_trades(spark, sf))


@query("vr_candidate_panel", keys="m1 m2 stall divergence Ticker Entry", ints="trade_id", bools="is_accepted", nums="iv rr put call net",
       sql=with_(CAND) + "SELECT *, status = 'ACCEPTED' AS is_accepted FROM export")
def _(spark, sf):
    return candidates(spark, sf)


@query("vr_trade_sharpe", keys="Status", ints="n_trades", nums="per_trade_sharpe annualized_sharpe", sql=with_(CAND) + """
SELECT status, count(net) AS n_trades, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) AS per_trade_sharpe,
  coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(count(net) / any_value(y)) AS annualized_sharpe FROM export, years GROUP BY 1""")
def _(spark, sf):
    df = candidates(spark, sf)
    return rz.trade_sharpe(df, by=["Status"], years=rz.span_years(df))


@query("vr_filter_value", keys="Status assessment", ints="n_blocked", nums="blocked_mean_net_pct blocked_std_pct blocked_worst_pct", sql=with_(CAND) + """
SELECT b.status, CASE WHEN b.status LIKE '%BUDGET%' OR b.status LIKE '%SECTOR%' THEN 'capital_constraint_not_signal_filter'
  WHEN b.m < 0 THEN 'ADDS_VALUE_blocked_losers' WHEN b.s > 1.5 * a.s OR b.w < 1.8 * a.w THEN 'GOOD_RISK_CONTROL_blocked_high_variance_winners'
  ELSE 'COSTS_ALPHA_blocked_clean_winners' END AS assessment, b.n AS n_blocked, round(b.m, 3) AS blocked_mean_net_pct,
  round(b.s, 3) AS blocked_std_pct, round(b.w, 3) AS blocked_worst_pct
FROM (SELECT status, count(*) AS n, avg(net) * 100 AS m, stddev_samp(net) * 100 AS s, min(net) * 100 AS w FROM export GROUP BY 1) b
JOIN (SELECT stddev_samp(net) * 100 AS s, min(net) * 100 AS w FROM export WHERE status = 'ACCEPTED') a ON b.status <> 'ACCEPTED'""")
def _(spark, sf):
    return rz.filter_value(candidates(spark, sf))


def _cand_rule_sql(n=2000, seed=7):
    parts = []
    for f in ("m1", "m2", "stall", "divergence"):
        vals = f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {f} AS v FROM export))"
        parts.append(f"struct_pack(o := {draw(0, seed + 2, 'rule_id', repr(f))}, f := '{f}', op := '=', t := CAST(NULL AS DOUBLE), "
                     f"v := ({vals})[CAST(floor({draw(2, seed + 2, 'rule_id', repr(f))} * (SELECT count(DISTINCT {f}) FROM export)) AS INTEGER) + 1])")
    for f in ("iv", "rr", "put", "call"):
        lo, hi = (f'(SELECT quantile_cont("{f}", {p}) FROM export)' for p in (0.1, 0.9))
        parts.append(f"struct_pack(o := {draw(0, seed + 2, 'rule_id', repr(f))}, f := '{f}', "
                     f"op := CASE WHEN {draw(1, seed + 2, 'rule_id', repr(f))} < 0.5 THEN '>' ELSE '<' END, "
                     f"t := {lo} + ({hi} - {lo}) * {draw(2, seed + 2, 'rule_id', repr(f))}, v := CAST(NULL AS VARCHAR))")
    num = "CASE r.c.f WHEN 'iv' THEN iv WHEN 'rr' THEN rr WHEN 'put' THEN put ELSE \"call\" END"
    cat = "CASE r.c.f WHEN 'm1' THEN m1 WHEN 'm2' THEN m2 WHEN 'stall' THEN stall ELSE divergence END"
    return f"""rules AS (
  SELECT rule_id, direction, list_slice(list_sort([{', '.join(parts)}]), 1, k) AS conds FROM (
    SELECT rule_id, CAST(floor({draw(0, seed, 'rule_id')} * 4) AS INTEGER) + 1 AS k,
      (['long', 'short', 'both'])[CAST(floor({draw(1, seed, 'rule_id')} * 3) AS INTEGER) + 1] AS direction
    FROM (SELECT unnest(range(0, {n})) AS rule_id))
),
flat AS (SELECT rule_id, upper(direction) AS word, len(conds) AS k, unnest(conds) AS c FROM rules),
hits AS (
  SELECT e.trade_id, any_value(e.net) AS net, r.rule_id FROM export e JOIN flat r ON
    (r.word = 'BOTH' OR contains(e.direction, r.word)) AND
    ((r.c.op = '=' AND {cat} = r.c.v) OR (r.c.op = '>' AND {num} > r.c.t) OR (r.c.op = '<' AND {num} < r.c.t))
  GROUP BY e.trade_id, r.rule_id HAVING count(*) = any_value(k)
),
scores AS (SELECT rule_id, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(count(net) / (SELECT y FROM years)) AS sr
  FROM hits GROUP BY 1 HAVING count(*) >= 50),
base AS (SELECT count(*) AS n_candidates, count(*) FILTER (status = 'ACCEPTED') AS n_accepted, any_value(y) AS y,
  avg(net) FILTER (status = 'ACCEPTED') / stddev_samp(net) FILTER (status = 'ACCEPTED') AS per,
  avg(net) / stddev_samp(net) * sqrt(count(net) / any_value(y)) AS pool FROM export, years),
summary AS (SELECT max(sr) AS best, quantile_cont(sr, 0.5) AS p50, quantile_cont(sr, 0.95) AS p95, count(*) AS n_valid_rules,
  avg(CASE WHEN sr < per * sqrt(n_accepted / y) THEN 100.0 ELSE 0.0 END) AS share FROM scores, base)"""


@query("vr_consensus_rule_search", keys="verdict", ints="n_candidates n_accepted n_valid_rules",
       nums="span_years real_annualized_sharpe real_pertrade_sharpe full_pool_sharpe best_random_sharpe random_sharpe_p50 random_sharpe_p95 real_percentile",
       sql=with_(CAND, _cand_rule_sql()) + """
SELECT n_candidates, n_accepted, n_valid_rules, round(y, 2) AS span_years, round(per * sqrt(n_accepted / y), 4) AS real_annualized_sharpe,
  round(per, 4) AS real_pertrade_sharpe, round(pool, 4) AS full_pool_sharpe, round(best, 4) AS best_random_sharpe, round(p50, 4) AS random_sharpe_p50,
  round(p95, 4) AS random_sharpe_p95, round(share, 2) AS real_percentile,
  CASE WHEN real >= (CASE WHEN best > 0 THEN best * 1.1 ELSE best END) AND real > 0 THEN 'pass' WHEN real >= best THEN 'borderline' ELSE 'fail' END AS verdict
FROM (SELECT *, per * sqrt(n_accepted / y) AS real FROM base, summary)""")
def _(spark, sf):
    return rz.consensus_rule_search(candidates(spark, sf), n=2000, seed=7)


# --- skew signal ----------------------------------------------------------------------------

L = op.LOOKBACK
WT = "(PARTITION BY ticker ORDER BY tradeDate)"
RAW = """raw AS (
  SELECT asset AS ticker, ts AS tradeDate, iv AS iv30d, iv * (1 + 0.05 * (open - close) / close) AS dlt25Iv30d,
    iv * (1 + 0.05 * (high + low - 2 * close) / close) AS dlt75Iv30d, close AS clsPx,
    CASE WHEN CAST(volume AS BIGINT) % 4 = 0 THEN CAST((CAST(volume AS BIGINT) * 7) % 100 AS DOUBLE) END AS ivPct1y
  FROM (SELECT *, 0.2 + 0.1 * (high - low) / close AS iv FROM bars)
),
points AS (
  SELECT *, p - c AS skew, c - p AS rr FROM (SELECT *, c25 - atm AS c, p25 - atm AS p FROM (
    SELECT *, CASE WHEN abs(iv30d) > 3 THEN iv30d ELSE iv30d * 100 END AS atm, CASE WHEN abs(dlt25Iv30d) > 3 THEN dlt25Iv30d ELSE dlt25Iv30d * 100 END AS c25,
      CASE WHEN abs(dlt75Iv30d) > 3 THEN dlt75Iv30d ELSE dlt75Iv30d * 100 END AS p25 FROM raw))
)"""


def _mid(x):
    seen = f"list({x}) OVER (PARTITION BY ticker ORDER BY tradeDate ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING)"
    return f"""CASE WHEN row_number() OVER {WT} > {L} THEN round_even((len(list_filter({seen}, lambda v: v < {x})) + len(list_filter({seen}, lambda v: v = {x})) / 2.0)
      / {L} * 100, 1) END"""


SIGMA = f"""round_even((clsPx - lag(clsPx, 5) OVER {WT}) / nullif(clsPx * (CASE WHEN count(lr) OVER h >= 18 THEN stddev_pop(lr) OVER h END) * sqrt(252) * sqrt(5.0 / 252), 0), 3)"""
UNIVERSE = f"""universe AS (
  SELECT ticker, tradeDate, clsPx, atm AS atmIV, c AS callRaw, p AS putRaw, skew, rr, round_even(skew - lag(skew, 5) OVER {WT}, 2) AS skewDelta,
    {_mid('p')} AS putP, {_mid('c')} AS callP, {_mid('rr')} AS rrP, coalesce(ivPct1y, {_mid('atm')}) AS ivP,
    CASE WHEN ivPct1y IS NOT NULL THEN 'vendor_ivPct1y' ELSE 'local_pctl' END AS ivP_source, {SIGMA} AS sigma
  FROM (SELECT *, ln(clsPx) - ln(lag(clsPx) OVER {WT}) AS lr, count(*) OVER (PARTITION BY ticker) AS rows_ FROM points)
  WHERE rows_ >= {L // 2}
  WINDOW h AS (PARTITION BY ticker ORDER BY tradeDate ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)"""
lo, hi = op.OPTS.zones
FLAGS = f"""corners AS (
  SELECT *, coalesce(putP <= {lo} AND callP >= {hi}, false) AS a1, coalesce(putP >= {hi} AND callP <= {lo}, false) AS b1,
    coalesce(ivP >= {hi} AND rrP >= {hi}, false) AS a2, coalesce(ivP >= {hi} AND rrP <= {lo}, false) AS b2,
    lag(sigma, 3) OVER {WT} AS s0, lag(sigma, 2) OVER {WT} AS s1, lag(sigma, 1) OVER {WT} AS s2,
    lag(skewDelta, 3) OVER {WT} AS d0, lag(skewDelta, 2) OVER {WT} AS d1, lag(skewDelta, 1) OVER {WT} AS d2 FROM universe
),
stages AS (
  SELECT *, bool_or(a1) OVER f AS m1_recent_bull, bool_or(b1) OVER f AS m1_recent_bear, bool_or(a2) OVER f AS m2_recent_bull, bool_or(b2) OVER f AS m2_recent_bear,
    CASE WHEN b1 THEN 'BEAR' WHEN a1 THEN 'BULL' END AS m1_side, CASE WHEN b2 THEN 'BEAR' WHEN a2 THEN 'BULL' END AS m2_side,
    coalesce(least(s0, s1, s2, sigma) >= 1 AND abs(sigma - s0) < 0.3 AND s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND sigma IS NOT NULL, false) AS m3_stall_bull,
    coalesce(greatest(s0, s1, s2, sigma) <= -1 AND abs(sigma - s0) < 0.3 AND s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND sigma IS NOT NULL, false) AS m3_stall_bear,
    coalesce(d0 < 0 AND d1 < 0 AND d2 < 0 AND skewDelta > d2 + 0.2, false) AS m3_div_bull, coalesce(d0 > 0 AND d1 > 0 AND d2 > 0 AND skewDelta < d2 - 0.2, false) AS m3_div_bear
  FROM corners WINDOW f AS (PARTITION BY ticker ORDER BY tradeDate ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
fired AS (
  SELECT *, CASE side WHEN 'BULL' THEN -1 WHEN 'BEAR' THEN 1 ELSE 0 END AS sign FROM (
    SELECT *, CASE WHEN m1_recent_bull AND m2_recent_bull AND (m3_stall_bull OR m3_div_bull) THEN 'BULL'
                   WHEN m1_recent_bear AND m2_recent_bear AND (m3_stall_bear OR m3_div_bear) THEN 'BEAR' END AS side FROM stages)
)"""
FIRED = with_(BARS, RAW, UNIVERSE, FLAGS)


@query("sig_vol_points", keys="ticker tradeDate", nums="atm c25 p25", sql=with_(BARS, RAW) + "SELECT ticker, tradeDate, atm, c25, p25 FROM points")
def _(spark, sf):
    return op.option_panel(spark, sf).df.select(
        "ticker", "tradeDate", sgl.vol_points("iv30d").alias("atm"),
        sgl.vol_points("dlt25Iv30d").alias("c25"), sgl.vol_points("dlt75Iv30d").alias("p25"),
    )


@query("sig_universe", keys="ticker tradeDate ivP_source",
       nums="clsPx atmIV callRaw putRaw skew rr skewDelta putP callP rrP ivP sigma", sql=with_(BARS, RAW, UNIVERSE) + "SELECT * FROM universe")
def _(spark, sf):
    return op.signal_panel(spark, sf).df


@query("sig_sigma_momentum", keys="ticker tradeDate", nums="sigma", sql=with_(BARS, RAW, UNIVERSE) + "SELECT ticker, tradeDate, sigma FROM universe")
def _(spark, sf):
    return add_features(op.option_panel(spark, sf), {"sigma": sgl.sigma_momentum()})


STAGES = "m1_recent_bull m1_recent_bear m2_recent_bull m2_recent_bear m3_stall_bull m3_stall_bear m3_div_bull m3_div_bear"


@query("sig_consensus", keys="ticker tradeDate m1_side m2_side side", bools=STAGES, sql=FIRED + "SELECT * FROM fired")
def _(spark, sf):
    return sgl.consensus(op.signal_panel(spark, sf), op.OPTS)


@query("sig_consensus_fires", keys="ticker tradeDate side direction", ints="sign", nums="putP callP ivP rrP sigma skewDelta clsPx", sql=FIRED + """
SELECT *, CASE side WHEN 'BULL' THEN 'CONSENSUS SHORT' ELSE 'CONSENSUS LONG' END AS direction FROM fired WHERE side IS NOT NULL""")
def _(spark, sf):
    return sgl.consensus_fires(sgl.consensus(op.signal_panel(spark, sf), op.OPTS), ["ticker", "tradeDate"])


H = (5, 10, 21)
LONG = f"""long AS (
  SELECT ticker, tradeDate, clsPx, ivP, side, sign, unnest([5, 10, 21]) AS horizon, unnest([f5, f10, f21]) AS fwd FROM (
    SELECT *, {', '.join(f'lead(clsPx, {h}) OVER {WT} / nullif(clsPx, 0) - 1 AS f{h}' for h in H)} FROM fired)
),
ok AS (SELECT * FROM long WHERE fwd IS NOT NULL AND clsPx >= 1 AND abs(fwd) <= 1.5)"""
CAP = 1.5
BOOTS = 2000


def long_rows(spark, sf):
    flags = op.signal_panel(spark, sf)
    flags = flags.with_df(sgl.consensus(flags, op.OPTS))
    rows = sgl.forward_panel(flags).df.withColumn("sign", sgl.signal_sign())
    return sgl.by_horizon(rows.select("ticker", "tradeDate", "clsPx", "ivP", "side", "sign", "fwd5", "fwd10", "fwd21"))


@query("svr_forward_panel", keys="ticker tradeDate", nums="fwd5 fwd10 fwd21", sql=with_(BARS, RAW) + f"""
SELECT ticker, tradeDate, {', '.join(f'lead(clsPx, {h}) OVER {WT} / nullif(clsPx, 0) - 1 AS fwd{h}' for h in H)} FROM raw""")
def _(spark, sf):
    return sgl.forward_panel(op.option_panel(spark, sf)).df


@query("svr_eligible_pool", ints="horizon n_pool dropped_below_price_floor dropped_extreme_return", sql=with_(BARS, RAW, UNIVERSE, FLAGS, LONG) + f"""
SELECT horizon, count(*) FILTER (fwd IS NOT NULL AND clsPx >= 1 AND abs(fwd) <= {CAP} AND ivP >= 75) AS n_pool,
  count(*) FILTER (fwd IS NOT NULL AND clsPx < 1) AS dropped_below_price_floor,
  count(*) FILTER (fwd IS NOT NULL AND clsPx >= 1 AND abs(fwd) > {CAP}) AS dropped_extreme_return FROM long GROUP BY 1""")
def _(spark, sf):
    return sgl.pool_counts(long_rows(spark, sf), max_abs=CAP, iv_floor=75.0)


BOOT_SQL = f"""pool AS (
  SELECT *, row_number() OVER (PARTITION BY horizon, tradeDate ORDER BY ticker) - 1 AS pick, count(*) OVER (PARTITION BY horizon, tradeDate) AS n_pool,
    {base_sql(1, 'ticker', 'tradeDate', 'horizon')} AS base_ FROM ok
),
draws AS (
  SELECT horizon, tradeDate, replicate, sign, {mixed_sql('h1', 'xor(base_, replicate)')}, {mixed_sql('h2', 'xor(h1, 1)')}, CAST(floor(h2 / 4294967296.0 * n_pool) AS BIGINT) AS pick
  FROM (SELECT *, unnest(range(1, {BOOTS + 1})) AS replicate FROM pool WHERE side IS NOT NULL)
),
boots AS (
  SELECT d.horizon, replicate, avg(d.sign * p.fwd) AS boot_mean, count(*) AS n_used
  FROM draws d JOIN pool p ON p.horizon = d.horizon AND p.tradeDate = d.tradeDate AND p.pick = d.pick GROUP BY 1, 2
)"""
ALL = with_(BARS, RAW, UNIVERSE, FLAGS, LONG, BOOT_SQL)
SUMMARY = """sums AS (SELECT horizon, count(*) AS n, avg(sign * fwd) AS signal_mean, avg(CASE WHEN sign * fwd > 0 THEN 1.0 ELSE 0.0 END) AS signal_hit_rate,
  avg(sign * fwd) / nullif(stddev_pop(sign * fwd), 0) AS signal_sharpe, quantile_cont(sign * fwd, 0.5) AS signal_median FROM ok WHERE side IS NOT NULL GROUP BY 1),
rand AS (SELECT horizon, avg(boot_mean) AS random_mean, stddev_samp(boot_mean) AS random_std,
  (count(*) FILTER (boot_mean >= signal_mean) + 1) / %d.0 AS p_value FROM boots JOIN sums USING (horizon) GROUP BY 1),
verdicts AS (SELECT *, (signal_mean - random_mean) / nullif(random_std, 0) AS z FROM sums JOIN rand USING (horizon))""" % (BOOTS + 1)
VERDICTS = with_(BARS, RAW, UNIVERSE, FLAGS, LONG, BOOT_SQL, SUMMARY)


def svr(spark, sf):
    return sgl.signal_vs_random(op.signal_panel(spark, sf), op.OPTS, n_boot=BOOTS, max_abs=CAP)


@query("svr_date_matched_bootstrap", ints="horizon n", nums="signal_mean signal_hit_rate signal_sharpe signal_median random_mean random_std p_value z",
       sql=VERDICTS + "SELECT * FROM verdicts")
def _(spark, sf):
    return svr(spark, sf)


@query("svr_beat_pool_median", ints="horizon", nums="beat_pool_median_rate", sql=with_(BARS, RAW, UNIVERSE, FLAGS, LONG) + """
SELECT horizon, avg(CASE WHEN sign * fwd > sign * med THEN 1.0 ELSE 0.0 END) AS beat_pool_median_rate
FROM (SELECT *, quantile_cont(fwd, 0.5) OVER (PARTITION BY horizon, tradeDate) AS med FROM ok) WHERE side IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    rows = sgl.eligible(long_rows(spark, sf), max_abs=CAP)
    return sgl.beat_pool_median(rows.filter("side IS NOT NULL"), rows, date="tradeDate")


@query("svr_summary", keys="line", ints="horizon", sql=VERDICTS + """
SELECT horizon, printf('%dd: n=%d  signal=%+.2f%%  random=%+.2f%%  z=%+.2f  p=%.4f  hit=%.1f%%  sharpe=%.3f', horizon, n, signal_mean * 100, random_mean * 100, z, p_value, signal_hit_rate * 100, signal_sharpe) AS line FROM verdicts""")
def _(spark, sf):
    return sgl.summary_lines(svr(spark, sf))


@query("svr_validate_trades", keys="bucket", ints="trades matched fired nonfire side_match stall_match div_match misses_near_corner misses_material",
       sql=with_(BARS, RAW, UNIVERSE, FLAGS, CAND) + """
SELECT bucket, count(*) AS trades, count(*) FILTER (found) AS matched, count(*) FILTER (found AND fside IS NOT NULL) AS fired, count(*) FILTER (found AND fside IS NULL) AS nonfire,
  count(*) FILTER (found AND fside = side) AS side_match, count(*) FILTER (found AND fside IS NOT NULL AND (stall = 'Y') = st) AS stall_match,
  count(*) FILTER (found AND fside IS NOT NULL AND (divergence = 'Y') = dv) AS div_match,
  count(*) FILTER (found AND fside IS DISTINCT FROM side AND near) AS misses_near_corner, count(*) FILTER (found AND fside IS DISTINCT FROM side AND NOT near) AS misses_material
FROM (SELECT e.*, f.ticker IS NOT NULL AS found, f.side AS fside, CASE WHEN f.ticker IS NULL THEN 'missing' WHEN f.prior >= 52 THEN 'warm' ELSE 'cold' END AS bucket,
    CASE WHEN f.side = 'BULL' THEN m3_stall_bull ELSE m3_stall_bear END AS st, CASE WHEN f.side = 'BULL' THEN m3_div_bull ELSE m3_div_bear END AS dv,
    coalesce(abs(putP - 25) < 0.6 OR abs(putP - 75) < 0.6, false) OR coalesce(abs(callP - 25) < 0.6 OR abs(callP - 75) < 0.6, false)
      OR coalesce(abs(ivP - 25) < 0.6 OR abs(ivP - 75) < 0.6, false) OR coalesce(abs(rrP - 25) < 0.6 OR abs(rrP - 75) < 0.6, false) AS near
  FROM export e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY tradeDate) - 1 AS prior FROM fired) f ON f.ticker = e.ticker AND f.tradeDate = e.entry
  WHERE e.status = 'ACCEPTED') GROUP BY 1""")
def _(spark, sf):
    trades = candidates(spark, sf).filter("is_accepted")
    return sgl.validate_trades(op.signal_panel(spark, sf), trades, op.OPTS, warmup=52)
