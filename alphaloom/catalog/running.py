"""Queries over audits, risk, the trial ledger, gates, calendars and production."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from ..functions import timeseries as ts
from ..functions.base import Feature, add_feature_panel
from ..operators import calendar as cal
from ..operators import factors as fa
from ..operators import gates as gt
from ..operators import leakage as lk
from ..operators import ledger as lg
from ..operators import production as pr
from ..operators import randomized as rz
from ..operators import relational as rel
from ..operators import risk as rk
from ..operators import significance as sg
from ..operators import splits as sp
from ..plans import strategies as st
from ..plans.tables import table, trade_bars
from ..plans.trials import fills, greek_rows, ledger_events
from .base import query
from .sqltext import (
    BARS, BASKETS, NUMBERED, RETS, SIGNALS, STRAT, W, book_sql, cdf_sql, expected_max, full, metrics_sql,
    moments_sql, trail, with_,
)
from .chance import perm_sql
from .validation import CONC, TRIALS, UNDER, _recursive

BASE = with_(BARS, RETS, SIGNALS, STRAT)

# --- leakage -----------------------------------------------------------------------------


def centred_mean(f):
    return F.avg("close").over(f.rows(-3, 3)) / F.col("close") - 1


FEATURES = {
    "momentum": ts.momentum(12),
    "zscore": ts.rolling_zscore(12),
    "centred": Feature(centred_mean, needs=("close",), back=3, ahead=3),
    "peek": ts.forward_return(1),
}
AUDIT_SQL = f"""feats AS (
  SELECT asset, ts, ret, mom AS momentum, z AS zscore, avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / close - 1 AS centred,
    lead(close) OVER {W} / close - 1 AS peek, lag(ret) OVER {W} AS past, lead(ret) OVER {W} AS future FROM signals
),
long AS (UNPIVOT feats ON momentum, zscore, centred, peek INTO NAME feature VALUE x),
audit AS (
  SELECT asset, feature, CASE WHEN count(past) >= 30 THEN coalesce(abs(corr(x, past)), 0) ELSE 0 END AS past_corr,
    CASE WHEN count(future) >= 30 THEN coalesce(abs(corr(x, future)), 0) ELSE 0 END AS future_corr FROM long GROUP BY 1, 2
),
judged AS (
  SELECT *, CASE WHEN future_corr >= 0.2 THEN 'forward_reference' WHEN past_corr >= 0.05 AND score >= 2 THEN 'future_over_past' END AS reason
  FROM (SELECT *, CASE WHEN past_corr >= 0.05 THEN future_corr / past_corr ELSE future_corr END AS score FROM audit)
)"""


def audited(spark, sf):
    bars = trade_bars(spark, sf).select("close")
    p = add_feature_panel(bars, {**FEATURES, "ret": ts.simple_return()})
    return lk.correlation_audit(p, list(FEATURES), "ret")


@query("feature_set", keys="asset ts", nums="momentum zscore vol range", sql=with_(BARS, RETS, SIGNALS) + f"""
SELECT s.asset, s.ts, mom AS momentum, z AS zscore, vol, r AS range FROM signals s
JOIN (SELECT asset, ts, {full('avg(x)', 'x', trail(12), 12)} AS r FROM (SELECT *, (high - low) / nullif(close, 0) AS x FROM bars)) q USING (asset, ts)""")
def _(spark, sf):
    steps = (
        ("momentum", ts.momentum(12)), ("zscore", ts.rolling_zscore(12)),
        ("vol", ts.realized_volatility(12)), ("range", ts.range_pct(12)),
    )
    return lk.FeaturePipeline(steps).fit_transform(trade_bars(spark, sf))


@query("leakage_corr_audit", keys="asset feature reason", bools="leaky", nums="past_corr future_corr score",
       sql=with_(BARS, RETS, SIGNALS, AUDIT_SQL) + "SELECT *, reason IS NOT NULL AS leaky FROM judged")
def _(spark, sf):
    return audited(spark, sf)


@query("leakage_summary", keys="asset summary", sql=with_(BARS, RETS, SIGNALS, AUDIT_SQL) + """
SELECT asset, CASE WHEN count(reason) = 0 THEN 'OK: ' || count(*) || ' features, no leakage detected.'
  ELSE 'LEAKAGE: ' || count(reason) || ' of ' || count(*) || ' features suspect.' END AS summary FROM judged GROUP BY 1""")
def _(spark, sf):
    return lk.summary(audited(spark, sf), ["asset"])


STRUCT_SQL = f"""rows_ AS (SELECT asset, ts, close, row_number() OVER {W} - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n FROM bars),
full_ AS (
  SELECT *, lag(close, 1) OVER {W} / nullif(lag(close, 13) OVER {W}, 0) - 1 AS momentum,
    avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / close - 1 AS centred, lead(close) OVER {W} / close - 1 AS peek
  FROM rows_ WHERE n >= 60
),
valid AS (SELECT *, row_number() OVER (PARTITION BY asset, feature ORDER BY rn) - 1 AS pos, count(*) OVER (PARTITION BY asset, feature) AS nv
  FROM (UNPIVOT full_ ON momentum, centred, peek INTO NAME feature VALUE x)),
probes AS (
  SELECT v.asset, v.feature, v.rn AS stop_, v.x, p.i FROM valid v JOIN (SELECT unnest(range(0, 20)) AS i) p
  ON nv >= 40 AND pos = CASE WHEN i = 19 THEN nv - 11 ELSE CAST(floor(i * ((nv - 11 - greatest(30, nv // 3)) / 19.0) + greatest(30, nv // 3)) AS BIGINT) END
),
cut AS (
  SELECT p.asset, p.feature, p.i, any_value(p.x) AS x, any_value(p.stop_) AS stop_,
    max(close) FILTER (rn = stop_ - 1) AS p1, max(close) FILTER (rn = stop_ - 13) AS p13, avg(close) FILTER (rn >= stop_ - 3) AS m, max(close) FILTER (rn = stop_) AS c
  FROM probes p JOIN rows_ r ON r.asset = p.asset AND r.rn <= p.stop_ AND r.rn >= p.stop_ - 13 GROUP BY 1, 2, 3
)"""


@query("leakage_structural_audit", keys="asset feature", ints="n_disagree", bools="leaky", nums="score max_diff",
       sql=with_(BARS, STRUCT_SQL) + """
SELECT asset, feature, count(*) FILTER (bad) AS n_disagree, count(*) FILTER (bad) > 0 AS leaky, count(*) FILTER (bad) / 20.0 AS score,
  coalesce(max(d) FILTER (d > 1e-9), 0) AS max_diff
FROM (SELECT *, y IS NULL OR abs(x - y) > 1e-9 AS bad, abs(x - y) AS d FROM (
  SELECT *, CASE feature WHEN 'momentum' THEN p1 / nullif(p13, 0) - 1 WHEN 'centred' THEN m / c - 1 END AS y FROM cut)) GROUP BY 1, 2""")
def _(spark, sf):
    feats = {k: FEATURES[k] for k in ("momentum", "centred", "peek")}
    return lk.structural_audit(trade_bars(spark, sf).select("close"), feats)


# --- risk ---------------------------------------------------------------------------------


@query("risk_position_stats", keys="strategy_id", nums="mean_abs_position max_abs_position fraction_at_max concentration_share", sql=BASE + """
SELECT strategy_id, avg(a) AS mean_abs_position, max(a) AS max_abs_position, avg(CASE WHEN a >= q THEN 1.0 ELSE 0.0 END) AS fraction_at_max,
  CASE WHEN sum(a) > 1e-9 THEN max(a) / sum(a) ELSE 0 END AS concentration_share
FROM (SELECT strategy_id, abs(position) AS a, quantile_cont(abs(position), 0.99) OVER (PARTITION BY strategy_id) AS q FROM strat) GROUP BY 1""")
def _(spark, sf):
    return rk.position_stats(st.strategy_returns(st.signal_rows(spark, sf)).df, by=["strategy_id"])


@query("risk_tail_metrics", keys="strategy_id", ints="max_drawdown_duration_days",
       nums="worst_1d_return worst_5d_return worst_month_return max_drawdown_pct skewness excess_kurtosis",
       sql=with_(BARS, RETS, SIGNALS, STRAT, UNDER) + """
SELECT s.*, max_dd AS max_drawdown_pct, dur AS max_drawdown_duration_days FROM (
  SELECT strategy_id, min(net) AS worst_1d_return, coalesce(min(s5), min(net)) AS worst_5d_return, coalesce(min(s21), min(net)) AS worst_month_return,
    skewness(net) AS skewness, kurtosis(net) AS excess_kurtosis FROM (
    SELECT *, CASE WHEN count(*) OVER a = 5 THEN sum(net) OVER a END AS s5, CASE WHEN count(*) OVER b = 21 THEN sum(net) OVER b END AS s21
    FROM strat WHERE net IS NOT NULL WINDOW a AS (PARTITION BY strategy_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY strategy_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) GROUP BY 1) s JOIN dd USING (strategy_id)""")
def _(spark, sf):
    return rk.tail_metrics(st.strategy_returns(st.signal_rows(spark, sf)))


GREEK_SQL = """greeks AS (
  SELECT 'H' || o_custkey AS hypothesis_id, o_orderdate AS ts, o_orderkey AS k, (cents % 201 - 100) / 10.0 AS delta, (cents % 37 - 18) / 100.0 AS gamma,
    CAST(cents % 4001 - 2000 AS DOUBLE) AS vega, -(cents % 53) / 10.0 AS theta
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
)"""
GREEK_NUMS = " ".join(f"{n}_abs_{g}" for g in rk.GREEKS for n in ("mean", "max"))


@query("risk_greek_summary", keys="hypothesis_id net_vega_sign net_gamma_sign net_delta_sign", nums=GREEK_NUMS, sql=with_(GREEK_SQL) +
       "SELECT hypothesis_id, " + ", ".join(f"{f}(abs({g})) AS {n}_abs_{g}" for g in rk.GREEKS for n, f in (("mean", "avg"), ("max", "max"))) + ", " +
       ", ".join(f"CASE WHEN sum({g}) > 1 THEN 'long' WHEN sum({g}) < -1 THEN 'short' ELSE 'neutral' END AS net_{g}_sign" for g in ("vega", "gamma", "delta")) +
       " FROM greeks GROUP BY 1")
def _(spark, sf):
    return rk.greek_summary(greek_rows(spark, sf), by=["hypothesis_id"], order=["k"])


@query("risk_concentration", keys="strategy_id", ints="n_unique_tickers_held", bools="single_asset", nums="max_ticker_share_pct",
       sql=with_(BARS, RETS, SIGNALS, BASKETS) + """
SELECT strategy_id, count(DISTINCT CASE WHEN abs(position) > 1e-9 THEN asset END) AS n_unique_tickers_held, count(DISTINCT asset) = 1 AS single_asset,
  max(abs(position) / nullif(t, 0)) * 100 AS max_ticker_share_pct
FROM (SELECT *, sum(abs(position)) OVER (PARTITION BY strategy_id, ts) AS t FROM basket_pos) GROUP BY 1""")
def _(spark, sf):
    return rk.concentration(st.basket_positions(st.signal_rows(spark, sf)), by=["strategy_id"])


BOUNDS = "bounds AS (SELECT CAST(min(o_orderdate) AS DATE) AS start_, CAST(max(o_orderdate) AS DATE) AS end_ FROM orders)"
MONTHS = """months AS (SELECT CAST(unnest(generate_series(date_trunc('month', start_), end_, INTERVAL 1 MONTH)) AS DATE) AS m, start_, end_ FROM bounds),
fri AS (SELECT *, m + CAST((5 - dayofweek(m) + 7) % 7 AS INTEGER) AS f1, last_day(m) AS last_ FROM months)"""


def bounds(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").agg(F.min(d).alias("start"), F.max(d).alias("end"))


def _cal_sql(date, label, where="true"):
    t, kind, ticker, details = label
    tick = f"'{ticker}'" if ticker else "CAST(NULL AS VARCHAR)"
    return f"""SELECT CAST({date} AS DATE) AS date, '{t}' AS time_et, '{kind}' AS event_type, {tick} AS ticker, '{details}' AS details
FROM fri WHERE {where} AND CAST({date} AS DATE) BETWEEN start_ AND end_"""


QE = "month(m) IN (3, 6, 9, 12)"
CAL = {
    "cal_opex": (cal.opex, _cal_sql("f1 + 14", cal.OPEX)),
    "cal_triple_witching": (cal.triple_witching, _cal_sql("f1 + 14", cal.WITCHING, QE)),
    "cal_vix_exp": (cal.vix_expirations, _cal_sql("f1 + 12", cal.VIX)),
    "cal_nfp": (cal.payrolls, _cal_sql("f1", cal.NFP)),
    "cal_collar_roll": (cal.collar_rolls, _cal_sql("last_ - CAST(greatest(isodow(last_) - 5, 0) AS INTEGER)", cal.COLLAR, QE)),
}
COLS = "date time_et event_type ticker details"


def _calendar(name):
    fn, sql = CAL[name]
    query(name, keys=COLS, sql=with_(BOUNDS, MONTHS) + sql)(lambda spark, sf: fn(bounds(spark, sf)))


for _name in CAL:
    _calendar(_name)

# Releases and holidays of the whole span, made from the order dates: the first order
# date of each month is a release, dates with an unusually small number of orders are
# market holidays.
MACRO_SQL = """macro AS (
  SELECT min(CAST(o_orderdate AS DATE)) AS date, '14:00' AS time_et, 'fomc' AS event_type, CAST(NULL AS VARCHAR) AS ticker, 'release' AS details
  FROM orders GROUP BY date_trunc('month', o_orderdate)
),
hol AS (
  SELECT d AS date, CAST(NULL AS VARCHAR) AS time_et, CASE WHEN n % 2 = 1 THEN 'market_holiday_half' ELSE 'market_holiday_full' END AS event_type,
    CAST(NULL AS VARCHAR) AS ticker, 'thin' AS details
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) WHERE n <= 2
)"""


def macro_sources(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    none = F.lit(None).cast("string")
    macro = o.groupBy(F.trunc("d", "month").alias("m")).agg(F.min("d").alias("date")).select(
        "date", F.lit("14:00").alias("time_et"), F.lit("fomc").alias("event_type"), none.alias("ticker"), F.lit("release").alias("details")
    )
    thin = o.groupBy("d").agg(F.count("*").alias("n")).filter("n <= 2").select(
        F.col("d").alias("date"), F.when(F.col("n") % 2 == 1, "early_close_1pm").otherwise("full_close").alias("type"), F.lit("thin").alias("status")
    )
    return macro, cal.holidays(thin)


@query("cal_macro_holidays", keys=COLS, sql=with_(MACRO_SQL) + "SELECT * FROM macro UNION ALL SELECT * FROM hol")
def _(spark, sf):
    macro, thin = macro_sources(spark, sf)
    b = bounds(spark, sf)
    return cal.between(macro, b).unionByName(cal.between(thin, b))


UNIFIED = with_(BOUNDS, MONTHS, MACRO_SQL) + " UNION ALL ".join(f"({s})" for _, s in CAL.values()) + " UNION ALL SELECT * FROM macro UNION ALL SELECT * FROM hol"


@query("cal_unified", keys=COLS, sql=UNIFIED)
def _(spark, sf):
    return cal.unified(bounds(spark, sf), *macro_sources(spark, sf))


COLLAR = """records AS (
  SELECT CAST(o_orderdate AS DATE) AS effective_date, max(cents % 5000) / 1.0 AS long_put_strike, min(cents % 4000) / 1.0 AS short_put_strike
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY 1
)"""


def collar_history(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("effective_date")
    ).agg((F.max(cents % 5000) / 1.0).alias("long_put_strike"), (F.min(cents % 4000) / 1.0).alias("short_put_strike"))


@query("cal_collar_strikes", keys="month effective_date", nums="long_put_strike short_put_strike", sql=with_(BOUNDS, MONTHS, COLLAR) + """
SELECT m AS month, effective_date, long_put_strike, short_put_strike FROM months ASOF LEFT JOIN records ON effective_date <= m""")
def _(spark, sf):
    months = cal.months(bounds(spark, sf)).select("month")
    return rel.asof_latest(
        months, collar_history(spark, sf), at="month", effective="effective_date",
        values=["long_put_strike", "short_put_strike"],
    )


@query("risk_event_window", keys="asset", nums="event_window_pct", sql=with_(BARS, BOUNDS, MONTHS) + f"""
SELECT asset, count(*) FILTER (near) * 100.0 / count(*) AS event_window_pct FROM (
  SELECT asset, ts, EXISTS (SELECT 1 FROM ({CAL['cal_opex'][1]}) e WHERE b.ts BETWEEN e.date - 3 AND e.date + 3) AS near FROM bars b) GROUP BY 1""")
def _(spark, sf):
    return rk.event_window_share(trade_bars(spark, sf).df, cal.opex(bounds(spark, sf)), by=["asset"])


# --- ledger ------------------------------------------------------------------------------

LEDGER = """ev AS (
  SELECT o_orderkey AS seq, 'H' || o_custkey AS h, CASE WHEN o_orderkey % 10 < 5 THEN 'record' WHEN o_orderkey % 10 < 7 THEN 'override' ELSE 'deploy' END AS kind,
    o_orderstatus = 'F' AS acc, CASE WHEN o_orderstatus <> 'F' THEN 'gate_' || o_orderstatus END AS why, '{"sharpe_ratio": ' || (cents % 401) || '}' AS metrics,
    CASE WHEN o_orderkey % 17 = 0 THEN '{bad' ELSE '{"index":["1995-01-02","1995-01-09"],"values":[' || (cents % 11) || ',' || (cents % 7) || ']}' END AS rets_json,
    CASE WHEN cents % 2 = 0 THEN 'options' ELSE 'equity' END AS market, CAST(cents % 4 AS DOUBLE) / 2 AS size,
    (['paper', 'live', 'retired', 'archived'])[CAST(o_custkey % 4 AS INTEGER) + 1] AS stat, o_orderpriority AS failure, o_orderdate AS at_
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
),
firsts AS (SELECT *, min(seq) FILTER (kind = 'override') OVER (PARTITION BY h) AS fo, min(seq) FILTER (kind = 'record') OVER (PARTITION BY h) AS fr FROM ev),
early AS (SELECT *, bool_or(coalesce(kind = 'deploy' AND seq > fo AND seq < fr, false)) OVER (PARTITION BY h) AS e,
  sum(CASE WHEN kind = 'record' THEN 1 ELSE 0 END) OVER (PARTITION BY h ORDER BY seq) AS recs FROM firsts),
placed AS (
  SELECT *, CASE WHEN NOT (fo IS NOT NULL AND (fr IS NULL OR fo < fr)) THEN recs WHEN seq < fo THEN 0 WHEN e THEN recs + 1 ELSE greatest(recs, 1) END AS row_ FROM early
),
rowsx AS (SELECT *, unnest(CASE WHEN kind = 'deploy' THEN range(1, CAST(row_ + 1 AS BIGINT)) ELSE [CAST(row_ AS BIGINT)] END) AS trial_no FROM placed WHERE row_ > 0),
state AS (SELECT *, last_value(CASE kind WHEN 'override' THEN true WHEN 'record' THEN acc END IGNORE NULLS) OVER (PARTITION BY h, trial_no ORDER BY seq) AS now_acc FROM rowsx),
trials AS (
  SELECT h AS hypothesis_id, trial_no, min(seq) FILTER (kind <> 'deploy') AS first_seq, arg_min(at_, seq) FILTER (kind <> 'deploy') AS created_at,
    coalesce(max(metrics) FILTER (kind = 'record'), '{}') AS metrics_json, max(rets_json) FILTER (kind = 'record') AS returns_json, max(market) FILTER (kind = 'record') AS market_type,
    arg_max(CASE kind WHEN 'override' THEN true ELSE acc END, seq) FILTER (kind <> 'deploy') AS accepted,
    max(struct_pack(s := seq, v := CASE kind WHEN 'record' THEN why END)) FILTER (kind <> 'deploy').v AS rejection_reason,
    coalesce(max(struct_pack(s := seq, v := CASE kind WHEN 'record' THEN 'archived' ELSE stat END)) FILTER (kind = 'record' OR (kind = 'deploy' AND now_acc)).v, 'override_pending') AS deployment_status,
    coalesce(max(struct_pack(s := seq, v := CASE kind WHEN 'record' THEN 1.0 ELSE size END)) FILTER (kind = 'record' OR (kind = 'deploy' AND now_acc)).v, 1.0) AS size_multiplier,
    CAST(arg_max(at_, seq) FILTER (kind = 'deploy' AND now_acc AND stat = 'paper') AS DATE) AS paper_start_date,
    count(*) FILTER (kind = 'override') AS n_overrides
  FROM state GROUP BY 1, 2
)"""


def trial_rows(spark, sf):
    return lg.trials(ledger_events(spark, sf))


@query("ledger_record", keys="hypothesis_id metrics_json market_type rejection_reason deployment_status",
       ints="trial_no first_seq n_trials_at_time n_overrides", bools="accepted", nums="size_multiplier", sql=with_(LEDGER) +
       "SELECT *, row_number() OVER (ORDER BY first_seq) - 1 AS n_trials_at_time FROM trials")
def _(spark, sf):
    return trial_rows(spark, sf)


@query("ledger_n_trials", ints="n_trials", sql=with_(LEDGER) + "SELECT count(*) AS n_trials FROM trials")
def _(spark, sf):
    return lg.n_trials(trial_rows(spark, sf))


@query("ledger_status", keys="last_trial_date", ints="total_trials accepted_count deployed_strategies override_count", sql=with_(LEDGER) + """
SELECT count(*) AS total_trials, count(*) FILTER (accepted) AS accepted_count, count(*) FILTER (deployment_status IN ('paper', 'live')) AS deployed_strategies,
  count(*) FILTER (n_overrides > 0) AS override_count, CAST(arg_max(created_at, first_seq) AS DATE) AS last_trial_date FROM trials""")
def _(spark, sf):
    return lg.status(trial_rows(spark, sf)).withColumn("last_trial_date", F.col("last_trial_date").cast("date"))


@query("ledger_recent", keys="hypothesis_id verdict deployment_status", ints="first_seq", nums="sharpe", sql=with_(LEDGER) + """
SELECT hypothesis_id, first_seq, coalesce(TRY_CAST(json_extract_string(metrics_json, '$.sharpe_ratio') AS DOUBLE), 0) AS sharpe, deployment_status,
  CASE WHEN accepted THEN 'ACCEPT' ELSE 'REJECT (' || coalesce(nullif(rejection_reason, ''), 'unspec') || ')' END AS verdict
FROM trials ORDER BY first_seq DESC LIMIT 10""")
def _(spark, sf):
    return lg.recent(trial_rows(spark, sf), 10)


@query("ledger_survivors", keys="hypothesis_id deployment_status", ints="trial_no", sql=with_(LEDGER) + "SELECT * FROM trials WHERE accepted")
def _(spark, sf):
    return lg.survivors(trial_rows(spark, sf))


@query("ledger_accepted_returns", keys="hypothesis_id day", ints="trial_no", nums="ret", sql=with_(LEDGER) + """
SELECT hypothesis_id, trial_no, CAST(unnest(CAST(json_extract(returns_json, '$.index') AS VARCHAR[])) AS DATE) AS day, unnest(CAST(json_extract(returns_json, '$.values') AS DOUBLE[])) AS ret
FROM trials WHERE accepted AND deployment_status <> 'retired' AND json_valid(returns_json)""")
def _(spark, sf):
    out = lg.accepted_returns(trial_rows(spark, sf), skip_retired=True)
    return out.withColumn("day", F.col("ts").cast("date"))


@query("ledger_seed", keys="rejection_reason", ints="n_trials n_accepted", sql=with_(LEDGER) + """
SELECT rejection_reason, count(*) AS n_trials, count(*) FILTER (accepted) AS n_accepted FROM (
  SELECT rejection_reason, accepted FROM trials UNION ALL SELECT 'pre_system_seed', false FROM range(0, 30)) GROUP BY 1""")
def _(spark, sf):
    events = ledger_events(spark, sf)
    last = events.agg(F.max("seq")).first()[0] or 0
    both = lg.trials(events.unionByName(lg.seed_events(spark, 30, after=last)))
    return both.groupBy("rejection_reason").agg(
        F.count("*").alias("n_trials"), F.sum(F.col("accepted").cast("bigint")).alias("n_accepted")
    )


@query("ledger_deploy", keys="hypothesis_id deployment_status paper_start_date", ints="trial_no", nums="size_multiplier", sql=with_(LEDGER) + """
SELECT * FROM trials WHERE deployment_status IN ('paper', 'live', 'retired')""")
def _(spark, sf):
    return trial_rows(spark, sf).filter(F.col("deployment_status").isin("paper", "live", "retired"))


@query("ledger_override", keys="hypothesis_id deployment_status rejection_reason", ints="trial_no n_overrides", bools="accepted", sql=with_(LEDGER) + """
SELECT * FROM trials WHERE n_overrides > 0""")
def _(spark, sf):
    return trial_rows(spark, sf).filter("n_overrides > 0")


@query("ledger_overrides_audit", keys="hypothesis_id failure", ints="seq", sql=with_(LEDGER) + "SELECT seq, h AS hypothesis_id, failure FROM ev WHERE kind = 'override'")
def _(spark, sf):
    return lg.overrides_audit(ledger_events(spark, sf))


GREEK_LIMITS = {"delta": 50.0, "vega": 2000.0}


@query("ledger_portfolio_greeks", keys="hypothesis_id breached", ints="trial_no", nums="size delta gamma vega theta", sql=with_(LEDGER, GREEK_SQL, """per AS (
  SELECT hypothesis_id, trial_no, size, g.d * size AS delta, g.g * size AS gamma, g.v * size AS vega, g.t * size AS theta
  FROM (SELECT hypothesis_id, trial_no, coalesce(nullif(size_multiplier, 0), 1) AS size FROM trials WHERE deployment_status IN ('paper', 'live') AND market_type = 'options')
  JOIN (SELECT hypothesis_id, max(struct_pack(a := ts, b := k, d := delta, g := gamma, v := vega, t := theta)) AS g FROM greeks GROUP BY 1) USING (hypothesis_id)
)""") + """
SELECT *, CAST(NULL AS VARCHAR) AS breached FROM per
UNION ALL SELECT NULL, NULL, NULL, d, g, v, t, concat_ws(',', CASE WHEN abs(d) > 50 THEN 'delta' END, CASE WHEN abs(v) > 2000 THEN 'vega' END)
FROM (SELECT coalesce(sum(delta), 0) AS d, coalesce(sum(gamma), 0) AS g, coalesce(sum(vega), 0) AS v, coalesce(sum(theta), 0) AS t FROM per)""")
def _(spark, sf):
    """A row per deployed option strategy and, with hypothesis_id NULL, the net with the limits it breaches."""
    per, net = lg.portfolio_greeks(trial_rows(spark, sf), greek_rows(spark, sf), ts=["ts", "k"], limits=GREEK_LIMITS)
    breached = F.concat_ws(",", *[F.when(F.col(f"{g}_breached"), g) for g in GREEK_LIMITS])
    total = net.select(
        F.lit(None).cast("string").alias("hypothesis_id"), F.lit(None).cast("bigint").alias("trial_no"), F.lit(None).cast("double").alias("size"),
        *[F.col(f"net_{g}").alias(g) for g in ("delta", "gamma", "vega", "theta")], breached.alias("breached"),
    )
    return per.withColumn("breached", F.lit(None).cast("string")).unionByName(total)


# --- gates --------------------------------------------------------------------------------

BOTH = with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"))
CORR = """corrs AS (
  SELECT s.strategy_id AS candidate_id, b.strategy_id AS survivor_id, count(*) AS n_overlap_bars, corr(s.net, b.net) AS correlation
  FROM strat s JOIN book b USING (ts) WHERE s.net IS NOT NULL AND b.net IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30
)"""


def both(spark, sf):
    rows = st.signal_rows(spark, sf)
    return st.strategy_returns(rows).df, st.basket_returns(rows).df


@query("gate_corr_with_survivors", keys="candidate_id survivor_id", ints="n_overlap_bars", nums="correlation abs_correlation",
       sql=with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), CORR) + "SELECT *, abs(correlation) AS abs_correlation FROM corrs WHERE correlation IS NOT NULL")
def _(spark, sf):
    return gt.survivor_correlations(*both(spark, sf))


@query("gate_max_correlation", keys="strategy_id most_correlated", nums="max_correlation",
       sql=with_(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), CORR) + """
SELECT candidate_id AS strategy_id, max(abs(correlation)) AS max_correlation, arg_max(survivor_id, abs(correlation)) AS most_correlated FROM corrs GROUP BY 1""")
def _(spark, sf):
    return gt.max_correlation(*both(spark, sf))


EMAX = repr(expected_max(TRIALS))
DSR_SQL = f"""dsr AS (SELECT strategy_id, 1 - {cdf_sql('z')} AS pvalue FROM (SELECT strategy_id,
  (sr - sqrt(1.0 / (n - 1)) * {EMAX}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + kurt / 4 * sr * sr, 1e-12)) AS z FROM moments))"""
CONC_OUT = """conc AS (SELECT cand AS strategy_id, CASE WHEN count(*) >= 60 THEN coalesce(power(corr(net, s), 2), 0) ELSE 0 END AS c
FROM (SELECT c.strategy_id AS cand, c.ts, any_value(c.net) AS net, sum(b.net * w) AS s FROM strat c JOIN whole USING (ts) JOIN book b USING (ts)
      JOIN weights x ON x.cand = c.strategy_id AND x.strategy_id = b.strategy_id WHERE c.net IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
P_MAX, C_MAX, Q_MAX = 0.999, 0.15, 0.004


@query("gate_evaluate", keys="strategy_id rejection_reason", bools="passes", nums="pvalue max_correlation pca_concentration",
       sql=_recursive(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), CONC, CONC_OUT, CORR, moments_sql(), DSR_SQL) + f"""
SELECT strategy_id, reason IS NULL AS passes, reason AS rejection_reason, CASE WHEN critic THEN pvalue END AS pvalue,
  CASE WHEN critic AND pvalue < {P_MAX} THEN m END AS max_correlation, CASE WHEN early IS NULL THEN c END AS pca_concentration
FROM (SELECT *, coalesce(early, CASE WHEN c >= {Q_MAX} THEN 'pca_concentration=' || printf('%.2f', c) || '>={Q_MAX}' END) AS reason FROM (
  SELECT *, CASE WHEN NOT critic THEN 'critic' WHEN pvalue IS NULL THEN 'dsr_insufficient_data' WHEN pvalue >= {P_MAX} THEN 'deflated_sharpe_pvalue=' || printf('%.3f', pvalue) || '>={P_MAX}'
    WHEN m >= {C_MAX} THEN 'correlation=' || printf('%.2f', m) || '>={C_MAX}' END AS early
  FROM (SELECT DISTINCT strategy_id, right(strategy_id, 1) <> '7' AS critic FROM strat) LEFT JOIN dsr USING (strategy_id)
  LEFT JOIN (SELECT candidate_id AS strategy_id, max(abs(correlation)) AS m FROM corrs GROUP BY 1) USING (strategy_id) LEFT JOIN conc USING (strategy_id)))""")
def _(spark, sf):
    cand, surv = both(spark, sf)
    critic = cand.select("strategy_id").distinct().withColumn("critic_passes", ~F.col("strategy_id").endswith("7"))
    return gt.evaluate(
        cand, critic, surv, n_trials=TRIALS, annualization=st.WEEKS, dsr_max=P_MAX, corr_max=C_MAX, pca_max=Q_MAX
    )


PCA_POS = """pos_whole AS (SELECT strategy_id, ts FROM basket_pos GROUP BY 1, 2),
pos_full AS (SELECT w.strategy_id, w.ts, a.asset, coalesce(p.position, 0) AS position FROM pos_whole w JOIN (SELECT DISTINCT strategy_id, asset FROM basket_pos) a USING (strategy_id)
  LEFT JOIN basket_pos p ON p.strategy_id = w.strategy_id AND p.ts = w.ts AND p.asset = a.asset),
pcov AS (SELECT a.strategy_id AS s, a.asset AS l, b.asset AS r, covar_samp(a.position, b.position) AS c FROM pos_full a JOIN pos_full b USING (strategy_id, ts) GROUP BY 1, 2, 3),
pmat AS (SELECT s, list(row_ ORDER BY l) AS m, sum(tr) AS trace FROM (SELECT s, l, list(c ORDER BY r) AS row_, sum(c) FILTER (l = r) AS tr FROM pcov GROUP BY 1, 2) GROUP BY 1),
ppow AS (
  SELECT 0 AS step, s, list_transform(m, lambda x, i: 1.0 + x[1] + i) AS v, m, trace FROM pmat
  UNION ALL
  SELECT step + 1, s, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))), m, trace FROM (
    SELECT step, s, list_transform(m, lambda row_: list_dot_product(row_, v)) AS u, m, trace FROM ppow WHERE step < 3000)
),
ptop AS (SELECT s AS strategy_id, len(m) AS n_assets, list_dot_product(v, list_transform(m, lambda row_: list_dot_product(row_, v))) / trace AS top_share FROM ppow WHERE step = 3000)"""


@query("gate_pca_positions", keys="strategy_id", ints="n_assets", nums="top_share",
       sql=_recursive(BARS, RETS, SIGNALS, BASKETS, PCA_POS) + "SELECT * FROM ptop")
def _(spark, sf):
    return fa.position_concentration(st.basket_positions(st.signal_rows(spark, sf)), by=["strategy_id"])


FORK_DSR = f"""fork AS (SELECT strategy_id, round(1 - {cdf_sql('z')}, 4) AS dsr_pvalue FROM (SELECT strategy_id, (sr - shape / sqrt(n - 1) * {EMAX}) * sqrt(n - 1) / shape AS z
  FROM (SELECT *, sqrt(greatest(1 - skew * sr + (kurt + 2) / 4 * sr * sr, 1e-12)) AS shape FROM moments)))"""
CHANCE = """chance AS (SELECT strategy_id, CASE WHEN any_value(actual) > quantile_cont(sr, 0.95) THEN 'pass' WHEN any_value(actual) > quantile_cont(sr, 0.5) THEN 'warning' ELSE 'fail' END AS g4
  FROM trials JOIN prof USING (strategy_id) GROUP BY 1)"""


EVERY = "every_ AS (SELECT strategy_id, ts, net FROM strat UNION ALL SELECT strategy_id, ts, net FROM book)"
CORR_EVERY = """corrs AS (
  SELECT s.strategy_id AS candidate_id, b.strategy_id AS survivor_id, corr(s.net, b.net) AS correlation
  FROM every_ s JOIN book b ON s.ts = b.ts AND s.strategy_id <> b.strategy_id WHERE s.net IS NOT NULL AND b.net IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30
)"""
SHARE_MAX = 0.1


@query("gate_evaluate_fork", keys="strategy_id gate_deflated_sharpe gate_correlation gate_pca_concentration gate_vs_random overall first_failure",
       ints="n_assets", nums="dsr_pvalue max_correlation top_share",
       sql=_recursive(BARS, RETS, SIGNALS, STRAT, BASKETS, book_sql("basket_pos"), EVERY, CORR_EVERY, moments_sql("every_"), FORK_DSR, perm_sql(1000, 7), CHANCE, PCA_POS) + f"""
SELECT *, CASE WHEN 'fail' IN (g1, g2, g3, g4) THEN 'fail' WHEN g4 = 'warning' THEN 'warning' ELSE 'pass' END AS overall,
  CASE WHEN g1 = 'fail' THEN 'deflated_sharpe' WHEN g2 = 'fail' THEN 'correlation' WHEN g3 = 'fail' THEN 'pca_concentration' WHEN g4 = 'fail' THEN 'vs_random' END AS first_failure,
  g1 AS gate_deflated_sharpe, g2 AS gate_correlation, g3 AS gate_pca_concentration, g4 AS gate_vs_random
FROM (SELECT strategy_id, dsr_pvalue, m AS max_correlation, coalesce(n_assets, 1) AS n_assets, top_share, coalesce(chance.g4, 'warning') AS g4,
    CASE WHEN dsr_pvalue < 0.95 THEN 'pass' ELSE 'fail' END AS g1, CASE WHEN m < 0.1 THEN 'pass' ELSE 'fail' END AS g2,
    CASE WHEN n_assets > 1 AND NOT top_share < {SHARE_MAX} THEN 'fail' ELSE 'pass' END AS g3
  FROM fork JOIN (SELECT candidate_id AS strategy_id, max(abs(correlation)) AS m FROM corrs GROUP BY 1) USING (strategy_id)
  LEFT JOIN chance USING (strategy_id) LEFT JOIN ptop USING (strategy_id))""")
def _(spark, sf):
    """Single-asset strategies and many-asset books side by side; books have no permutation test, which is a warning."""
    signals = st.signal_rows(spark, sf)
    rows, baskets = st.strategy_returns(signals), st.basket_positions(signals)
    books = checkpointed(st.basket_returns(signals).df.select("strategy_id", "ts", "net"))
    every = rows.df.select("strategy_id", "ts", "net").unionByName(books)
    dsr = sg.deflated_sharpe_fork(sg.moments(every, by=["strategy_id"], min_obs=3), TRIALS, annualization=st.WEEKS)
    held = ("strategy_id", "asset", "ts", "position")
    pca = fa.position_concentration(rows.df.select(*held).unionByName(baskets.select(*held)), by=["strategy_id"])
    chance = rz.permutation_test(rows, n=1000, seed=7, annualization=st.WEEKS)
    return gt.evaluate_fork(dsr, gt.max_correlation(every, books), pca, chance, corr_max=0.1, pca_max=SHARE_MAX)


# --- production ---------------------------------------------------------------------------

FILLS = """fills AS (
  SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS quantity, l_shipdate AS timestamp,
    l_extendedprice * (1 - l_discount) / l_quantity AS fill_price, l_extendedprice * (1 - l_tax) / l_quantity AS arrival_price, l_extendedprice / l_quantity AS decision_price
  FROM lineitem WHERE l_quantity > 0
),
short AS (SELECT *, (fill_price - arrival_price) * side / arrival_price * 1e4 AS a, (fill_price - decision_price) * side / decision_price * 1e4 AS d FROM fills)"""


@query("tca_report", keys="symbol", ints="n_fills", nums="mean_arrival_bps mean_implementation_bps median_arrival_bps p95_arrival_bps", sql=with_(FILLS) + """
SELECT symbol, count(*) AS n_fills, avg(a) AS mean_arrival_bps, avg(d) AS mean_implementation_bps, quantile_cont(a, 0.5) AS median_arrival_bps, quantile_cont(a, 0.95) AS p95_arrival_bps
FROM short GROUP BY GROUPING SETS ((symbol), ())""")
def _(spark, sf):
    return pr.tca_report(fills(spark, sf))


@query("tca_calibrated_cost", keys="kind", nums="cost_bps", sql=with_(FILLS) + """
SELECT 'median' AS kind, quantile_cont(a, 0.5) AS cost_bps FROM short UNION ALL SELECT 'p95', quantile_cont(a, 0.95) FROM short
UNION ALL SELECT 'p80_of_symbols', quantile_cont(m, 0.8) FROM (SELECT avg(a) AS m FROM short GROUP BY symbol)""")
def _(spark, sf):
    f = fills(spark, sf)
    parts = [pr.calibrated_cost(f, p).withColumn("kind", F.lit(k)) for k, p in (("median", 0.5), ("p95", 0.95), ("p80_of_symbols", 0.8))]
    return rel.union_sources(*parts)


@query("tca_slippage_coef", nums="k", sql=with_(FILLS) + """
SELECT sum(sqrt(quantity / adv) * abs(fill_price - arrival_price) / arrival_price * 1e4) / sum(quantity / adv) AS k
FROM fills JOIN (SELECT symbol, avg(v) AS adv FROM (SELECT symbol, CAST(timestamp AS DATE) AS d, sum(quantity) AS v FROM fills GROUP BY 1, 2) GROUP BY 1) USING (symbol)""")
def _(spark, sf):
    f = fills(spark, sf)
    adv = f.groupBy("symbol", F.col("timestamp").cast("date").alias("d")).agg(F.sum("quantity").alias("v")).groupBy("symbol").agg(F.avg("v").alias("adv"))
    return pr.slippage_coefficient(f, adv)


LIVE = with_(BARS, RETS, SIGNALS, STRAT, NUMBERED, """parts AS (SELECT *, rn < floor(0.7 * n) AS is_base, rn >= n - 60 AS is_recent FROM numbered)""",
             "base_rows AS (SELECT * FROM parts WHERE is_base)", "recent AS (SELECT * FROM parts WHERE is_recent AND NOT is_base)")


DIAGNOSIS = LIVE + f"""
SELECT *, CASE WHEN flags = '' THEN 'ok' ELSE 'degraded' END AS status FROM (
  SELECT *, concat_ws(',', CASE WHEN sharpe_ratio_drop < 0.5 THEN 'sharpe_collapse' END, CASE WHEN abs(live_hit_rate - baseline_hit_rate) > 0.05 THEN 'hit_rate_drift' END,
      CASE WHEN live_max_drawdown < baseline_max_drawdown * 1.5 THEN 'drawdown_breach' END) AS flags
  FROM (SELECT l.strategy_id, CAST(l.n_observations AS BIGINT) AS n_live_observations, l.sharpe_ratio AS live_sharpe, b.sharpe_ratio AS baseline_sharpe,
      coalesce(l.sharpe_ratio / nullif(b.sharpe_ratio, 0), CASE WHEN l.sharpe_ratio <= 0 THEN 0.0 ELSE 1.0 END) AS sharpe_ratio_drop,
      l.hit_rate AS live_hit_rate, b.hit_rate AS baseline_hit_rate, l.max_drawdown AS live_max_drawdown, b.max_drawdown AS baseline_max_drawdown
    FROM ({metrics_sql('recent', 'strategy_id')}) l JOIN ({metrics_sql('base_rows', 'strategy_id')}) b USING (strategy_id)))"""


@query("live_diagnose", keys="strategy_id status flags", ints="n_live_observations", nums="live_sharpe baseline_sharpe sharpe_ratio_drop live_hit_rate baseline_hit_rate live_max_drawdown baseline_max_drawdown", sql=DIAGNOSIS)
def _(spark, sf):
    p = st.strategy_returns(st.signal_rows(spark, sf))
    rows = sp.counted(p.with_df(p.df.filter("net IS NOT NULL")))
    early = F.col("rn") < F.floor(0.7 * F.col("n"))
    cut = lambda c: p.with_df(rows.filter(c).drop("rn", "n"))
    return pr.live_diagnose(cut(early), cut(~early), annualization=st.WEEKS)


@query("kill_switch_batch", keys="strategy_id trip_ts trip_reason", bools="tripped", sql=with_(BARS, RETS, SIGNALS, STRAT, UNDER) + """
SELECT strategy_id, t IS NOT NULL AS tripped, t.a AS trip_ts, t.r AS trip_reason FROM (
  SELECT strategy_id, min(struct_pack(a := ts, r := reason)) FILTER (reason IS NOT NULL) AS t FROM (
    SELECT strategy_id, ts, CASE WHEN equity / nullif(peak, 0) - 1 <= -0.95 THEN 'drawdown>95.00%' WHEN net <= -0.9 THEN 'daily_loss>90.00%' WHEN sr < -3 THEN 'sharpe<-3.0' END AS reason
    FROM (SELECT *, CASE WHEN count(*) OVER w = 60 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(252) END AS sr FROM under
          WINDOW w AS (PARTITION BY strategy_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))) GROUP BY 1)""")
def _(spark, sf):
    p = st.strategy_returns(st.signal_rows(spark, sf))
    return pr.kill_switch(
        p.with_df(p.df.filter("net IS NOT NULL")), max_drawdown=0.95, max_loss=0.9, min_sharpe=-3.0
    )


@query("metrics_rollup", keys="event_type", ints="n", nums="counter gauge mean min max p50 p95", sql="""
SELECT event_type, sum(value) AS counter, max(struct_pack(a := ts, b := event_id, v := value)).v AS gauge, count(value) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max,
  (list(value ORDER BY value))[CAST(floor(count(value) / 2) AS BIGINT) + 1] AS p50, (list(value ORDER BY value))[CAST(least(count(value) - 1, floor(count(value) * 0.95)) AS BIGINT) + 1] AS p95
FROM events GROUP BY 1""")
def _(spark, sf):
    return pr.metrics_rollup(table(spark, sf, "events"), by=["event_type"], order=["ts", "event_id"])
