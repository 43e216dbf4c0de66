"""Queries over the time-series and cross-section features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from ..functions import crosssection as cs
from ..functions import options as opt
from ..functions import timeseries as ts
from ..functions.base import add_feature_panel, add_features
from ..plans.tables import industries, trade_bars
from .base import query
from .sqltext import BARS, INDUSTRY, RETS, W, full, pct_rank, trail, with_

N = 12          # look-back of the weekly features
LONG = 52       # look-back of the percentile features


def _one(feature, nums="value"):
    def run(spark, sf):
        return add_features(trade_bars(spark, sf), {"value": feature})
    return run


def _ts(name, feature, sql):
    query(name, keys="asset ts", nums="value", sql=with_(BARS, RETS) + sql)(_one(feature))


_ts("ts_momentum", ts.momentum(N),
    f"SELECT asset, ts, lag(close, 1) OVER {W} / nullif(lag(close, {N + 1}) OVER {W}, 0) - 1 AS value FROM bars")
_ts("ts_rolling_zscore", ts.rolling_zscore(N),
    f"""SELECT asset, ts, (lag(close, 1) OVER {W} - {full('avg(close)', 'close', trail(N), N)})
        / nullif({full('stddev_samp(close)', 'close', trail(N), N)}, 0) AS value FROM bars""")
_ts("ts_realized_vol", ts.realized_volatility(N),
    f"""SELECT asset, ts, {full('stddev_samp(lr)', 'lr', trail(N), N)} AS value
        FROM (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM bars)""")
_ts("ts_range_pct", ts.range_pct(N),
    f"""SELECT asset, ts, {full('avg(x)', 'x', trail(N), N)} AS value
        FROM (SELECT *, (high - low) / nullif(close, 0) AS x FROM bars)""")
_ts("ts_parkinson_vol", ts.parkinson_volatility(N),
    f"""SELECT asset, ts, sqrt({full('avg(x)', 'x', trail(N), N)} / (4 * ln(2))) AS value
        FROM (SELECT *, power(ln(high / nullif(low, 0)), 2) AS x FROM bars)""")
_ts("ts_garman_klass_vol", ts.garman_klass_volatility(N),
    f"""SELECT asset, ts, CASE WHEN m >= 0 THEN sqrt(m) END AS value FROM (
        SELECT asset, ts, {full('avg(x)', 'x', trail(N), N)} AS m FROM (
        SELECT *, 0.5 * power(ln(high / nullif(low, 0)), 2)
                  - (2 * ln(2) - 1) * power(ln(close / nullif(open, 0)), 2) AS x FROM bars))""")
_ts("ts_vwap_deviation", ts.vwap_deviation(N),
    f"""SELECT asset, ts, lag(close, 1) OVER {W} / nullif({full('sum(close * volume)', 'close', trail(N), N)}
        / nullif({full('sum(volume)', 'volume', trail(N), N)}, 0), 0) - 1 AS value FROM bars""")
_ts("ts_forward_return", ts.forward_return(4),
    f"SELECT asset, ts, lead(close, 4) OVER {W} / nullif(close, 0) - 1 AS value FROM bars")


@query("ts_ewma", keys="asset ts", nums="value", sql=with_(BARS) + f"""
SELECT asset, ts, CASE WHEN n > 0 THEN (SELECT sum(b.close * CASE WHEN b.rn = 0 THEN power(k, n - 1)
         ELSE (1 - k) * power(k, n - 1 - b.rn) END) FROM (
           SELECT asset, close, row_number() OVER {W} - 1 AS rn FROM bars) b
         WHERE b.asset = a.asset AND b.rn < a.n) END AS value
FROM (SELECT asset, ts, row_number() OVER {W} - 1 AS n, power(0.5, 1.0 / 5) AS k FROM bars) a""")
def _(spark, sf):
    return ts.ewma(trade_bars(spark, sf).select("close"), halflife=5, name="value")


@query("ts_triple_barrier", keys="asset ts", ints="label", sql=with_(BARS) + f"""
SELECT asset, ts, CASE WHEN len(path) = 6 THEN
  CASE WHEN up IS NULL AND down IS NULL THEN 0
       WHEN down IS NULL OR (up IS NOT NULL AND up <= down) THEN 1 ELSE -1 END END AS label
FROM (SELECT *, list_min(list_filter(list_transform(path, lambda x, i: CASE WHEN x >= close * 1.3 THEN i END), lambda x: x IS NOT NULL)) AS up,
             list_min(list_filter(list_transform(path, lambda x, i: CASE WHEN x <= close * 0.8 THEN i END), lambda x: x IS NOT NULL)) AS down
      FROM (SELECT *, list(close) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS path FROM bars))""")
def _(spark, sf):
    return add_features(trade_bars(spark, sf), {"label": ts.triple_barrier(0.3, 0.2, 6)})


_MIDRANK = """(len(list_filter(seen, lambda v: v < {x})) + len(list_filter(seen, lambda v: v = {x})) / 2.0)
  / nullif(len(list_filter(seen, lambda v: v IS NOT NULL)), 0) * 100"""

query("ts_rolling_midrank_pctl", keys="asset ts", nums="value", sql=with_(BARS) + f"""
SELECT asset, ts, CASE WHEN rn > {LONG} AND len(list_filter(seen, lambda v: v IS NOT NULL)) >= {LONG // 2}
       THEN round_even({_MIDRANK.format(x='close')}, 1) END AS value
FROM (SELECT *, row_number() OVER {W} AS rn, list(close) OVER {trail(LONG)} AS seen FROM bars)""")(
    _one(ts.midrank_percentile("close", LONG)))

query("ts_pit_pctl", keys="asset ts", nums="value", sql=with_(BARS) + f"""
SELECT asset, ts, CASE WHEN len(list_filter(seen, lambda v: v IS NOT NULL)) >= 26
       THEN {_MIDRANK.format(x='close')} END AS value
FROM (SELECT *, list(close) OVER {trail(LONG)} AS seen FROM bars)""")(
    _one(ts.midrank_percentile("close", LONG, min_valid=26, padded=True, digits=None)))


# --- option and positioning features ----------------------------------------------
# The bars carry no option data: implied vol, skew, gamma flip and valuation series
# are derived from range, open and volume, so the windows run over real rows.

VOL_SQL = """vol AS (
  SELECT *, (high - low) / close AS iv, abs(close - open) / close AS rv, (open - close) / close AS skew,
         (high + low) / 2 AS flip, volume - 150 AS gex, close / nullif(volume, 0) AS pe, 100 * (high - low) / (high + low) AS vix
  FROM bars
)"""


def vol_bars(spark, sf):
    p = trade_bars(spark, sf)
    c = F.col
    return p.with_df(
        p.df.withColumns(
            {
                "iv": (c("high") - c("low")) / c("close"),
                "rv": F.abs(c("close") - c("open")) / c("close"),
                "skew": (c("open") - c("close")) / c("close"),
                "flip": (c("high") + c("low")) / 2,
                "gex": c("volume") - 150,
                "pe": c("close") / F.nullif(c("volume"), F.lit(0.0)),
                "vix": 100 * (c("high") - c("low")) / (c("high") + c("low")),
            }
        )
    )


def _vol(name, feature, sql):
    def run(spark, sf):
        return add_features(vol_bars(spark, sf), {"value": feature})
    query(name, keys="asset ts", nums="value", sql=with_(BARS, VOL_SQL) + sql)(run)


def _z(x, n, least):
    return f"""(lag({x}, 1) OVER {W} - {full(f'avg({x})', x, trail(n), least)})
        / nullif({full(f'stddev_samp({x})', x, trail(n), least)}, 0)"""


_vol("ts_skew_zscore", opt.skew_zscore("skew", LONG), f"SELECT asset, ts, {_z('skew', LONG, LONG // 2)} AS value FROM vol")
_vol("ts_diff5_lagged", opt.lagged_change("skew", 5),
     f"SELECT asset, ts, lag(skew, 1) OVER {W} - lag(skew, 6) OVER {W} AS value FROM vol")
_vol("ts_vrp_pct", opt.vrp_percentile("iv", "rv", LONG, 26), f"""
SELECT asset, ts, CASE WHEN len(seen) >= 26 AND d IS NOT NULL THEN
  (len(list_filter(seen, lambda v: v < d)) + (len(list_filter(seen, lambda v: v = d)) + 1) / 2.0) / len(seen) END AS value
FROM (SELECT *, lag(iv - rv, 1) OVER {W} AS d, list(iv - rv) OVER {trail(LONG)} AS seen FROM vol)""")
_vol("ts_iv_rv_spread", opt.lagged_spread("iv", "rv"),
     f"SELECT asset, ts, lag(iv, 1) OVER {W} - lag(rv, 1) OVER {W} AS value FROM vol")
_vol("ts_term_slope", opt.lagged_spread("iv", "vix"),
     f"SELECT asset, ts, lag(iv, 1) OVER {W} - lag(vix, 1) OVER {W} AS value FROM vol")
_vol("ts_gex_distance", opt.gex_distance("close", "flip"),
     f"SELECT asset, ts, (lag(close, 1) OVER {W} - lag(flip, 1) OVER {W}) / nullif(lag(close, 1) OVER {W}, 0) AS value FROM vol")
_vol("ts_dealer_alignment", opt.dealer_alignment("gex"),
     f"SELECT asset, ts, CASE WHEN lag(gex, 1) OVER {W} > 0 THEN 1.0 ELSE -1.0 END AS value FROM vol")
_vol("ts_pe_zscore", opt.pe_zscore("pe", LONG, 26), f"SELECT asset, ts, {_z('pe', LONG, 26)} AS value FROM vol")


@query("ts_pe_quadrant", keys="asset ts quadrant", sql=with_(BARS, VOL_SQL) + f"""
SELECT asset, ts, (CASE WHEN z > 0 THEN 'T' ELSE 'B' END) || (CASE WHEN pv > 60 THEN 'R' ELSE 'L' END) AS quadrant
FROM (SELECT asset, ts, {_z('pe', LONG, 26)} AS z, lag(vix, 1) OVER {W} AS pv FROM vol)""")
def _(spark, sf):
    p = add_feature_panel(vol_bars(spark, sf), {"pe_z": opt.pe_zscore("pe", LONG, 26)})
    return add_features(p, {"quadrant": opt.pe_quadrant("pe_z", "vix", 60.0)})


# --- cross section ------------------------------------------------------------------

CS_SQL = f"""sig AS (
  SELECT asset, ts, volume, lag(close, 1) OVER {W} / nullif(lag(close, {N + 1}) OVER {W}, 0) - 1 AS mom FROM bars
)"""


def signals(spark, sf):
    """Checkpointed: the cross-section joins bar aggregates back to these rows."""
    return checkpointed(
        add_features(trade_bars(spark, sf), {"mom": ts.momentum(N)}).select(
            "asset", "ts", "volume", "mom"
        )
    )


@query("cs_rank", keys="asset ts", nums="rank place", sql=with_(BARS, CS_SQL) + f"""
SELECT asset, ts, {pct_rank('volume', 'ts')} AS rank,
       CASE WHEN mom IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY mom NULLS LAST)
            + (count(*) OVER (PARTITION BY ts, mom) - 1) / 2.0 END AS place FROM sig""")
def _(spark, sf):
    return cs.rank(cs.rank(signals(spark, sf), "volume"), "mom", "place", pct=False)


@query("cs_zscore", keys="asset ts", nums="z", sql=with_(BARS, CS_SQL) + """
SELECT asset, ts, (mom - avg(mom) OVER w) / nullif(stddev_samp(mom) OVER w, 0) AS z FROM sig WINDOW w AS (PARTITION BY ts)""")
def _(spark, sf):
    return cs.zscore(signals(spark, sf), "mom")


@query("cs_zscore_robust", keys="asset ts", nums="z", sql=with_(BARS, CS_SQL) + """
SELECT asset, ts, (mom - m) / nullif(1.4826 * quantile_cont(abs(mom - m), 0.5) OVER (PARTITION BY ts), 0) AS z
FROM (SELECT *, quantile_cont(mom, 0.5) OVER (PARTITION BY ts) AS m FROM sig)""")
def _(spark, sf):
    return cs.zscore(signals(spark, sf), "mom", robust=True)


@query("cs_neutralize_factor", keys="asset ts", nums="residual", sql=with_(BARS, CS_SQL) + """
SELECT s.asset, s.ts, CASE WHEN n >= 3 AND mom IS NOT NULL THEN mom - my - b * (volume - mx) END AS residual
FROM sig s JOIN (SELECT ts, count(mom) AS n, avg(mom) AS my, avg(volume) AS mx,
  coalesce(covar_pop(mom, volume) / nullif(var_pop(volume), 0), 0) AS b FROM sig WHERE mom IS NOT NULL GROUP BY ts
  UNION ALL SELECT ts, 0, NULL, NULL, NULL FROM sig GROUP BY ts HAVING count(mom) = 0) g ON s.ts = g.ts""")
def _(spark, sf):
    return cs.neutralize(signals(spark, sf), "mom", "volume")


@query("cs_industry_neutralize", keys="asset ts industry", nums="neutral", sql=with_(BARS, CS_SQL, INDUSTRY) + """
SELECT asset, ts, industry, mom - avg(mom) OVER (PARTITION BY ts, industry) AS neutral
FROM sig JOIN industry USING (asset)""")
def _(spark, sf):
    return cs.industry_neutralize(signals(spark, sf), industries(spark, sf), "mom")


@query("cs_momentum", keys="asset ts", nums="value", sql=with_(BARS) +
       f"SELECT asset, ts, lag(close, 4) OVER {W} / nullif(lag(close, 16) OVER {W}, 0) - 1 AS value FROM bars")
def _(spark, sf):
    return add_features(trade_bars(spark, sf), {"value": cs.skip_momentum(12, 4)})
