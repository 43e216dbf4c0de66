"""Chance tests, signals, ledger, gates, calendar, production, files and streams."""
import math

import numpy as np
import pandas as pd
import pytest
from helpers import collect
from pyspark.sql import functions as F

from alphaloom.core import Panel
from alphaloom.operators import calendar as cal
from alphaloom.operators import correlations as co
from alphaloom.operators import gates as gt
from alphaloom.operators import ledger as lg
from alphaloom.operators import production as pr
from alphaloom.operators import randomized as rz
from alphaloom.operators import relational as rel
from alphaloom.operators import risk as rk
from alphaloom.operators import signals as sgl
from alphaloom.sources import files as fs
from alphaloom.streaming import jobs


def timing(spark, edge, n=400, seed=0):
    rng = np.random.default_rng(seed)
    asset = rng.normal(0, 0.01, n)
    pos = np.where(rng.uniform(size=n) < 0.3, 1.0, 0.0)
    if edge:
        pos = (np.r_[asset[1:], 0] > 0.008).astype(float)
    net = np.r_[0, pos[:-1]] * asset
    f = pd.DataFrame({"strategy_id": "e" if edge else "n", "ts": pd.bdate_range("2015-01-01", periods=n).date,
                      "position": pos, "net": net, "asset_ret": asset})
    return f


def test_permutation_separates_edge_from_noise(spark):
    idle = timing(spark, False).assign(strategy_id="idle", position=0.0, net=0.0)
    df = spark.createDataFrame(pd.concat([timing(spark, True), timing(spark, False), idle]))
    p = Panel(df, keys=("strategy_id",), grain="day")
    out = rz.permutation_test(p, n=100, asset_ret="asset_ret").toPandas().set_index("strategy_id")
    assert out.verdict["e"] == "pass" and out.verdict["n"] in ("fail", "borderline")
    assert out.status["idle"] == "error" and out.verdict["idle"] is None
    # a panel without a bound takes the bucketed plan and draws the same numbers
    cut = Panel(df, keys=("strategy_id",), block="month", segment_rows=50)
    again = rz.permutation_test(cut, n=100, asset_ret="asset_ret").toPandas().set_index("strategy_id")
    pd.testing.assert_frame_equal(out, again.loc[out.index])


def test_trials_keep_activity(spark):
    p = Panel(spark.createDataFrame(timing(spark, False)), keys=("strategy_id",), grain="day")
    profile, trials = rz.permutation_trials(p, n=50, asset_ret="asset_ret")
    assert trials.count() == 50 and abs(trials.agg(F.avg("sharpe")).first()[0]) < 0.5


def test_block_bootstrap_keeps_blocks(spark):
    f = pd.DataFrame({"asset": "A", "ts": pd.bdate_range("2015-01-01", periods=23).date, "x": np.arange(23.0)})
    out = rz.block_bootstrap(Panel(spark.createDataFrame(f), grain="day"), value="x", replicates=4, block=5).toPandas()
    for _, g in out.groupby("replicate"):
        v = g.sort_values("i").x.to_numpy()
        assert len(v) == 23
        for b in range(0, 23, 5):
            part = v[b:b + 5]
            assert ((part[0] + np.arange(len(part))) % 23 == part).all()


def test_rule_moments_match_brute_force(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300), "ret": rng.normal(0, 0.01, 300)})
    f.loc[::13, "a"] = np.nan
    rules = rz.random_rules(spark, ["a", "b"], n=40, stages=(1, 2))
    got = rz.rule_moments(spark.createDataFrame(f).repartition(3), rules, value="ret").toPandas().set_index("rule_id")
    for r in rules.collect():
        mask = np.ones(300, bool)
        for c in r.conditions:
            v = f[c.feature].to_numpy()
            mask &= v > c.threshold if c.op == ">" else v < c.threshold
        sign = -1 if r.direction == "short" or (r.direction == "both" and r.conditions[0].op == "<") else 1
        assert got.n_rows[r.rule_id] == mask.sum()
        assert got.s[r.rule_id] == pytest.approx(sign * f.ret[mask].sum(), abs=1e-12)
    assert len({c.feature for c in rules.filter("size(conditions) = 2").first().conditions}) == 2


def test_pairs_text(spark):
    df = spark.createDataFrame([("m1=BULL; iv = 12.5;put=3;iv=7",), ("xiv=1; call=a=b",), (None,)], "t string")
    rows = df.select(*[rz.pair_value("t", k).alias(k) for k in ("m1", "iv", "call")]).collect()
    assert tuple(rows[0]) == ("BULL", "7", None) and tuple(rows[1]) == (None, None, "a=b") and tuple(rows[2]) == (None, None, None)


def signal_frame(spark, n=300, tickers=4, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for t in range(tickers):
        parts.append(pd.DataFrame({
            "ticker": f"T{t}", "tradeDate": pd.bdate_range("2015-01-01", periods=n).date,
            "iv30d": rng.uniform(0.2, 0.4, n), "dlt25Iv30d": rng.uniform(0.2, 0.4, n), "dlt75Iv30d": rng.uniform(20, 40, n),
            "clsPx": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), "ivPct1y": np.where(rng.uniform(size=n) < 0.5, rng.uniform(0, 100, n), np.nan)}))
    f = pd.concat(parts)
    df = spark.createDataFrame(f).withColumn("ivPct1y", F.nanvl("ivPct1y", F.lit(None)))
    return f, Panel(df, keys=("ticker",), ts="tradeDate", grain="day")


def test_universe_signal_against_pandas(spark):
    f, p = signal_frame(spark)
    out = collect(sgl.universe_signal(p, 40), "ticker", "tradeDate")
    g = f[f.ticker == "T1"].reset_index(drop=True)
    o = out[out.ticker == "T1"].reset_index(drop=True)
    vp = lambda s: s.where(s.abs() > 3, s * 100)
    atm, put = vp(g.iv30d), vp(g.dlt75Iv30d)
    raw = (put - atm).to_numpy()
    want = [np.nan if i < 40 else round(((raw[i - 40:i] < raw[i]).sum() + (raw[i - 40:i] == raw[i]).sum() / 2) / 40 * 100, 1) for i in range(len(raw))]
    np.testing.assert_allclose(o.putP.to_numpy(float), want, equal_nan=True, atol=1e-9)
    lr = np.log(g.clsPx / g.clsPx.shift(1))
    hv = (lr.rolling(20, min_periods=18).std(ddof=0) * math.sqrt(252)).shift(1)
    sig = ((g.clsPx - g.clsPx.shift(5)) / (g.clsPx * hv * math.sqrt(5 / 252))).round(3)
    np.testing.assert_allclose(o.sigma.to_numpy(float), sig, equal_nan=True, atol=1e-9)
    short = p.with_df(p.df.filter("tradeDate < '2015-01-20' OR ticker <> 'T0'"))
    assert "T0" not in set(sgl.universe_signal(short, 40).select("ticker").distinct().toPandas().ticker)


def test_consensus_by_hand(spark):
    n = 8
    f = pd.DataFrame({"ticker": "T", "tradeDate": pd.bdate_range("2020-01-01", periods=n).date,
                      "putP": [10.0] * n, "callP": [90.0] * n, "ivP": [90.0] * n, "rrP": [90.0] * n,
                      "sigma": [1.2, 1.3, 1.25, 1.3, 1.35, 3.0, 3.0, 3.0], "skewDelta": [0.0] * n, "clsPx": [10.0] * n})
    p = Panel(spark.createDataFrame(f), keys=("ticker",), ts="tradeDate", grain="day")
    out = collect(sgl.consensus(p), "tradeDate")
    assert list(out.m3_stall_bull) == [False] * 3 + [True, True, False, False, False]
    assert list(out.side[3:5]) == ["BULL", "BULL"] and out.side[5:].isna().all()
    fires = sgl.consensus_fires(sgl.consensus(p), ["ticker", "tradeDate"]).toPandas()
    assert (fires.sign == -1).all() and (fires.direction == "CONSENSUS SHORT").all()
    none = sgl.consensus(p, sgl.ConsensusOptions(sides=("BEAR",))).filter("side is not null").count()
    assert none == 0
    with pytest.raises(ValueError):
        sgl.consensus(p.with_df(p.df.drop("sigma")))


def test_bootstrap_blocks_do_not_change_the_draws(spark, monkeypatch):
    f, p = signal_frame(spark, n=60)
    pool = sgl.eligible(sgl.by_horizon(sgl.forward_panel(p).df))
    fires = pool.withColumn("sign", F.when(F.col("ticker") == "T2", -1).otherwise(1))
    once = lambda: collect(sgl.bootstrap_means(fires, pool, date="tradeDate", keys=["ticker"], n_boot=15, seed=3), "horizon", "replicate")
    whole = once()
    monkeypatch.setattr(sgl, "POOL", 2)
    monkeypatch.setattr(sgl, "FIRES", 1)
    monkeypatch.setattr(sgl, "DRAWN", 1)
    pd.testing.assert_frame_equal(whole, once(), rtol=1e-12)


def test_bootstrap_draws_come_from_the_date_pool(spark):
    f, p = signal_frame(spark, n=60)
    rows = sgl.by_horizon(sgl.forward_panel(p).df)
    pool = sgl.eligible(rows)
    fires = pool.filter("ticker = 'T2'").withColumn("sign", F.lit(-1))
    got = sgl.bootstrap_means(fires, pool, date="tradeDate", keys=["ticker"], n_boot=20, seed=3)
    h5 = pool.filter("horizon = 5").toPandas()
    lo = -h5.groupby("tradeDate").fwd.max().mean()
    hi = -h5.groupby("tradeDate").fwd.min().mean()
    out = got.filter("horizon = 5").toPandas()
    assert len(out) == 20 and (out.n_used == 55).all() and out.boot_mean.between(lo, hi).all() and out.boot_mean.nunique() > 15


def plain_positions(f, rules, trend, lag):
    """Moments per rule, bar by bar."""
    out = {}
    for r in rules:
        n = total = square = 0
        sign = -1 if r.direction == "short" or (r.direction == "both" and r.conditions[0].op == "<") else 1
        for _, g in f.groupby("asset"):
            rows = g.sort_values("ts").to_dict("records")
            holds = lambda c, t: rows[t][c.feature] > c.threshold if c.op == ">" else rows[t][c.feature] < c.threshold
            left = 0
            for t in range(len(rows)):
                fresh = all(any(holds(c, b) for b in range(max(0, t - r.freshness + 1), t + 1)) for c in r.conditions)
                asks = r.trend == "both" or (r.trend == "short_only" and sign < 0)
                if left == 0 and fresh and (not asks or np.sign(rows[t][trend]) == sign):
                    left = r.hold
                if left and t + lag < len(rows) and not np.isnan(rows[t + lag]["ret"]):
                    x = rows[t + lag]["ret"]
                    n, total, square = n + 1, total + sign * x, square + x * x
                left = max(left - 1, 0)
        out[r.rule_id] = (n, total, square)
    return out


@pytest.mark.parametrize("rows,lag", [(None, 1), (13, 1), (40, 2), (13, 0)])
def test_random_rules_hold_positions(spark, rows, lag):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=150)
    f = pd.concat([
        pd.DataFrame({"asset": a, "ts": days[:n], "a": rng.normal(size=n), "b": rng.normal(size=n), "ret": rng.normal(size=n)})
        for a, n in (("x", 150), ("y", 40), ("z", 1))
    ])
    f.loc[rng.uniform(size=len(f)) < 0.1, "ret"] = np.nan
    f.loc[rng.uniform(size=len(f)) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(f)
    df = df.select("asset", F.col("ts").cast("date").alias("ts"), *[F.nanvl(c, F.lit(None)).alias(c) for c in ("a", "b", "ret")])
    rules = rz.random_rules(spark, ["a", "b"], n=60, stages=(1, 2), low=-1.5, high=1.5)
    panel = Panel(df, grain="day") if rows is None else Panel(df, block="week", segment_rows=rows)
    got = {r.rule_id: (r.n, r.s, r.q) for r in rz.position_moments(panel, rules, ret="ret", trend="a", lag=lag).collect()}
    want = plain_positions(f, rules.collect(), "a", lag)
    assert len({r.hold for r in rules.collect()}) > 5 and set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0]
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("tile,bars", [(256, 2048), (3, 16), (1, 7)])
def test_pair_correlations_match_pandas(spark, tile, bars):
    rng = np.random.default_rng(8)
    wide = pd.DataFrame(rng.normal(size=(90, 9)), index=pd.bdate_range("2020-01-01", periods=90).date, columns=[f"s{i}" for i in range(9)])
    wide["s1"] += wide["s0"] + 50.0
    wide = wide.mask(rng.uniform(size=wide.shape) < 0.3)
    wide["s2"] = 0.1  # constant
    wide.loc[wide.index[:60], "s3"] = np.nan
    wide.loc[wide.index[60:], "s4"] = np.nan  # no bar with s3
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="strategy_id", value_name="net")
    df = spark.createDataFrame(long).withColumn("net", F.nanvl("net", F.lit(None)))
    left, right = df.filter("strategy_id < 's6'"), df.filter("strategy_id >= 's2'")
    got = {(r.left_id, r.right_id): (r.n, r.correlation) for r in co.pair_correlations(left, right, tile=tile, bars=bars).collect()}
    for a in wide.columns[:6]:
        for b in wide.columns[2:]:
            x, y = wide[a], wide[b]
            n = int((x.notna() & y.notna()).sum())
            if n == 0:
                assert (a, b) not in got
                continue
            want = None if "s2" in (a, b) else x.corr(y) if a != b else 1.0
            assert got[(a, b)][0] == n and (got[(a, b)][1] is None if want is None else abs(got[(a, b)][1] - want) < 1e-9), (a, b)
    assert co.pair_correlations(left.limit(0), right).count() == 0


def ledger(spark, *events):
    base = [dict(zip(("seq", "hypothesis_id", "kind"), e[:3]), **(e[3] if len(e) > 3 else {})) for e in events]
    cols = {f.name for f in lg.EVENT_SCHEMA}
    rows = [tuple(b.get(c) for c in [f.name for f in lg.EVENT_SCHEMA]) for b in base]
    assert all(set(b) <= cols for b in base)
    return spark.createDataFrame(rows, lg.EVENT_SCHEMA)


def test_ledger_replay(spark):
    ev = ledger(
        spark,
        (1, "a", "override", {"failure": "critic", "reason": "x"}),
        (2, "a", "record", {"accepted": False, "rejection_reason": "dsr", "metrics_json": '{"sharpe_ratio": 1.5}'}),
        (3, "b", "record", {"accepted": True, "returns_json": '{"index":["2020-01-01"],"values":[0.1]}'}),
        (4, "b", "deploy", {"status": "paper", "size_multiplier": 0.5}),
        (5, "c", "record", {"accepted": False, "rejection_reason": "corr"}),
        (6, "c", "deploy", {"status": "live", "size_multiplier": 2.0}),
        (7, "c", "override", {"failure": "corr", "reason": "y"}),
        (8, "d", "override", {"failure": "z", "reason": "z"}),
        (9, "d", "deploy", {"status": "paper", "size_multiplier": 1.0}),
        (10, "d", "record", {"accepted": True, "returns_json": "{broken"}),
        (11, "b", "record", {"accepted": False, "rejection_reason": "again"}),
    )
    t = lg.trials(ev).toPandas().set_index(["hypothesis_id", "trial_no"]).sort_index()
    assert len(t) == 6  # a, b, b again, c, d placeholder, d
    assert t.loc[("a", 1)].n_overrides == 1 and not t.loc[("a", 1)].accepted and t.loc[("a", 1)].deployment_status == "archived"
    assert t.loc[("b", 1)].deployment_status == "paper" and t.loc[("b", 1)].size_multiplier == 0.5
    assert t.loc[("b", 2)].rejection_reason == "again" and t.loc[("b", 2)].n_trials_at_time == 5
    assert t.loc[("c", 1)].accepted and t.loc[("c", 1)].rejection_reason is None and t.loc[("c", 1)].deployment_status == "archived"
    assert t.loc[("d", 1)].deployment_status == "paper" and t.loc[("d", 2)].deployment_status == "archived"
    rows = lg.trials(ev)
    s = lg.status(rows).first()
    assert (s.total_trials, s.accepted_count, s.deployed_strategies, s.override_count) == (6, 4, 2, 3)
    assert [tuple(r) for r in lg.accepted_returns(rows).select("hypothesis_id", "ret").collect()] == [("b", 0.1)]
    assert lg.recent(rows, 2).first().verdict == "REJECT (again)"
    assert lg.recent(rows).filter("hypothesis_id = 'a'").first().sharpe == 1.5
    assert lg.n_trials(lg.trials(ev.unionByName(lg.seed_events(spark, 3, after=100)))).first()[0] == 9
    with pytest.raises(Exception, match="deployment status"):
        lg.deploy_events(ledger(spark, (1, "a", "deploy", {"status": "moon"}))).collect()


def replay(events):
    """The ledger event by event: {(hypothesis, number): [accepted, status, size, paper, live, overrides, first]}."""
    rows, order = {}, []
    for seq, h, kind, more in events:
        own = rows.setdefault(h, [])
        if kind == "override":
            if not own:
                own.append([True, "override_pending", 1.0, None, None, 0, seq])
                order.append(own[-1])
            own[-1][0] = True
            own[-1][5] += 1
        elif kind == "record":
            if own and own[-1][1] == "override_pending":
                own[-1][:3] = [more["accepted"], "archived", more.get("size_multiplier", 1.0)]
            else:
                own.append([more["accepted"], "archived", more.get("size_multiplier", 1.0), None, None, 0, seq])
                order.append(own[-1])
        else:
            for r in own:
                if r[0]:
                    r[1], r[2] = more["status"], more["size_multiplier"]
                    if more["status"] in ("paper", "live"):
                        r[3 if more["status"] == "paper" else 4] = more["created_at"].date()
    return {(h, i + 1): (*r, [x is r for x in order].index(True)) for h, own in rows.items() for i, r in enumerate(own)}


def test_ledger_equals_a_replay_event_by_event(spark):
    rng = np.random.default_rng(11)
    events = []
    for seq in range(1, 900):
        kind = rng.choice(["record", "override", "deploy"], p=[0.35, 0.2, 0.45])
        more = {"created_at": (pd.Timestamp("2021-01-01") + pd.Timedelta(days=seq)).to_pydatetime()}
        if kind == "record":
            more["accepted"] = bool(rng.uniform() < 0.5)
        if kind == "deploy":
            more |= {"status": str(rng.choice(lg.STATUSES)), "size_multiplier": float(seq)}
        events.append((seq, f"h{rng.integers(0, 60) if seq % 3 else 0}", str(kind), more))
    names = ["accepted", "deployment_status", "size_multiplier", "paper_start_date", "live_start_date", "n_overrides", "first_seq", "n_trials_at_time"]
    got = {(r.hypothesis_id, r.trial_no): tuple(r[n] for n in names) for r in lg.trials(ledger(spark, *events)).collect()}
    assert got == replay(events)


def test_ledger_work_is_linear_in_deployments(spark):
    n = 10_000
    at = F.col("id")
    both = spark.range(1, 2 * n + 1).select(
        at.alias("seq"), F.lit("h").alias("hypothesis_id"), F.when(at % 2 == 1, "record").otherwise("deploy").alias("kind"),
        F.when(at % 2 == 1, at % 4 == 1).alias("accepted"), F.when(at % 2 == 0, "live").alias("status"),
        F.when(at % 2 == 0, at.cast("double")).alias("size_multiplier"), F.timestamp_seconds(at * 86400).alias("created_at"),
    )
    t = lg.trials(lg._complete(both)).cache()
    assert t.count() == n and t.filter("deployment_status = 'live' AND size_multiplier = 20000.0").count() == n // 2
    assert t.filter("deployment_status = 'archived'").count() == n // 2 and t.filter("n_trials_at_time <> trial_no - 1").count() == 0
    t.unpersist()


def test_portfolio_greeks(spark):
    ev = ledger(spark, (1, "a", "record", {"accepted": True, "market_type": "options"}), (2, "a", "deploy", {"status": "live", "size_multiplier": 0.0}))
    greeks = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, 1.0), ("a", 2, 60.0, 2.0, 3.0, 4.0)], "hypothesis_id string, ts int, delta double, gamma double, vega double, theta double")
    per, net = lg.portfolio_greeks(lg.trials(ev), greeks, ts=["ts"], limits={"delta": 50.0, "vega": 2000.0})
    assert per.first().delta == 60 and per.first()["size"] == 1
    assert net.first().delta_breached and not net.first().vega_breached


def returns(spark, **named):
    parts = [pd.DataFrame({"strategy_id": k, "ts": pd.bdate_range("2015-01-01", periods=len(v)).date, "net": v}) for k, v in named.items()]
    return spark.createDataFrame(pd.concat(parts))


def test_gates(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0.002, 0.01, 500)
    surv = returns(spark, s1=base + rng.normal(0, 0.003, 500), s2=rng.normal(0, 0.01, 500))
    cand = returns(spark, dup=base, good=rng.normal(0.003, 0.01, 500), noise=rng.normal(0, 0.01, 500), bad=rng.normal(0.003, 0.01, 500), tiny=base[:20])
    critic = cand.select("strategy_id").distinct().withColumn("critic_passes", F.col("strategy_id") != "bad")
    out = gt.evaluate(cand, critic, surv, n_trials=5).toPandas().set_index("strategy_id")
    assert out.passes["good"] and out.rejection_reason["bad"] == "critic"
    assert out.rejection_reason["dup"].startswith("correlation=") and out.rejection_reason["noise"].startswith("deflated_sharpe_pvalue=")
    assert out.rejection_reason["tiny"] == "dsr_insufficient_data"
    pairs = gt.survivor_correlations(cand, surv).filter("candidate_id = 'dup' AND survivor_id = 's1'").first()
    assert pairs.n_overlap_bars == 500 and pairs.correlation > 0.9


def test_calendar_2026(spark):
    b = spark.createDataFrame([("2026-01-01", "2026-12-31")], "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    days = lambda df: [str(r.date) for r in df.orderBy("date").collect()]
    assert days(cal.triple_witching(b)) == ["2026-03-20", "2026-06-19", "2026-09-18", "2026-12-18"]
    assert days(cal.collar_rolls(b)) == ["2026-03-31", "2026-06-30", "2026-09-30", "2026-12-31"]
    assert days(cal.payrolls(b))[:3] == ["2026-01-02", "2026-02-06", "2026-03-06"]
    assert len(days(cal.opex(b))) == 12 and days(cal.vix_expirations(b))[0] == "2026-01-14"
    assert cal.unified(b).count() == 4 + 12 + 12 + 12 + 4


def test_event_files(spark, tmp_path):
    (tmp_path / "cpi.csv").write_text("date,time_et,event_type,ticker,details\n2026-01-14,08:30,cpi,,CPI\n2027-01-14,08:30,cpi,,CPI\n")
    (tmp_path / "hol.csv").write_text("date,type,status\n2026-01-01,full_close,NewYears\n2026-11-27,early_close_1pm,BlackFriday_early\n")
    b = spark.createDataFrame([("2026-01-01", "2026-12-31")], "s string, e string").select(F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    hol = cal.load_holidays(spark, str(tmp_path / "hol.csv")).toPandas()
    assert list(hol.event_type) == ["market_holiday_full", "market_holiday_half"]
    out = cal.unified(b, cal.load_macro(spark, str(tmp_path / "cpi.csv"), "cpi"), include_opex=False, include_macros=False, include_collar=False)
    assert out.count() == 1


def test_tca(spark):
    rng = np.random.default_rng(0)
    n = 100
    arrival = rng.uniform(50, 150, n)
    side = rng.choice([-1, 1], n)
    f = pd.DataFrame({"symbol": rng.choice(list("ABC"), n), "side": side, "quantity": rng.uniform(10, 100, n), "arrival_price": arrival,
                      "decision_price": arrival, "fill_price": arrival * (1 + side * 2e-4)})
    df = spark.createDataFrame(f)
    out = pr.tca_report(df).toPandas()
    total = out[out.symbol.isna()].iloc[0]
    assert total.n_fills == 100 and total.mean_arrival_bps == pytest.approx(2.0) and total.p95_arrival_bps == pytest.approx(2.0)
    adv = spark.createDataFrame([("A", 1000.0), ("B", 1000.0), ("C", 0.0)], "symbol string, adv double")
    k = pr.slippage_coefficient(df, adv).first().k
    g = f[f.symbol != "C"]
    x = np.sqrt(g.quantity / 1000)
    assert k == pytest.approx((x * 2.0).sum() / (x * x).sum(), rel=1e-6)
    assert pr.slippage_coefficient(df).first().k == pytest.approx(2.0)


def test_live_diagnosis_and_kill_switch(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(0.001, 0.01, 400)
    p = lambda df: Panel(df, keys=("strategy_id",), grain="day")
    base = p(returns(spark, same=good, broken=good, few=good))
    live = p(returns(spark, same=good[-60:], broken=rng.normal(-0.01, 0.02, 60), few=good[:5]))
    out = pr.live_diagnose(base, live).toPandas().set_index("strategy_id")
    assert out.status["broken"] == "degraded" and "drawdown_breach" in out["flags"]["broken"] and out.status["few"] == "insufficient_data"
    ks = p(returns(spark, crash=[0.01, -0.02, -0.05, 0.01], slide=[-0.02] * 10, calm=[0.001] * 10))
    out = pr.kill_switch(ks).toPandas().set_index("strategy_id")
    assert out.trip_reason["crash"] == "daily_loss>3.00%" and str(out.trip_ts["crash"]) == "2015-01-05"
    assert out.trip_reason["slide"] == "drawdown>10.00%" and not out.tripped["calm"]
    cut = Panel(ks.df, keys=("strategy_id",), block="day", segment_rows=2)
    again = pr.kill_switch(cut, min_sharpe=-50.0, window=3).toPandas().set_index("strategy_id")
    assert again.trip_reason["crash"] == "daily_loss>3.00%"
    with pytest.raises(ValueError):
        pr.kill_switch(ks, max_drawdown=-1)


def test_asof_and_dedup(spark):
    rng = np.random.default_rng(0)
    days = pd.date_range("2020-01-01", "2021-06-30")
    rec = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "eff": rng.choice(days, 60), "v": np.arange(60.0)}).drop_duplicates(["k", "eff"])
    tgt = pd.DataFrame({"k": rng.choice(["a", "b", "none"], 200), "at": rng.choice(days, 200), "id": range(200)})
    got = collect(rel.asof_latest(spark.createDataFrame(tgt), spark.createDataFrame(rec), at="at", effective="eff", by=["k"], values=["v"]), "id")
    want = pd.merge_asof(tgt.sort_values("at"), rec.sort_values("eff"), left_on="at", right_on="eff", by="k").sort_values("id")
    np.testing.assert_allclose(got.v.to_numpy(float), want.v.to_numpy(), equal_nan=True)
    dup = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 1, "z")], "k int, o int, v string")
    assert sorted(map(tuple, rel.keep_first(dup, ["k"], ["o"]).collect())) == [(1, 2, "y"), (2, 1, "z")]
    assert [r.o for r in rel.latest(dup, ["o"], 2, ascending_output=True).collect()] == [2, 3]


def test_files(spark, tmp_path):
    cache = tmp_path / "cache"
    cache.mkdir()
    for day in ("2020-01-02", "2020-01-03"):
        pd.DataFrame({"ticker": ["A", "B"], "clsPx": [1.0, 2.0]}).to_parquet(cache / f"{day}.parquet")
    pd.DataFrame({"ticker": ["A"] * 9, "clsPx": [9.0] * 9}).to_parquet(cache / "AAPL.parquet")
    (cache / "2020-01-01.parquet").touch()  # a holiday marker
    pd.DataFrame({"ticker": [], "clsPx": []}).to_parquet(cache / "2020-01-04.parquet")  # without rows, types of its own
    pd.DataFrame(index=[]).to_parquet(cache / "2020-01-05.parquet")  # without columns
    pd.DataFrame({"ticker": [1, 2], "clsPx": ["x", "y"]}).to_parquet(cache / "TSLA.parquet")
    assert fs.universe_cache(spark, str(cache), ["ticker", "clsPx", "absent"]).count() == 4
    assert {r.clsPx for r in fs.universe_cache(spark, str(cache), schema="ticker string, clsPx double").collect()} == {1.0, 2.0}
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "positions.csv").write_text("ts,A,B\n2020-01-01,1,0.5\n2020-01-02,-1,\n")
    (tmp_path / "results" / "returns.csv").write_text("ts,ret\n2020-01-01,0.1\n2020-01-02,0.2\n")
    out = collect(fs.thesis_results(spark, str(tmp_path / "results")), "ts")
    assert list(out.position) == [1.5, -1.0] and list(out.net) == [0.1, 0.2]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("step_start", 1), ("step_complete", 1)], "event_type string, step int")
    fs.append_jsonl(rows, log)
    fs.append_jsonl(rows, log)
    assert fs.read_jsonl(spark, log).filter("event_type = 'step_start'").count() == 2


def test_kill_switch_stream_keeps_state_between_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "strategy_id string, ts timestamp, net double"
    put = lambda rows: spark.createDataFrame(rows, "strategy_id string, ts string, net double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    run = lambda: jobs.run_available(jobs.kill_switch_stream(spark.readStream.schema(schema).parquet(src)), out, checkpoint=ck)
    put([("a", "2020-01-01", 0.01), ("a", "2020-01-02", -0.05), ("b", "2020-01-01", 0.01)])
    first = {r.strategy_id: r for r in run().collect()}
    assert first["a"].trip_reason == "daily_loss>3.00%" and not first["b"].tripped
    put([("a", "2020-01-03", 0.05), ("b", "2020-01-02", -0.02), ("b", "2020-01-03", -0.029)])
    rows = run().collect()
    last = {r.strategy_id: r for r in sorted(rows, key=lambda r: r.ts)}
    assert last["a"].tripped and str(last["a"].trip_ts)[:10] == "2020-01-02" and not last["b"].tripped
    put([("a", "2020-01-04", None), ("b", "2020-01-04", -0.08)])  # a hole changes nothing
    last = {r.strategy_id: r for r in sorted(run().collect(), key=lambda r: r.ts)}
    assert last["a"].trip_reason == "daily_loss>3.00%" and last["b"].trip_reason == "drawdown>10.00%"


def test_kill_switch_stream_reset_and_sharpe(spark, tmp_path):
    src = str(tmp_path / "src")
    rng = np.random.default_rng(1)
    days = [d.to_pydatetime() for d in pd.bdate_range("2020-01-01", periods=80)]
    rows = [("c", d, float(v), False) for d, v in zip(days, rng.normal(-0.002, 0.004, 80))]
    rows += [("d", days[0], -0.05, False), ("d", days[1], None, True), ("d", days[2], 0.01, None), ("e", days[0], -0.05, False), ("e", days[1], -0.06, True)]
    f = pd.DataFrame(rows, columns=["strategy_id", "ts", "net", "reset"])
    spark.createDataFrame(rows, "strategy_id string, ts timestamp, net double, reset boolean").write.parquet(src)
    stream = spark.readStream.schema("strategy_id string, ts timestamp, net double, reset boolean").parquet(src)
    out = jobs.run_available(jobs.kill_switch_stream(stream, max_drawdown=0.9, max_loss=0.04, min_sharpe=-2.0, window=60), str(tmp_path / "out"))
    got = {r.strategy_id: r for r in out.collect()}
    x = f[f.strategy_id == "c"].net
    sharpe = x.rolling(60).mean() / x.rolling(60).std() * math.sqrt(252)
    first = days[int(np.argmax(sharpe.to_numpy() < -2.0))]
    assert got["c"].trip_reason == "sharpe<-2.0" and got["c"].trip_ts == first
    assert not got["d"].tripped and got["e"].trip_ts == days[1]


def test_window_metrics_drop_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put = lambda rows: spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    run = lambda: jobs.run_available(jobs.window_metrics(spark.readStream.schema("ts timestamp, k string, value double").parquet(src), by=["k"], late="10 minutes"), out, checkpoint=ck)
    put([("2020-01-01 00:10:00", "x", 1.0), ("2020-01-01 00:50:00", "x", 2.0), ("2020-01-01 03:00:00", "x", 4.0)])
    run()
    put([("2020-01-01 00:20:00", "x", 100.0), ("2020-01-01 06:00:00", "x", 1.0)])
    got = {str(r.window_start): (r.n, r.total) for r in run().collect()}
    assert got["2020-01-01 00:00:00"] == (2, 3.0) and got["2020-01-01 03:00:00"] == (1, 4.0)


def test_live_diagnose_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = rng.normal(0.001, 0.01, 300)
    base = Panel(returns(spark, a=good).withColumn("ts", F.col("ts").cast("timestamp")), keys=("strategy_id",), grain="day")
    src = str(tmp_path / "src")
    returns(spark, a=good[-40:]).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    live = spark.readStream.schema("strategy_id string, ts timestamp, net double").parquet(src)
    jobs.live_diagnose_stream(live, base, str(tmp_path / "s"), str(tmp_path / "r"), checkpoint=str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "r")).first()
    assert row.n_live_observations == 40 and row.status in ("ok", "degraded")


def test_risk_statistics(spark):
    r = np.random.default_rng(0).normal(0, 0.01, 60)
    df = returns(spark, s=r)
    row = rk.tail_metrics(Panel(df, keys=("strategy_id",), grain="day")).first()
    s = pd.Series(r)
    assert row.worst_5d_return == pytest.approx(s.rolling(5).sum().min()) and row.skewness == pytest.approx(s.skew())
    pos = df.withColumn("position", F.col("net") * 10)
    p = rk.position_stats(pos, by=["strategy_id"]).first()
    a = (s * 10).abs()
    assert p.fraction_at_max == pytest.approx((a >= a.quantile(0.99)).mean()) and p.concentration_share == pytest.approx(a.max() / a.sum())


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_net_greeks_on_the_threshold_do_not_depend_on_partitions(spark, parts):
    """Tenths whose net is exactly +-1: rounding alone, and so the order of adding, decides the sign."""
    rng = np.random.default_rng(5)
    rows = []
    for h in range(60):
        x = rng.integers(-100, 101, 11)
        x = np.r_[x, rng.choice([-10, 10]) - x.sum()] / 10.0  # tenths with a net of exactly +-1
        rows += [(f"H{h}" if h else None, h * 12 + i, float(v), None if i % 3 else float(v), float(h)) for i, v in enumerate(x)]
    want = {}
    for h, _, d, g, v in rows:
        net = want.setdefault(h, [0.0, 0.0, 0.0])
        for i, y in enumerate((v, g, d)):
            net[i] += y or 0.0
    sign = lambda y: "long" if y > 1 else "short" if y < -1 else "neutral"
    want = {h: tuple(map(sign, net)) for h, net in want.items()}
    assert len({s[2] for s in want.values()}) == 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(h, int(k), d, g, v) for h, k, d, g, v in rows], "h string, k long, delta double, gamma double, vega double")
    out = rk.greek_summary(df.repartition(parts, "k"), by=["h"], order=["k"]).collect()
    assert {r.h: (r.net_vega_sign, r.net_gamma_sign, r.net_delta_sign) for r in out} == want and len(out) == 60


def test_tca_keeps_symbols_without_a_shortfall(spark):
    rows = [("S1", 1, 1.0, 10.0, 10.0, 10.1), ("S2", 1, 1.0, None, None, 10.0), (None, 1, 1.0, 10.0, 10.0, 10.2)]
    df = spark.createDataFrame(rows, "symbol string, side int, quantity double, arrival_price double, decision_price double, fill_price double")
    out = {(r.symbol, r.n_fills): r.median_arrival_bps for r in pr.tca_report(df).collect()}
    assert set(out) == {("S1", 1), ("S2", 1), (None, 1), (None, 3)} and out["S2", 1] is None


def test_every_live_strategy_is_diagnosed(spark):
    good = np.random.default_rng(0).normal(0.001, 0.01, 100)
    base = Panel(returns(spark, s1=good), keys=("strategy_id",), grain="day")
    live = returns(spark, s1=good[:60], s2=good[:60])
    live = live.unionByName(live.filter("strategy_id = 's1'").limit(1).withColumns({"strategy_id": F.lit("s3"), "net": F.lit(None).cast("double")}))
    out = {r.strategy_id: (r.status, r.n_live_observations) for r in pr.live_diagnose(base, Panel(live, keys=("strategy_id",), grain="day")).collect()}
    assert out["s1"][1] == 60 and out["s1"][0] != "insufficient_data"
    assert out["s2"] == ("insufficient_data", 60) and out["s3"] == ("insufficient_data", 0)
