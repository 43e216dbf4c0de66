"""Backtests, portfolios, folds and significance."""
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from helpers import collect
from pyspark.sql import functions as F

from alphaloom.core import Panel
from alphaloom.operators import backtest as bt
from alphaloom.operators import bars as br
from alphaloom.operators import diagnostics as dg
from alphaloom.operators import factors as fa
from alphaloom.operators import meta
from alphaloom.operators import portfolio as pf
from alphaloom.operators import randomized as rz
from alphaloom.operators import significance as sg
from alphaloom.operators import splits as sp


def series(spark, **cols):
    n = len(next(iter(cols.values())))
    f = pd.DataFrame({"strategy_id": "s", "ts": pd.bdate_range("2015-01-01", periods=n).date, **cols})
    return Panel(spark.createDataFrame(f), keys=("strategy_id",), grain="day")


def reference_metrics(r, ann=252):
    r = pd.Series(r).dropna()
    eq = (1 + r).cumprod()
    return {
        "sharpe_ratio": r.mean() / r.std() * math.sqrt(ann), "max_drawdown": (eq / eq.cummax() - 1).min(),
        "sortino_ratio": r.mean() / math.sqrt((r.clip(upper=0) ** 2).mean()) * math.sqrt(ann), "hit_rate": (r > 0).mean(),
    }


def test_single_backtest_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pos, ret = rng.normal(0, 1, 200), rng.normal(0, 0.01, 200)
    p = series(spark, position=pos, ret=ret)
    out = bt.run_positions(p)
    rows = collect(out.df, "ts")
    held = pd.Series(pos).clip(-1, 1).shift(1).fillna(0)
    net = held * ret - held.diff().abs().fillna(held.abs()) * 8 / 1e4
    np.testing.assert_allclose(rows.net, net, rtol=1e-12)
    m = bt.performance(out, turnover="turnover").first()
    for k, v in reference_metrics(net).items():
        assert m[k] == pytest.approx(v, rel=1e-9), k
    # an unbounded, segmented panel gives the same metrics
    cut = replace(p, grain=None, block="month", segment_rows=23)
    m2 = bt.performance(bt.run_positions(cut), turnover="turnover").first()
    for k in bt.METRICS:
        assert m2[k] == pytest.approx(m[k], rel=1e-9), k


def test_lookahead_pays_only_without_lag(spark):
    ret = np.random.default_rng(7).normal(0, 0.01, 1000)
    p = series(spark, position=np.sign(ret), ret=ret)
    s = {lag: bt.performance(bt.run_positions(p, bt.BacktestConfig(cost_bps=0, execution_lag=lag))).first().sharpe_ratio for lag in (0, 1)}
    assert s[0] > 5 and abs(s[1]) < 1


def test_costs_lower_returns_and_config_is_checked(spark):
    rng = np.random.default_rng(1)
    p = series(spark, position=rng.normal(size=300), ret=rng.normal(0, 0.01, 300))
    a, b = (bt.performance(bt.run_positions(p, bt.BacktestConfig(cost_bps=c))).first().annualized_return for c in (0, 20))
    assert b < a
    with pytest.raises(ValueError):
        bt.BacktestConfig(execution_lag=-1)
    with pytest.raises(ValueError):
        bt.BacktestConfig(bounds=(1, -1))
    with pytest.raises(ValueError):
        br.cost_bps(-1)


def test_flat_or_short_series_have_zero_metrics(spark):
    m = bt.performance(series(spark, net=[0.01])).first()
    assert all(m[k] == 0 for k in bt.METRICS)
    m = bt.performance(series(spark, net=[0.0] * 50)).first()
    assert m.sharpe_ratio == 0 and m.sortino_ratio == 0 and m.max_drawdown == 0


def test_portfolio_matches_a_dense_matrix(spark):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=60)
    f = pd.DataFrame([(d.date(), a) for d in days for a in "ABCD"], columns=["ts", "asset"])
    f["position"], f["ret"] = rng.normal(0, 0.7, len(f)), rng.normal(0, 0.02, len(f))
    f = f[rng.uniform(size=len(f)) > 0.2]  # delistings and holes
    f["strategy_id"] = "b"
    got = collect(pf.portfolio_returns(Panel(spark.createDataFrame(f), keys=("strategy_id", "asset"), grain="day")).df, "ts")
    wide = lambda c: f.pivot(index="ts", columns="asset", values=c).fillna(0.0)
    held = wide("position").clip(-1, 1).shift(1).fillna(0)
    turn = held.diff().abs().fillna(held.abs()).sum(axis=1)
    gross = held.abs().sum(axis=1).replace(0, np.nan)
    net = ((held * wide("ret")).sum(axis=1) / gross).fillna(0) - (turn * 8e-4 / gross).fillna(0)
    np.testing.assert_allclose(got.net, net, atol=1e-12)
    np.testing.assert_allclose(got.turnover, turn, atol=1e-12)


def test_long_short_is_neutral(spark, panel):
    df = panel.df.withColumn("sig", F.sin("close"))
    for w, gross in (("equal", 2.0), ("signal", 1.0)):
        out = pf.long_short_quantile(df, "sig", long_quantile=0.6, short_quantile=0.4, weight=w)
        bar = out.groupBy("ts").agg(F.sum("position").alias("net"), F.sum(F.abs("position")).alias("g")).toPandas()
        if w == "equal":
            assert bar.net.abs().max() < 1e-12
        np.testing.assert_allclose(bar.g, gross, atol=1e-9)
    with pytest.raises(ValueError):
        pf.long_short_quantile(df, "sig", long_quantile=0.2, short_quantile=0.8)


def test_intervals_and_sessions(spark):
    f = pd.concat([
        pd.DataFrame({"asset": "d", "ts": pd.bdate_range("2020-01-01", periods=100)}),
        pd.DataFrame({"asset": "h", "ts": pd.date_range("2020-01-01", periods=100, freq="h")}),
        pd.DataFrame({"asset": "x", "ts": pd.date_range("2020-01-01", periods=5, freq="min")}),
    ])
    p = Panel(spark.createDataFrame(f))
    out = br.infer_interval(p).withColumn("a", br.annualization("interval")).toPandas().set_index("asset")
    assert dict(out.interval) == {"d": "1d", "h": "1h", "x": "1d"} and out.a["h"] == 1764
    hours = br.in_session(p.df.filter("asset = 'h'")).select(F.hour("ts").alias("h")).distinct().toPandas().h
    assert sorted(hours) == [10, 11, 12, 13, 14, 15, 16]


def test_walk_forward_counts_and_errors(spark):
    n = spark.createDataFrame([("s", 1000)], "k string, n bigint")
    folds = sp.walk_forward_folds(n, train_size=500, test_size=100).toPandas()
    assert len(folds) == 5 and (folds.test_start == folds.train_end).all() and folds.test_end.max() == 1000
    ex = sp.walk_forward_folds(n, train_size=500, test_size=100, purge=20, mode="expanding").toPandas()
    assert (ex.train_start == 0).all() and (ex.test_start - ex.train_end == 20).all()
    with pytest.raises(Exception, match="exceeds"):
        sp.walk_forward_folds(n, train_size=900, test_size=200).collect()


def test_walk_forward_rows_match_the_folds(spark):
    rows = spark.range(97).select(F.col("id").alias("rn"), F.lit(97).cast("bigint").alias("n"), F.lit("s").alias("k"))
    for mode in ("rolling", "expanding"):
        kw = dict(train_size=30, test_size=10, purge=3, mode=mode)
        got = sp.walk_forward_rows(rows, **kw).toPandas()
        folds = sp.walk_forward_folds(rows.limit(1).select("k", "n"), **kw).toPandas()
        assert len(folds) == got.fold.nunique()
        for f in folds.itertuples():
            part = got[got.fold == f.fold]
            assert sorted(part.rn) == list(range(f.train_start, f.test_end))
            assert sorted(part[part.is_test].rn) == list(range(f.test_start, f.test_end))


def test_purged_folds_keep_their_distance(spark):
    rows = spark.range(100).select(F.col("id").alias("rn"), F.lit(100).cast("bigint").alias("n"))
    out = sp.purged_kfold(rows, n_splits=5, purge=3, embargo=2).toPandas()
    for _, f in out.groupby("fold"):
        test, train = set(f[f.role == "test"].rn), set(f[f.role == "train"].rn)
        assert len(test) == 20 and not test & train
        lo, hi = min(test), max(test)
        assert not train & set(range(lo - 3, lo)) and not train & set(range(hi + 1, hi + 3))
    cpcv = sp.combinatorial_purged(rows, n_groups=5, n_test_groups=2, purge=2, embargo=1).toPandas()
    assert cpcv.fold.nunique() == 10 and (cpcv[cpcv.role == "test"].groupby("fold").size() == 40).all()
    combos = [tuple(r.groups) for r in sp.combinations(spark, 4, 2).orderBy("fold").collect()]
    assert combos == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_deflated_sharpe_invariants(spark):
    rng = np.random.default_rng(5)
    trials, bars = 200, 400
    f = pd.DataFrame({"strategy_id": np.repeat(np.arange(trials), bars), "net": rng.normal(0, 0.01, trials * bars)})
    df = spark.createDataFrame(f)
    stats = sg.moments(df, by=["strategy_id"])
    got = stats.toPandas().set_index("strategy_id")
    s = f.groupby("strategy_id").net
    np.testing.assert_allclose(got["skew"].sort_index(), s.skew(), rtol=1e-8)
    np.testing.assert_allclose(got["kurt"].sort_index(), s.apply(pd.Series.kurt), rtol=1e-7)
    best = int(got.sr.idxmax())
    p = [sg.deflated_sharpe(stats, n).filter(F.col("strategy_id") == best).first().pvalue for n in (1, 10, trials)]
    assert p[0] < p[1] < p[2] and p[0] < 0.05 < p[2]
    v = sg.trial_variance(df, trial=["strategy_id"]).first()
    assert v.variance == pytest.approx(got.sr.var(), rel=1e-9) and v.n_trials == trials
    with pytest.raises(Exception, match="at least 2"):
        sg.trial_variance(df.filter("strategy_id = 0"), trial=["strategy_id"]).collect()
    flat = spark.createDataFrame(pd.DataFrame({"strategy_id": "c", "net": [0.0001] * 100}))
    row = sg.deflated_sharpe(sg.moments(flat, by=["strategy_id"]), 10).first()
    assert row.sharpe_ratio == 0 and row.pvalue >= 0.5


def test_underwater_runs_and_stability(spark):
    net = [0.1, -0.05, -0.05, 0.3, -0.1, 0.01, 0.01, 0.2]
    row = dg.underwater_runs(series(spark, net=net)).first()
    eq = np.cumprod(1 + np.array(net))
    assert row.drawdown_bars == 3 and row.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())
    assert dg.kfold_stability(series(spark, net=net)).first().status == "insufficient_data"
    r = np.random.default_rng(0).normal(0, 0.01, 43)
    k = dg.kfold_stability(series(spark, net=r)).first()
    sharpes = [round(x.mean() / x.std(ddof=1) * math.sqrt(252), 4) for x in np.array_split(r, 4)]
    assert k.min_fold_sharpe == pytest.approx(min(sharpes)) and k.n_negative_folds == sum(x < 0 for x in sharpes)


def factor_rows(spark):
    rng = np.random.default_rng(2)
    n = 1000
    mkt, smb = rng.normal(0, 0.01, n), rng.normal(0, 0.01, n)
    f = pd.DataFrame({"strategy_id": "s", "ts": pd.bdate_range("2015-01-01", periods=n).date, "mkt": mkt, "smb": smb})
    f["net"] = 0.0002 + 0.5 * mkt - 0.2 * smb + rng.normal(0, 0.004, n)
    return f, spark.createDataFrame(f)


def test_factor_attribution_recovers_betas(spark):
    f, df = factor_rows(spark)
    row = fa.attribution(df, ["mkt", "smb"], by=["strategy_id"]).first()
    x = np.column_stack([np.ones(len(f)), f.mkt, f.smb])
    beta, sse, *_ = np.linalg.lstsq(x, f.net, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse[0] / (len(f) - 3))
    np.testing.assert_allclose([row.alpha, row.beta_mkt, row.beta_smb], beta, rtol=1e-8)
    np.testing.assert_allclose([row.t_alpha, row.t_mkt, row.t_smb], beta / se, rtol=1e-6)
    assert row.r_squared > 0.4 and abs(row.beta_mkt - 0.5) < 0.05


def test_components_and_concentration(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2015-01-01", periods=300).date
    base = rng.normal(0, 0.01, 300)
    make = lambda n, x: pd.DataFrame({"strategy_id": n, "ts": days, "net": x})
    a, b = make("a", base + rng.normal(0, 0.002, 300)), make("b", base + rng.normal(0, 0.002, 300))
    cand = pd.concat([make("same", 0.95 * base), make("own", rng.normal(0, 0.01, 300)), make("short", base).head(40), make("part", base).tail(150)])
    surv, cdf = spark.createDataFrame(pd.concat([a, b])), spark.createDataFrame(cand)
    got = fa.concentration(cdf, surv).toPandas().set_index("strategy_id").concentration
    def want(name):
        c = cand[cand.strategy_id == name].set_index("ts").net
        x = np.column_stack([a.set_index("ts").net.loc[c.index], b.set_index("ts").net.loc[c.index]])
        pc = np.linalg.eigh(np.cov(x.T))[1][:, -1]
        return np.corrcoef(c, x @ pc)[0, 1] ** 2
    for n in ("same", "own", "part"):
        assert got[n] == pytest.approx(want(n), rel=1e-8), n
    assert got["short"] == 0 and got["same"] > 0.9 and got["own"] < 0.1
    one = fa.concentration(cdf, surv.filter("strategy_id = 'a'")).toPandas()
    assert (one.concentration == 0).all()
    pca = fa.pca_table(surv).toPandas()
    cov = np.cov(a.net, b.net)
    val, vec = np.linalg.eigh(cov)
    np.testing.assert_allclose(pca.pc1_loading.abs(), np.abs(vec[:, -1]), rtol=1e-6)
    assert pca.explained_share.max() == pytest.approx(val[-1] / val.sum(), rel=1e-9)
    with pytest.raises(ValueError):
        fa.pca_table(surv.filter("strategy_id = 'a'"))


def test_meta_labels(spark):
    rng = np.random.default_rng(4)
    n = 500
    f = pd.DataFrame({"side": rng.choice([-1.0, 1.0], n), "f1": rng.normal(size=n), "f2": rng.normal(size=n)})
    f["fwd"] = f.side * (0.8 * f.f1 + rng.normal(0, 0.5, n))
    f.loc[::50, "f1"] = np.nan
    df = spark.createDataFrame(f).withColumn("f1", F.nanvl("f1", F.lit(None)))
    model = meta.fit(df, ["f1", "f2"])
    d = f.dropna()
    x, y = np.column_stack([np.ones(len(d)), d.f1, d.f2]), (d.side * d.fwd > 0).to_numpy(float)
    w = np.zeros(3)
    for _ in range(50):  # Newton on the same penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + np.r_[0, w[1:]]
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0, 1, 1.0]), g)
    np.testing.assert_allclose(np.r_[model.intercept, model.coefficients.toArray()], w, rtol=1e-4)
    out = meta.predict(df, model, ["f1", "f2"]).withColumn("pos", meta.apply()).toPandas()
    assert out[out.f1.isna()].probability.isna().all() and (out[out.f1.isna()].pos == 0).all()
    assert set(out.pos.unique()) <= {-1.0, 0.0, 1.0}
    with pytest.raises(ValueError):
        meta.fit(df.limit(20), ["f1", "f2"])


def test_newton_over_purged_folds(spark):
    rng = np.random.default_rng(6)
    n = 600
    f = pd.DataFrame({"fold": np.arange(n) % 3, "side": rng.choice([-1.0, 1.0], n), "f1": rng.normal(size=n), "f2": rng.normal(size=n)})
    f["fwd"] = f.side * (0.9 * f.f1 - 0.3 * f.f2 + rng.normal(0, 0.5, n))
    f.loc[::40, "f2"] = np.nan
    df = spark.createDataFrame(f).withColumn("f2", F.nanvl("f2", F.lit(None)))
    beta, left = meta.newton_folds(df, ["f1", "f2"], 3, l2=2.0)
    assert left.max() < 1e-6
    for k, d in f.dropna().groupby("fold"):
        x, y = np.column_stack([np.ones(len(d)), d.f1, d.f2]), (d.side * d.fwd > 0).to_numpy(float)
        p = 1 / (1 + np.exp(-x @ beta[k]))
        assert np.abs(x.T @ (y - p) - 2.0 * np.r_[0, beta[k][1:]]).max() < 1e-8
    out = meta.predict_folds(df, ["f1", "f2"], beta).toPandas()
    assert out[out.f2.isna()].probability.isna().all() and out.probability.dropna().between(0, 1).all()
    with pytest.raises(ValueError):
        meta.newton_folds(df.limit(60), ["f1", "f2"], 3)
    with pytest.raises(ValueError):
        meta.newton_folds(df, ["f1", "f2"], 4)


def test_permutation_trials_agree_in_both_forms(spark, panel):
    rows = panel.df.withColumns({"position": F.signum(F.sin("close")), "net": F.sin(F.col("close") * 7) / 50}).select("asset", "ts", "position", "net")
    arrays = rz.permutation_trials(Panel(rows, grain="day"), n=60, seed=3)[1]
    single = rz.permutation_trials(Panel(rows), n=60, seed=3)[1]
    a, b = (collect(x, "asset", "trial") for x in (arrays, single))
    assert len(a) == len(b) == 180
    np.testing.assert_allclose(a.sharpe, b.sharpe, rtol=1e-9)
