"""Features against pandas, cross sections, leakage."""
import numpy as np
import pandas as pd
import pytest
from helpers import collect
from pyspark.sql import functions as F

from alphaloom.core import Panel
from alphaloom.functions import crosssection as cs
from alphaloom.functions import options as opt
from alphaloom.functions import timeseries as ts
from alphaloom.functions.base import Feature, add_features
from alphaloom.operators import leakage as lk


def by_asset(prices, fn):
    return pd.concat([fn(g) for _, g in prices.sort_values(["asset", "ts"]).groupby("asset")]).to_numpy(float)


def check(panel, prices, feature, fn):
    got = collect(add_features(panel, {"v": feature}), "asset", "ts").v.to_numpy(float)
    np.testing.assert_allclose(got, by_asset(prices, fn), rtol=1e-9, equal_nan=True)


def test_trailing_features_match_pandas(panel, prices):
    n = 10
    check(panel, prices, ts.momentum(n), lambda g: g.close.shift(1) / g.close.shift(1 + n) - 1)
    check(panel, prices, ts.rolling_zscore(n), lambda g: (
        g.close.shift(1) - g.close.shift(1).rolling(n).mean()) / g.close.shift(1).rolling(n).std())
    check(panel, prices, ts.realized_volatility(n), lambda g: np.log(g.close / g.close.shift(1)).shift(1).rolling(n).std())
    check(panel, prices, ts.range_pct(n), lambda g: ((g.high - g.low) / g.close).shift(1).rolling(n).mean())
    check(panel, prices, ts.parkinson_volatility(n), lambda g: np.sqrt(
        (np.log(g.high / g.low) ** 2).shift(1).rolling(n).mean() / (4 * np.log(2))))
    check(panel, prices, ts.vwap_deviation(n), lambda g: g.close.shift(1) / (
        (g.close * g.volume).shift(1).rolling(n).sum() / g.volume.shift(1).rolling(n).sum()) - 1)
    check(panel, prices, opt.vrp_percentile("high", "low", 20, 8), lambda g: (g.high - g.low).shift(1).rolling(20, min_periods=8).rank(pct=True))
    check(panel, prices, opt.skew_zscore("open", 20), lambda g: (
        g.open.shift(1) - g.open.shift(1).rolling(20, min_periods=10).mean()) / g.open.shift(1).rolling(20, min_periods=10).std())
    check(panel, prices, opt.lagged_change("open", 5), lambda g: g.open.shift(1).diff(5))


def test_warm_up_rows_are_null(panel):
    out = collect(add_features(panel, {"v": ts.momentum(21)}), "asset", "ts")
    for _, g in out.groupby("asset"):
        assert g.v.head(22).isna().all() and g.v.iloc[22:].notna().all()


def test_triple_barrier_by_hand(spark):
    px = [100, 101, 103, 99, 95, 100, 100, 100, 100]  # lower bound of 99 is 95.04
    f = pd.DataFrame({"asset": "A", "ts": pd.bdate_range("2020-01-01", periods=9).date, "close": np.array(px, float)})
    p = Panel(spark.createDataFrame(f), grain="day")
    out = collect(add_features(p, {"v": ts.triple_barrier(0.03, 0.04, 3)}), "ts").v
    assert list(out[:6]) == [1, -1, -1, -1, 1, 0] and out[6:].isna().all()


def test_bad_parameters_raise(panel):
    for make in (lambda: ts.momentum(0), lambda: ts.rolling_zscore(1), lambda: ts.triple_barrier(0, 1, 1), lambda: cs.skip_momentum(1)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError, match="missing"):
        add_features(panel.select("close"), {"v": ts.range_pct(5)})


def test_constant_price_has_no_zscore(spark):
    f = pd.DataFrame({"asset": "A", "ts": pd.bdate_range("2020-01-01", periods=20).date, "close": 5.0})
    assert collect(add_features(Panel(spark.createDataFrame(f), grain="day"), {"v": ts.rolling_zscore(5)}), "ts").v.isna().all()


def test_cross_section(spark, prices):
    f = prices.copy()
    f.loc[f.index % 11 == 0, "volume"] = np.nan
    df = spark.createDataFrame(f).withColumn("volume", F.nanvl("volume", F.lit(None)))
    wide = f.pivot(index="ts", columns="asset", values="volume")
    longer = lambda w: w.stack(future_stack=True).rename("v").reset_index().sort_values(["asset", "ts"]).v.to_numpy(float)
    got = collect(cs.rank(df, "volume"), "asset", "ts")["rank"].to_numpy(float)
    np.testing.assert_allclose(got, longer(wide.rank(axis=1, pct=True)), equal_nan=True)
    got = collect(cs.zscore(df, "volume"), "asset", "ts").z.to_numpy(float)
    np.testing.assert_allclose(got, longer(wide.sub(wide.mean(axis=1), axis=0).div(wide.std(axis=1), axis=0)), rtol=1e-9, equal_nan=True)


def test_neutralize_removes_the_factor(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    f = pd.DataFrame({"ts": np.repeat(range(100), 5), "asset": list("ABCDE") * 100, "x": x, "y": 2 * x + rng.normal(0, 0.1, 500)})
    out = cs.neutralize(spark.createDataFrame(f), "y", "x").toPandas()
    for _, g in out.groupby("ts"):
        assert abs(np.corrcoef(g.residual, g.x)[0, 1]) < 1e-6


def test_industry_means_are_zero_and_labels_required(spark):
    f = pd.DataFrame({"ts": [1, 1, 1, 2, 2, 2], "asset": list("ABCABC"), "v": [1.0, 3, 10, 2, 4, 20]})
    df = spark.createDataFrame(f)
    labels = spark.createDataFrame([("A", "tech"), ("B", "tech"), ("C", "energy")], "asset string, industry string")
    out = cs.industry_neutralize(df, labels, "v").toPandas()
    assert out.groupby(["ts", "industry"]).neutral.mean().abs().max() < 1e-12
    with pytest.raises(ValueError, match="label"):
        cs.industry_neutralize(df, labels.filter("asset <> 'C'"), "v")


CENTRED = Feature(lambda f: F.avg("close").over(f.rows(-5, 5)), needs=("close",), back=5, ahead=5)


def test_structural_audit_separates_clean_from_leaky(panel):
    feats = {"clean": ts.momentum(10), "z": ts.rolling_zscore(8), "centred": CENTRED, "peek": ts.forward_return(1)}
    out = lk.structural_audit(panel.select("close"), feats).toPandas().groupby("feature").leaky.all()
    assert not out["clean"] and not out["z"] and out["centred"] and out["peek"]


def test_pipeline_contract(panel):
    with pytest.raises(ValueError):
        lk.FeaturePipeline(())
    with pytest.raises(ValueError, match="duplicate"):
        lk.FeaturePipeline((("a", ts.momentum(3)), ("a", ts.momentum(4))))
    withret = panel.with_df(add_features(panel, {"ret": ts.simple_return()}))
    clean = lk.FeaturePipeline((("m", ts.momentum(5)), ("v", ts.realized_volatility(5))))
    assert {"m", "v"} <= set(clean.fit_transform(withret, structural=True).columns)
    leaky = lk.FeaturePipeline((("peek", ts.forward_return(1)),))
    with pytest.raises(lk.LeakageError, match="peek"):
        leaky.fit_transform(withret, target="ret")


def test_correlation_audit_flags_forward_reference(panel):
    withret = panel.with_df(add_features(panel, {"ret": ts.simple_return(), "peek": ts.forward_return(1), "mom": ts.momentum(5)}))
    out = lk.correlation_audit(withret, ["peek", "mom"], "ret").toPandas()
    assert out[out.feature == "peek"].leaky.all()
    assert (out[out.feature == "peek"].reason == "forward_reference").all()


def test_dead_column_stays_null(spark, prices):
    f = prices[["asset", "ts", "close"]].copy()
    f.loc[f.asset == "A01", "close"] = np.nan
    df = spark.createDataFrame(f).withColumn("close", F.nanvl("close", F.lit(None)))
    out = cs.rank(df, "close").toPandas()
    assert out[out.asset == "A01"]["rank"].isna().all() and out[out.asset == "A00"]["rank"].notna().all()
