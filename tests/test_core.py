"""Frames, scans, ranks and draws: the plans for big groups equal the plain ones."""
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from helpers import collect, price_frame
from pyspark.sql import functions as F

from alphaloom.core import Panel, cumulative, group_quantiles, numbered, tally
from alphaloom.core.draws import hash_order, mixed, trial_draws, uniforms
from alphaloom.core.normal import expected_max_normal, normal_cdf, normal_ppf
from alphaloom.core.ranks import average_rank, group_values_at
from alphaloom.functions import options as opt
from alphaloom.functions import timeseries as ts
from alphaloom.functions.base import add_features

FEATURES = {
    "mom": ts.momentum(9), "z": ts.rolling_zscore(7), "rv": ts.realized_volatility(6),
    "fwd": ts.forward_return(8), "label": ts.triple_barrier(0.03, 0.02, 11),
    "pct": ts.midrank_percentile("close", 10), "vrp": opt.vrp_percentile("high", "low", 12, 5),
}


def hot(spark, seed=1, missing=0.3):
    """One asset holds most rows, with gaps; short histories beside it."""
    f = price_frame(4, 300, seed, missing)
    f = pd.concat([f[f.asset == "A00"], f[f.asset != "A00"].groupby("asset").head(15)])
    df = spark.createDataFrame(f)
    return df.withColumn("ts", df.ts.cast("date"))


@pytest.mark.parametrize("rows,block", [(5, "week"), (30, "month"), (17, "day"), (64, "week")])
def test_segmented_windows_equal_plain_ones(spark, rows, block):
    df = hot(spark)
    plain = Panel(df, grain="day")
    cut = Panel(df, grain=None, block=block, segment_rows=rows)
    assert not cut.bounded and plain.bounded
    a = collect(add_features(plain, FEATURES), "asset", "ts")
    b = collect(add_features(cut, FEATURES), "asset", "ts")
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-12)


def test_segments_split_the_hot_key(spark):
    cut = Panel(hot(spark), block="week", segment_rows=20)
    sizes = cut.frame(back=5).df.groupBy("asset", "_seg").count().toPandas()
    assert sizes["count"].max() <= 20 + 5 + 10
    assert len(sizes[sizes.asset == "A00"]) > 5


def test_only_the_calendar_bounds_a_panel(spark):
    df = hot(spark)
    assert Panel(df, grain="day").bounded
    assert not Panel(df).bounded and not Panel(df, grain="hour", segment_rows=10).bounded


def test_running_values_across_segments(spark):
    df = hot(spark).withColumn("r", F.when(F.col("volume") > 300, F.col("close") / 100 - 1))
    outs = {
        "eq": ("product", 1 + F.col("r")), "s": ("sum", "r"), "n": ("count", "r"), "hi": ("max", "r"),
        "lo": ("min", "r"), "la": ("last", "r"),
    }
    a = collect(numbered(cumulative(Panel(df, grain="day").frame(), outs)).core(), "asset", "ts")
    cut = Panel(df, block="week", segment_rows=12)
    b = collect(numbered(cumulative(cut.frame(), outs)).core(), "asset", "ts")
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    g = a[a.asset == "A00"]
    np.testing.assert_allclose(g.s.iloc[-1], g.r.sum(), rtol=1e-9)
    assert list(g.rn) == list(range(len(g)))


@pytest.mark.parametrize("rows", [None, 7, 25])
def test_ewma_matches_pandas_with_gaps_and_segments(spark, rows):
    f = price_frame(3, 90, 4)
    rng = np.random.default_rng(2)
    f.loc[rng.uniform(size=len(f)) < 0.3, "close"] = np.nan
    f.loc[f.asset == "A01", "close"] = f.loc[f.asset == "A01", "close"].where(f.ts > "2020-02-15")
    df = spark.createDataFrame(f)
    df = df.withColumn("ts", df.ts.cast("date")).withColumn("close", F.nanvl("close", F.lit(None)))
    p = Panel(df, grain="day") if rows is None else Panel(df, block="week", segment_rows=rows)
    out = collect(ts.ewma(p.select("close"), halflife=4.0), "asset", "ts")
    want = f.sort_values(["asset", "ts"]).groupby("asset").close.apply(
        lambda s: s.shift(1).ewm(halflife=4.0, adjust=False).mean()
    )
    np.testing.assert_allclose(out.ewma.to_numpy(float), want.to_numpy(float), rtol=1e-10)


def ranked_frame(spark):
    rng = np.random.default_rng(3)
    n = 900
    g = np.where(rng.uniform(size=n) < 0.7, "hot", rng.choice(["a", "b"], n))
    x = np.round(rng.normal(size=n), 1)
    x[rng.uniform(size=n) < 0.3] = 0.5  # a tie with a third of the rows
    f = pd.DataFrame({"id": range(n), "g": g, "x": x})
    f.loc[f.id % 17 == 0, "x"] = np.nan
    return f, spark.createDataFrame(f).withColumn("x", F.nanvl("x", F.lit(None)))


@pytest.mark.parametrize("rows", [None, 1, 7, 40])
def test_rank_matches_pandas(spark, rows):
    f, df = ranked_frame(spark)
    out = collect(tally(df, ["g"], "x", ranges=rows).withColumn("r", average_rank()), "id")
    np.testing.assert_allclose(out.r.to_numpy(float), f.groupby("g").x.rank(pct=True).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("rows", [None, 1, 9])
def test_quantiles_match_numpy(spark, rows):
    f, df = ranked_frame(spark)
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0}
    out = group_quantiles(df, ["g"], "x", probs, ranges=rows).toPandas().set_index("g")
    for n, p in probs.items():
        np.testing.assert_allclose(out[n], f.groupby("g").x.quantile(p).reindex(out.index), rtol=1e-12)
    whole = group_quantiles(df, [], "x", {"m": 0.5}, ranges=rows).first()["m"]
    assert whole == pytest.approx(f.x.median())


def test_values_at_positions(spark):
    f, df = ranked_frame(spark)
    out = group_values_at(df, ["g"], "x", {"p95": lambda n: F.floor(n * 0.95)}, ranges=5).toPandas().set_index("g")
    for g, part in f.dropna().groupby("g"):
        assert out.p95[g] == sorted(part.x)[int(0.95 * len(part))]


def test_digest_order_is_a_permutation_either_way(spark):
    _, df = ranked_frame(spark)
    a = hash_order(df, ["g"], "k", 7, ["id"], small=True).toPandas().set_index("id").k.sort_index()
    b = hash_order(df, ["g"], "k", 7, ["id"], small=False).toPandas().set_index("id").k.sort_index()
    assert (a == b).all()
    sizes = df.groupBy("g").count().toPandas().set_index("g")["count"]
    groups = df.select("id", "g").toPandas().set_index("id").g
    for g, n in sizes.items():
        assert sorted(a[groups[groups == g].index]) == list(range(n))


def test_draws_are_uniform_and_do_not_depend_on_partitions(spark):
    ids = spark.range(4000)
    a, b, c = uniforms(3, 1, "id")
    one = ids.repartition(3).select("id", a.alias("a"), b.alias("b")).toPandas().set_index("id").sort_index()
    two = ids.repartition(7).select("id", a.alias("a"), b.alias("b")).toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(one, two)
    assert abs(one.a.mean() - 0.5) < 0.02 and abs(np.corrcoef(one.a, one.b)[0, 1]) < 0.05


def test_counter_draws_are_uniform_and_independent():
    order, u, v = trial_draws(np.int64(12345), np.arange(1, 201)[:, None], np.arange(300)[None, :])
    assert len(np.unique(mixed(np.arange(1 << 16, dtype=np.uint64)))) == 1 << 16
    for x in (order / 2**32, u, v):
        assert abs(x.mean() - 0.5) < 0.005 and abs(x.std() - 12**-0.5) < 0.005
        assert np.abs(x.mean(axis=0) - 0.5).max() < 0.1 and np.abs(x.mean(axis=1) - 0.5).max() < 0.08
        assert np.abs(np.corrcoef(x[:20])[np.triu_indices(20, 1)]).max() < 0.25
    assert abs(np.corrcoef(u.ravel(), v.ravel())[0, 1]) < 0.02 and abs(np.corrcoef(order.ravel().astype(float), u.ravel())[0, 1]) < 0.02


def test_normal_functions(spark):
    z = np.r_[np.linspace(-9, 9, 61), 0.0]
    p = np.r_[1e-12, np.linspace(0.0005, 0.9995, 60)]
    nd = NormalDist()
    got = spark.createDataFrame(pd.DataFrame({"z": z})).select(normal_cdf("z").alias("c")).toPandas().c
    np.testing.assert_allclose(got, [nd.cdf(v) for v in z], rtol=1e-9, atol=1e-15)
    got = spark.createDataFrame(pd.DataFrame({"p": p})).select(normal_ppf("p").alias("q")).toPandas().q
    np.testing.assert_allclose(got, [nd.inv_cdf(v) for v in p], rtol=1e-10)
    row = spark.range(1).select(
        expected_max_normal(1000).alias("a"), expected_max_normal(F.lit(1000)).alias("b"), expected_max_normal(1).alias("c")
    ).first()
    assert row.a == pytest.approx(row.b, rel=1e-9) and row.c == 0 and 3.2 < row.a < 3.3


@pytest.mark.parametrize("rows", [1, 6])
def test_ranks_keep_null_keys_null_groups_and_large_integers(spark, rows):
    big = 2**53
    data = [(None, 1), (None, 2), (None, None), ("a", big), ("a", big + 1), ("a", big + 1), ("n", None), ("n", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, g string, x long")
    got = {r.id: (r.lt, r.eq, r.n) for r in tally(df, ["g"], "x", ranges=rows).collect()}
    none = (None, None, None)
    assert got == {0: (0, 1, 2), 1: (1, 1, 2), 2: none, 3: (0, 1, 3), 4: (1, 2, 3), 5: (1, 2, 3), 6: none, 7: none}
    q = {r.g: r.m for r in group_quantiles(df, ["g"], "x", {"m": 0.5}, ranges=rows).collect()}
    assert q == {None: 1.5, "a": float(big + 1), "n": None}
    empty = df.limit(0)
    assert tally(empty, ["g"], "x").count() == 0 and group_quantiles(empty, ["g"], "x", {"m": 0.5}).count() == 0
    assert [r.m for r in group_quantiles(empty, [], "x", {"m": 0.5}).collect()] == [None]


def test_segments_keep_null_keys_and_times(spark):
    data = [(k, d, float(i)) for k in ("a", None) for i, d in enumerate([None, *pd.bdate_range("2020-01-01", periods=30).date])]
    df = spark.createDataFrame(data, "asset string, ts date, x double")
    seen = []
    for rows in (7, 10_000):
        frame = Panel(df, block="week", segment_rows=rows).frame(back=1)
        out = frame.core(frame.df.withColumn("before", frame.lag("x", 1)))
        seen.append(sorted(map(tuple, out.select("asset", "ts", "x", "before").collect()), key=repr))
        total = cumulative(Panel(df, block="week", segment_rows=rows).frame(), {"sum": ("sum", "x")}).core()
        seen.append(sorted(map(tuple, total.select("asset", "ts", "x", "sum").collect()), key=repr))
    assert len(seen[0]) == 62 and seen[0] == seen[2] and seen[1] == seen[3]


def test_a_single_key_spreads_over_all_ranges(spark, monkeypatch):
    from alphaloom.core import ranks

    kept = []
    monkeypatch.setattr(ranks, "written", lambda df, name, real=ranks.written: kept.append(real(df, name)) or kept[-1])
    df = spark.range(4000).select(F.lit("k").alias("g"), (F.col("id") * 7919 % 4001).alias("x"))
    at = ranks.positions(df, ["g"], "x", ranges=8)
    rows = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    assert len(rows) == 8 and max(rows) < 1200
    assert [(r._lt, r._eq, r._n) for r in at.orderBy("_v").collect()] == [(i, 1, 4000) for i in range(4000)]
    assert len(kept) == 2 and kept[1].count() <= 16


@pytest.mark.parametrize("block", [1, 7, 64])
def test_ranks_do_not_depend_on_the_size_of_a_block(spark, monkeypatch, block):
    from alphaloom.core import ranks

    data = [(g, x) for g in ("hot", None, "few", "none") for i in range(300 if g == "hot" else 9) for x in [None if g == "none" or i % 11 == 0 else i * 37 % 101]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, g string, x long")
    monkeypatch.setattr(ranks, "BLOCK", block)
    got = {r.id: (r.lt, r.eq, r.n) for r in tally(df, ["g"], "x", ranges=3).collect()}
    for i, (g, x) in enumerate(data):
        of = [y for h, y in data if h == g and y is not None]
        assert got[i] == ((None,) * 3 if x is None else (sum(y < x for y in of), of.count(x), len(of)))
    q = {r.g: r.m for r in group_quantiles(df, ["g"], "x", {"m": 0.5}, ranges=3).collect()}
    assert set(q) == {"hot", None, "few", "none"} and q["none"] is None
    assert q["hot"] == np.median([x for g, x in data if g == "hot" and x is not None])


def test_a_range_passes_its_task_in_blocks(monkeypatch):
    """A task gives rows out before it has read its whole range, and holds no more than a block."""
    import pyarrow as pa

    from alphaloom.core import ranks

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 5)

    monkeypatch.setattr(ranks, "TaskContext", Task)
    read = []
    batch = lambda i: pa.record_batch({"g": ["k"] * 40, "_w": pa.array([1] * 40, pa.int64())})
    out = ranks._count_range(["g"], 100)(read.append(i) or batch(i) for i in range(50))
    first = next(out)
    assert len(read) <= 4 and first.num_rows <= 100 and first.column("_lt").to_pylist() == list(range(first.num_rows))
    rest = list(out)
    assert len(read) == 50 and first.num_rows + sum(b.num_rows for b in rest) == 2000
    assert [b.column("_block")[0].as_py() for b in rest] == list(range(1, len(rest) + 1))
    big = pa.record_batch({"g": ["k"] * 1000, "_w": pa.array([1] * 1000, pa.int64())})
    assert max(b.num_rows for b in ranks._count_range(["g"], 100)(iter([big]))) <= 100
