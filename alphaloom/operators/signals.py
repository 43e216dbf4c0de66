"""Option-skew universe signal, the consensus gate and its test against chance."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.draws import UNIT, spread, stream_base, trial_draws
from ..core.expr import col, ratio, valid_frame
from ..core.lineage import checkpointed
from ..core.panel import Frame, Panel
from ..core.ranks import group_quantiles, positions
from ..core.scan import numbered
from ..functions.base import Feature, add_features
from ..functions.timeseries import forward_return, midrank_percentile

HORIZONS = (5, 10, 21)


def vol_points(c: str | Column) -> Column:
    """Implied vol in percentage points; values up to 3 are read as decimals."""
    c = col(c).cast("double")
    return F.when(F.abs(c) > 3.0, c).otherwise(c * 100.0)


def sigma_momentum(price: str = "clsPx") -> Feature:
    """Five-bar move over the trailing 20-bar volatility scaled to five bars."""

    def build(f: Frame) -> Column:
        hv = valid_frame(F.stddev_pop("_logret"), "_logret", f.rows(-20, -1), 18) * math.sqrt(252)
        move = F.col(price) - f.lag(price, 5)
        return F.bround(ratio(move, F.col(price) * hv * math.sqrt(5 / 252)), 3)

    def logret(f: Frame) -> Column:
        now, prev = F.col(price), f.lag(price, 1)
        return F.when((now > 0) & (prev > 0), F.ln(now) - F.ln(prev))

    return Feature(build, needs=(price,), back=21, pre={"_logret": logret})


def universe_signal(panel: Panel, lookback: int = 252) -> DataFrame:
    """Signal inputs per (ticker, tradeDate) from merged cores, dailies and vendor ranks.

    All windows share the ticker partition.  Tickers with fewer than lookback / 2
    rows are left out first: by a count in the same partition where no ticker is
    long, else by a semi join on grouped counts.
    """
    keys = list(panel.keys)
    least = lookback // 2
    if panel.bounded:
        n = F.count("*").over(Window.partitionBy(*keys))
        rows = panel.df.withColumn("_c", n).filter(F.col("_c") >= least).drop("_c")
    else:
        counts = panel.df.groupBy(*keys).agg(F.count("*").alias("_c")).filter(F.col("_c") >= least)
        rows = panel.df.join(counts, keys, "left_semi")
    atm, call, put = vol_points("iv30d"), vol_points("dlt25Iv30d"), vol_points("dlt75Iv30d")
    rows = rows.withColumns({"atmIV": atm, "callRaw": call - atm, "putRaw": put - atm})
    rows = rows.withColumns(
        {"skew": F.col("putRaw") - F.col("callRaw"), "rr": F.col("callRaw") - F.col("putRaw")}
    )
    out = add_features(
        panel.with_df(rows),
        {
            "skewDelta": Feature(
                lambda f: F.bround(F.col("skew") - f.lag("skew", 5), 2), needs=("skew",), back=5
            ),
            "putP": midrank_percentile("putRaw", lookback),
            "callP": midrank_percentile("callRaw", lookback),
            "rrP": midrank_percentile("rr", lookback),
            "_ivLocal": midrank_percentile("atmIV", lookback),
            "sigma": sigma_momentum("clsPx"),
        },
    )
    vendor = F.col("ivPct1y").cast("double")
    return out.withColumns(
        {
            "ivP": F.coalesce(vendor, F.col("_ivLocal")),
            "ivP_source": F.when(vendor.isNotNull(), "vendor_ivPct1y").otherwise("local_pctl"),
        }
    ).select(
        *keys, panel.ts, "clsPx", "atmIV", "callRaw", "putRaw", "skew", "rr", "skewDelta",
        "putP", "callP", "rrP", "ivP", "ivP_source", "sigma",
    )


# Fixed values of the signal: percentile zones, look-backs, steps and side words.
STALL_ROWS, STALL_DRIFT = 4, 0.3
TURN_ROWS, TURN_STEP = 3, 0.2
NAMES = {1: "BULL", -1: "BEAR"}
DIRECTIONS = {"BULL": "CONSENSUS SHORT", "BEAR": "CONSENSUS LONG"}


@dataclass(frozen=True)
class ConsensusOptions:
    """`zones` are the low and high percentile corners; `confirm` names the momentum tests
    ("stall", "div") that any, or with `confirm_all` all, must support a side."""

    zones: tuple[float, float] = (25.0, 75.0)
    freshness: int = 3
    sigma_threshold: float = 1.0
    confirm: tuple[str, ...] = ("stall", "div")
    confirm_all: bool = False
    sides: tuple[str, ...] = ("BULL", "BEAR")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _zone(c: str, zones: tuple[float, float]) -> Column:
    """1 in the high corner, -1 in the low one, else (and for NULL) 0."""
    return F.when(F.col(c) >= zones[1], 1).when(F.col(c) <= zones[0], -1).otherwise(0)


def _momentum(frame: Frame, threshold: float) -> dict[str, Column]:
    """Signed momentum tests: 1 speaks for BULL, -1 for BEAR, 0 for neither.

    stall: the least |sigma| of the last rows, all of one sign, is beyond the threshold while
    sigma hardly moved over them.  div: the skew change kept one sign for the rows before and
    now steps against it."""
    whole, before = frame.rows(1 - STALL_ROWS, 0), frame.rows(-TURN_ROWS, -1)
    complete = F.count("sigma").over(whole) == STALL_ROWS
    steady = F.abs(F.col("sigma") - F.first("sigma").over(whole)) < STALL_DRIFT
    level = F.when(F.min("sigma").over(whole) >= threshold, 1).when(F.max("sigma").over(whole) <= -threshold, -1)
    run = F.sum(F.signum("skewDelta")).over(before) / -TURN_ROWS
    side = F.when(F.abs(run) == 1, run.cast("int"))
    turned = side * F.col("skewDelta") > side * frame.lag("skewDelta") + TURN_STEP
    return {
        "stall": F.coalesce(F.when(complete & steady, level), F.lit(0)),
        "div": F.coalesce(F.when(turned, side), F.lit(0)),
    }


def consensus(panel: Panel, opts: ConsensusOptions = ConsensusOptions()) -> DataFrame:
    """Flags of the three stages and the fired side; unknown inputs support no side.

    Each stage is one signed column.  M1 and M2 (percentile corners) hold for a side if it
    was seen within `freshness` rows, M3 (momentum) must hold now.
    """
    absent = [c for c in ("putP", "callP", "ivP", "rrP", "sigma", "skewDelta") if c not in panel.df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    put, call, iv, rr = (_zone(c, opts.zones) for c in ("putP", "callP", "ivP", "rrP"))
    frame = panel.frame(back=max(STALL_ROWS - 1, TURN_ROWS, opts.freshness - 1))
    frame = frame.with_df(
        frame.df.withColumns({"_m1": F.when(put == -call, call).otherwise(0), "_m2": F.when(iv == 1, rr).otherwise(0)})
    )
    tests = _momentum(frame, opts.sigma_threshold)
    frame = frame.with_df(frame.df.withColumns({f"_{k}": c for k, c in tests.items()}))
    recent = frame.rows(1 - opts.freshness, 0)
    flags: dict[str, Column] = {}
    fires: dict[str, Column] = {}
    for sign, name in NAMES.items():
        low = name.lower()
        for m in ("m1", "m2"):
            flags[f"{m}_recent_{low}"] = F.max((F.col(f"_{m}") == sign).cast("int")).over(recent) == 1
        for k in tests:
            flags[f"m3_{k}_{low}"] = F.col(f"_{k}") == sign
        support = [(F.col(f"_{k}") == sign).cast("int") for k in opts.confirm]
        wanted = len(support) if opts.confirm_all else min(1, len(support))
        flags[f"m3_{low}"] = sum(support, F.lit(0)) >= wanted
        if name in opts.sides:
            fires[name] = F.col(f"m1_recent_{low}") & F.col(f"m2_recent_{low}") & F.col(f"m3_{low}")
    words = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    side = F.coalesce(*[F.when(c, name) for name, c in fires.items()], F.lit(None).cast("string"))
    df = frame.df.withColumns(flags).withColumns(
        {"m1_side": F.try_element_at(words, "_m1"), "m2_side": F.try_element_at(words, "_m2"), "side": side}
    )
    said = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    df = df.withColumn("direction", F.when(F.col("side").isNotNull(), F.try_element_at(said, "side")))
    return frame.core(df.drop("_m1", "_m2", *[f"_{k}" for k in tests]))


def signal_sign(side: str | Column = "side") -> Column:
    """A BULL setup is faded (-1), a BEAR setup bought (+1)."""
    side = col(side)
    return F.when(side == "BULL", -1).when(side == "BEAR", 1).otherwise(0)


FIRE_COLUMNS = (
    "side", "direction", "m1_side", "m2_side", "m3_stall_bull", "m3_stall_bear", "m3_div_bull",
    "m3_div_bear", "putP", "callP", "ivP", "rrP", "sigma", "skewDelta", "clsPx",
)


def consensus_fires(flags: DataFrame, keys: list[str]) -> DataFrame:
    keep = [c for c in FIRE_COLUMNS if c in flags.columns]
    return flags.filter(F.col("side").isNotNull()).select(
        *keys, *keep, signal_sign().alias("sign")
    )


# --- signal against chance ---------------------------------------------------------------


def forward_panel(panel: Panel, horizons: tuple[int, ...] = HORIZONS, price: str = "clsPx") -> Panel:
    """Forward returns per horizon; a price that is not positive gives none."""
    clean = panel.df.withColumn("_px", F.when(F.col(price) > 0, F.col(price)))
    feats = {f"fwd{h}": forward_return(h, "_px") for h in horizons}
    return panel.with_df(add_features(panel.with_df(clean), feats).drop("_px"))


def by_horizon(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per horizon with its forward return."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd{h}").alias("fwd")) for h in horizons])
    out = df.withColumn("_h", F.explode(pairs)).drop(*[f"fwd{h}" for h in horizons])
    return out.select("*", "_h.*").drop("_h")


def eligible(long: DataFrame, *, price: str = "clsPx", price_floor: float = 1.0, max_abs: float = 5.0,
             iv_floor: float | None = None) -> DataFrame:
    """Rows a random pick may land on: known return, price at the floor or above,
    return inside the cap; optionally high implied vol only."""
    ok = F.col("fwd").isNotNull() & (F.col(price) >= price_floor) & (F.abs("fwd") <= max_abs)
    if iv_floor is not None:
        ok = ok & (F.col("ivP") >= iv_floor)
    return long.filter(ok)


def pool_counts(long: DataFrame, *, price: str = "clsPx", price_floor: float = 1.0, max_abs: float = 5.0,
                iv_floor: float | None = None) -> DataFrame:
    """Pool size per horizon and the rows dropped for price and for return."""
    known = F.col("fwd").isNotNull()
    floor_ok, cap_ok = F.col(price) >= price_floor, F.abs("fwd") <= max_abs
    iv_ok = F.lit(True) if iv_floor is None else F.coalesce(F.col("ivP") >= iv_floor, F.lit(False))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return long.groupBy("horizon").agg(
        n(known & floor_ok & cap_ok & iv_ok).alias("n_pool"),
        n(known & ~floor_ok).alias("dropped_below_price_floor"),
        n(known & floor_ok & ~cap_ok).alias("dropped_extreme_return"),
    )


POOL, FIRES, DRAWN = 1 << 18, 4096, 256  # pool rows and fires of a block, fires drawn for at once


def bootstrap_means(fires: DataFrame, pool: DataFrame, *, date: str, keys: list[str], n_boot: int = 2000,
                    seed: int = 0) -> DataFrame:
    """(horizon, replicate, boot_mean, n_used): every fire replaced by a random pool
    row of its date, its side kept.

    A date's pool is numbered by the range-partitioned ranks and travels as arrays of up to
    POOL values, its fires as blocks of about FIRES counters and signs.  A task draws all
    replicates of a block as a matrix and hands on one line of sums per horizon and replicate, so
    neither draws nor replicates are shuffled, and a date with a third of all rows is many blocks.
    """
    day = ["horizon", date]
    at = positions(pool, day, F.struct(*keys, "fwd"))
    chunks = (
        at.select(*day, "_lt", "_n", F.explode(F.array_repeat("_v.fwd", F.col("_eq").cast("int"))).alias("x"))
        .groupBy(*day, F.floor(F.col("_lt") / POOL).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("_lt", "x"))).alias("p"), F.first("_n").alias("n"))
        .select(*day, "n", F.col("p._lt")[0].alias("start"), F.col("p.x").alias("pool"))
    )
    sizes = fires.groupBy(*day).agg(F.count("*").alias("fired"))
    part = F.pmod(F.xxhash64(*keys), F.greatest(F.ceil(F.col("fired") / FIRES), F.lit(1)))
    blocks = (
        fires.join(sizes, day).groupBy(*day, part.alias("block"))
        .agg(F.collect_list(F.struct(stream_base(seed + 1, *keys, date, "horizon").alias("base"), F.col("sign").cast("double").alias("sign"))).alias("f"))
        .select(*day, F.col("f.base").alias("base"), F.col("f.sign").alias("sign"))
    )
    replicates = np.arange(1, n_boot + 1)

    def draw(frames):
        total: dict = {}
        for f in frames:
            for row in f.itertuples(index=False):
                sums = total.setdefault(row.horizon, np.zeros((2, n_boot)))
                values, base, sign = (np.asarray(x) for x in (row.pool, row.base, row.sign))
                for lo in range(0, len(base), DRAWN):
                    u = trial_draws(base[lo : lo + DRAWN, None], replicates[None, :], np.int64(1))[0] / UNIT
                    pick = np.floor(u * row.n).astype(np.int64) - row.start
                    here = (pick >= 0) & (pick < len(values))
                    drawn = np.where(here, values[np.clip(pick, 0, len(values) - 1)], 0.0)
                    sums += ((drawn * sign[lo : lo + DRAWN, None]).sum(axis=0), here.sum(axis=0))
        for h, (s, n) in total.items():
            yield pd.DataFrame({"horizon": h, "replicate": replicates, "s": s, "n": n.astype(np.int64)})

    kind = fires.schema["horizon"].dataType.simpleString()
    met = spread(blocks.join(chunks, day).select("horizon", "n", "start", "pool", "base", "sign"), "horizon", "base")
    lines = met.mapInPandas(draw, f"horizon {kind}, replicate int, s double, n bigint")
    return lines.groupBy("horizon", "replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n_used")).select(
        "horizon", "replicate", ratio("s", "n_used").alias("boot_mean"), "n_used"
    )


def beat_pool_median(fires: DataFrame, pool: DataFrame, *, date: str) -> DataFrame:
    """Share of fires that beat the median pool return of their date, by side."""
    medians = group_quantiles(pool, ["horizon", date], "fwd", {"pool_median": 0.5})
    won = F.col("sign") * F.col("fwd") > F.col("sign") * F.col("pool_median")
    return fires.join(medians, ["horizon", date]).groupBy("horizon").agg(
        F.avg(won.cast("double")).alias("beat_pool_median_rate")
    )


def signal_vs_random(panel: Panel, opts: ConsensusOptions = ConsensusOptions(), *, n_boot: int = 2000,
                     seed: int = 0, start: str | None = None, price_floor: float = 1.0, max_abs: float = 5.0,
                     iv_floor: float | None = None, horizons: tuple[int, ...] = HORIZONS,
                     pit_lookback: int | None = None) -> DataFrame:
    """Verdict per horizon of fired signals against date-matched random picks.

    `pit_lookback` rebuilds the implied-vol percentile from earlier local values
    only.  `start` restricts the scored fires, not the history behind them.
    """
    keys, date = list(panel.keys), panel.ts
    if pit_lookback is not None:
        pit = midrank_percentile("atmIV", pit_lookback, min_valid=pit_lookback // 2, padded=True, digits=None)
        panel = panel.with_df(add_features(panel, {"ivP_pit": pit}).withColumn("ivP", F.col("ivP_pit")).drop("ivP_pit"))
    flags = panel.with_df(consensus(panel, opts))
    rows = forward_panel(flags, horizons).df.withColumn("sign", signal_sign())
    # pool, fires, medians and counts all read these rows: run the windows once
    rows = checkpointed(rows.select(*keys, date, "clsPx", "ivP", "side", "sign", *[f"fwd{h}" for h in horizons]))
    slim = by_horizon(rows, horizons)
    guard = dict(price_floor=price_floor, max_abs=max_abs)
    pool = eligible(slim, iv_floor=iv_floor, **guard)
    fired = eligible(slim, **guard).filter(F.col("side").isNotNull())
    if start is not None:
        fired = fired.filter(F.col(date) >= F.lit(start).cast("date"))
    signed = fired.withColumn("pnl", F.col("sign") * F.col("fwd"))
    stats = signed.groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg("pnl").alias("signal_mean"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("signal_hit_rate"),
        ratio(F.avg("pnl"), F.stddev_pop("pnl")).alias("signal_sharpe"),
    ).join(group_quantiles(signed, ["horizon"], "pnl", {"signal_median": 0.5}), "horizon")
    boots = bootstrap_means(fired, pool, date=date, keys=keys, n_boot=n_boot, seed=seed)
    m = F.col("boot_mean")
    rand = boots.join(stats.select("horizon", "signal_mean"), "horizon").groupBy("horizon").agg(
        F.avg(m).alias("random_mean"), F.stddev_samp(m).alias("random_std"),
        ((F.sum((m >= F.col("signal_mean")).cast("int")) + 1) / F.lit(n_boot + 1.0)).alias("p_value"),
    )
    out = (
        stats.join(rand, "horizon", "left")
        .join(beat_pool_median(fired, pool, date=date), "horizon", "left")
        .join(pool_counts(slim, iv_floor=iv_floor, **guard), "horizon", "left")
    )
    return out.withColumn("z", ratio(F.col("signal_mean") - F.col("random_mean"), "random_std"))


def summary_lines(results: DataFrame) -> DataFrame:
    """One readable line per horizon."""
    line = F.format_string(
        "%dd: n=%d  signal=%+.2f%%  random=%+.2f%%  z=%+.2f  p=%.4f  hit=%.1f%%  sharpe=%.3f",
        "horizon", "n", F.col("signal_mean") * 100, F.col("random_mean") * 100, "z", "p_value",
        F.col("signal_hit_rate") * 100, "signal_sharpe",
    )
    return results.select("horizon", line.alias("line"))


def validate_trades(panel: Panel, trades: DataFrame, opts: ConsensusOptions = ConsensusOptions(), *,
                    warmup: int = 252, ticker: str = "Ticker", entry: str = "Entry") -> DataFrame:
    """Replay against accepted trades: matches per warm and cold trades.

    `trades` holds parsed columns (Side, m1, stall, divergence).  Only tickers that
    occur among the trades are replayed.
    """
    key, date = panel.keys[0], panel.ts
    wanted = trades.select(F.col(ticker).alias(key)).distinct()
    seen = panel.with_df(panel.df.join(wanted, key, "left_semi"))
    rows = numbered(seen.with_df(consensus(seen, opts)).frame(), "_prior").core()
    port = rows.select(
        F.col(key).alias(ticker), F.col(date).alias(entry), F.col("side").alias("_side"), "_prior",
        "m3_stall_bull", "m3_stall_bear", "m3_div_bull", "m3_div_bear", "putP", "callP", "ivP", "rrP",
        F.lit(True).alias("_found"),
    )
    j = trades.join(port, [ticker, entry], "left")
    found, fired = F.coalesce("_found", F.lit(False)), F.col("_side").isNotNull()
    csv_side = F.when(F.col("Side").isin("BULL", "BEAR"), F.col("Side")).otherwise(F.col("m1"))
    side_ok = _yes((csv_side == F.col("_side")) & csv_side.isin("BULL", "BEAR"))
    pick = lambda kind: F.when(F.col("_side") == "BULL", F.col(f"m3_{kind}_bull")).otherwise(F.col(f"m3_{kind}_bear"))
    yes = lambda c: _yes(F.upper(c) == "Y")
    near = F.lit(False)
    for c in ("putP", "callP", "ivP", "rrP"):
        near = near | _yes((F.abs(F.col(c) - 25) < 0.6) | (F.abs(F.col(c) - 75) < 0.6))
    miss = found & (~fired | ~side_ok)
    group = F.when(~found, "missing").when(F.col("_prior") >= warmup, "warm").otherwise("cold")
    n = lambda c: F.sum(c.cast("bigint"))
    return j.groupBy(group.alias("bucket")).agg(
        F.count("*").alias("trades"),
        n(found).alias("matched"),
        n(found & fired).alias("fired"),
        n(found & ~fired).alias("nonfire"),
        n(found & fired & side_ok).alias("side_match"),
        n(found & fired & (yes(F.col("stall")) == pick("stall"))).alias("stall_match"),
        n(found & fired & (yes(F.col("divergence")) == pick("div"))).alias("div_match"),
        n(miss & near).alias("misses_near_corner"),
        n(miss & ~near).alias("misses_material"),
    )
