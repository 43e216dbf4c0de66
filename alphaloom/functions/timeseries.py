"""Per-asset features.  Every one reads rows strictly before its own row, so a
value is known before the bar it stands on is traded."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.expr import full_frame, log_ratio, ratio, valid_frame
from ..core.panel import Frame, Panel
from .base import Feature, require


def momentum(window: int = 21, price: str = "close") -> Feature:
    """p[t-1] / p[t-1-window] - 1."""
    require(window >= 1, "window must be >= 1")
    return Feature(
        lambda f: ratio(f.lag(price, 1), f.lag(price, 1 + window)) - 1,
        needs=(price,),
        back=window + 1,
    )


def rolling_zscore(window: int = 21, price: str = "close") -> Feature:
    """Distance of the last price from its trailing mean, in sample deviations."""
    require(window >= 2, "window must be >= 2")

    def build(f: Frame) -> Column:
        w = f.rows(-window, -1)
        mean = full_frame(F.avg(price), price, w, window)
        std = full_frame(F.stddev_samp(price), price, w, window)
        return ratio(f.lag(price, 1) - mean, std)

    return Feature(build, needs=(price,), back=window)


def realized_volatility(window: int = 21, price: str = "close") -> Feature:
    """Sample deviation of the last `window` log returns, not annualised."""
    require(window >= 2, "window must be >= 2")
    lr = f"_lr_{price}"
    return Feature(
        lambda f: full_frame(F.stddev_samp(lr), lr, f.rows(-window, -1), window),
        needs=(price,),
        back=window + 1,
        pre={lr: lambda f: log_ratio(price, f.lag(price, 1))},
    )


def _trailing_mean(value: Callable[[], Column], window: int):
    """Mean over the full trailing window; columns are made when the feature is
    built, because a Column needs a running session."""
    return lambda f: full_frame(F.avg(value()), value(), f.rows(-window, -1), window)


def range_pct(window: int = 21) -> Feature:
    """Mean of (high - low) / close."""
    return Feature(
        _trailing_mean(lambda: ratio(F.col("high") - F.col("low"), "close"), window),
        needs=("high", "low", "close"),
        back=window,
    )


def parkinson_volatility(window: int = 21) -> Feature:
    """sqrt(mean(ln(H/L)^2) / (4 ln 2))."""
    require(window >= 2, "window must be >= 2")
    mean = _trailing_mean(lambda: F.pow(log_ratio("high", "low"), 2), window)
    return Feature(
        lambda f: F.sqrt(mean(f) * (1.0 / (4.0 * math.log(2.0)))),
        needs=("high", "low"),
        back=window,
    )


def garman_klass_volatility(window: int = 21) -> Feature:
    """sqrt(mean(ln(H/L)^2 / 2 - (2 ln 2 - 1) ln(C/O)^2)), NULL for a negative mean."""
    require(window >= 2, "window must be >= 2")

    def term() -> Column:
        body = F.pow(log_ratio("close", "open"), 2)
        return 0.5 * F.pow(log_ratio("high", "low"), 2) - (2 * math.log(2.0) - 1) * body

    mean = _trailing_mean(term, window)
    return Feature(
        lambda f: F.when(mean(f) >= 0, F.sqrt(mean(f))),
        needs=("open", "high", "low", "close"),
        back=window,
    )


def vwap_deviation(window: int = 21) -> Feature:
    """Last close against the volume-weighted price of the trailing window."""
    require(window >= 2, "window must be >= 2")

    def build(f: Frame) -> Column:
        cv = F.col("close") * F.col("volume")
        w = f.rows(-window, -1)
        vwap = ratio(
            full_frame(F.sum(cv), cv, w, window),
            full_frame(F.sum("volume"), "volume", w, window),
        )
        return ratio(f.lag("close", 1), vwap) - 1

    return Feature(build, needs=("close", "volume"), back=window)


def forward_return(horizon: int = 1, price: str = "close") -> Feature:
    """p[t+h] / p[t] - 1.  A target, never an input."""
    require(horizon >= 1, "horizon must be >= 1")
    return Feature(
        lambda f: ratio(f.lead(price, horizon), price) - 1, needs=(price,), ahead=horizon
    )


def simple_return(price: str = "close") -> Feature:
    """p[t] / p[t-1] - 1: what a position held into the bar earns."""
    return Feature(lambda f: ratio(price, f.lag(price, 1)) - 1, needs=(price,), back=1)


def triple_barrier(
    upper_pct: float, lower_pct: float, max_holding: int, price: str = "close"
) -> Feature:
    """+1 / -1 / 0 by the barrier touched first in the next `max_holding` bars;
    NULL where fewer bars follow."""
    require(upper_pct > 0 and lower_pct > 0, "barriers must be positive fractions")
    require(max_holding >= 1, "max_holding must be >= 1")

    def build(f: Frame) -> Column:
        # structs keep the positions of NULL prices, which collect_list drops
        path = F.collect_list(F.struct(F.col(price).alias("p"))).over(f.rows(1, max_holding))
        up = F.col(price) * (1.0 + upper_pct)
        down = F.col(price) * (1.0 - lower_pct)
        touch = F.filter(path, lambda s: (s["p"] >= up) | (s["p"] <= down))
        first = F.try_element_at(touch, F.lit(1))["p"]
        label = F.when(first >= up, 1).when(first <= down, -1).otherwise(0)
        return F.when(F.size(path) == max_holding, label)

    return Feature(build, needs=(price,), ahead=max_holding)


def trailing_counts(values: Column, current: Column) -> tuple[Column, Column, Column]:
    """Smaller, equal and all values of a collected trailing window.

    Sorting and removing run as compiled loops; a filter with a lambda would be
    interpreted for every element of every window.
    """
    smaller = F.array_position(F.sort_array(F.array_append(values, current)), current) - 1
    equal = F.size(values) - F.size(F.array_remove(values, current))
    return smaller, equal, F.size(values)


def midrank_percentile(
    value: str, lookback: int = 252, *, min_valid: int | None = None, padded: bool = False,
    digits: int | None = 1,
) -> Feature:
    """Percentile of a value among the `lookback` values strictly before it.

    Ties count half.  Unpadded, the first `lookback` rows have no value; padded,
    a row needs `min_valid` earlier values only.
    """
    least = lookback // 2 if min_valid is None else min_valid

    def build(f: Frame) -> Column:
        seen = F.collect_list(value).over(f.rows(-lookback, -1))
        lt, eq, n = trailing_counts(seen, F.col(value))
        pct = ratio(lt + eq / F.lit(2.0), n) * 100.0
        if digits is not None:
            pct = F.bround(pct, digits)
        ok = F.col(value).isNotNull() & (n >= least)
        if not padded:
            rows = F.count(F.lit(1)).over(f.rows(-lookback, -1))
            ok = ok & (rows == lookback)
        return F.when(ok, pct)

    return Feature(build, needs=(value,), back=lookback)


def trailing_pct_rank(value: str, lookback: int = 252, min_valid: int = 120) -> Feature:
    """Average-tie percentage rank of the last value in its own trailing window."""

    def build(f: Frame) -> Column:
        seen = F.collect_list(value).over(f.rows(-lookback, -1))
        last = f.lag(value, 1)
        lt, eq, n = trailing_counts(seen, last)
        return F.when(
            last.isNotNull() & (n >= min_valid), ratio(lt + (eq + 1) / F.lit(2.0), n)
        )

    return Feature(build, needs=(value,), back=lookback)


def lagged_zscore(value: str, lookback: int, min_valid: int) -> Feature:
    """(x[t-1] - mean) / deviation over the trailing window, from `min_valid` values."""

    def build(f: Frame) -> Column:
        w = f.rows(-lookback, -1)
        mean = valid_frame(F.avg(value), value, w, min_valid)
        std = valid_frame(F.stddev_samp(value), value, w, min_valid)
        return ratio(f.lag(value, 1) - mean, std)

    return Feature(build, needs=(value,), back=lookback)


# --- exponentially weighted mean -------------------------------------------------


def ewma(panel: Panel, halflife: float, price: str = "close", name: str = "ewma") -> DataFrame:
    """Exponentially weighted mean of the price up to the previous bar.

    The recursion y <- (1-a) y + a x is not a window function.  Each segment of a
    key's history runs it in its own task, written as an affine map of the mean
    held at the segment's first price; a fold over the few segments then gives the
    mean each one starts from.  A missing price keeps the mean and lets its weight
    decay until the next price.
    """
    require(halflife > 0, "halflife must be > 0")
    keep = 0.5 ** (1.0 / halflife)
    alpha = 1.0 - keep
    frame = panel.frame(back=1)
    lagged = frame.df.withColumn("_x", frame.lag(price, 1))
    lagged = (
        lagged.filter("_core").drop("_core")
        if frame.segmented
        else lagged.withColumn("_seg", F.lit(0).cast("bigint"))
    )
    keys, ts = list(panel.keys), panel.ts
    by = keys + ["_seg"]
    extra = "_a double, _b double, _x0 double, _i0 bigint, _gap bigint, _row bigint"
    local_schema = T.StructType(lagged.schema.fields + T.StructType.fromDDL(extra).fields)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x = pdf["_x"].to_numpy(dtype=float)
        n = len(x)
        a_out, b_out, gaps = np.full(n, np.nan), np.full(n, np.nan), np.empty(n, dtype=int)
        valid = np.flatnonzero(~np.isnan(x))
        i0 = int(valid[0]) if len(valid) else -1
        a, b, gap = 1.0, 0.0, 0
        for i in range(n):
            gap = gap + 1 if np.isnan(x[i]) else 0
            if 0 <= i0 < i and gap == 0:
                old = keep ** (1 + (gaps[i - 1] if i else 0))
                k = old / (old + alpha)
                a, b = a * k, b * k + (1.0 - k) * x[i]
            if 0 <= i0 <= i:
                a_out[i], b_out[i] = a, b
            gaps[i] = gap
        return pdf.assign(
            _a=a_out, _b=b_out, _x0=x[i0] if i0 >= 0 else np.nan, _i0=i0, _gap=gaps,
            _row=np.arange(n),
        )

    def first_mean(mean: float, gap: int, x0: float, i0: int) -> float:
        if np.isnan(mean):
            return x0
        old = keep ** (gap + i0 + 1)
        k = old / (old + alpha)
        return k * mean + (1.0 - k) * x0

    start_schema = T.StructType(
        [f for f in lagged.schema.fields if f.name in by]
        + T.StructType.fromDDL("_start double, _first double").fields
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        mean, gap, starts, firsts = np.nan, 0, [], []
        for r in pdf.itertuples():
            start = mean
            if r.i0 < 0:
                first, gap = mean, gap + int(r.last_row) + 1
            else:
                first = first_mean(mean, gap, r.x0, int(r.i0))
                mean, gap = r.a * first + r.b, int(r.gap)
            starts.append(start)
            firsts.append(first)
        return pdf[by].assign(_start=starts, _first=firsts)

    rows = lagged.groupBy(*by).applyInPandas(local, schema=local_schema)
    if frame.segmented:
        ends = rows.groupBy(*by).agg(
            F.max_by(
                F.struct(
                    F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_x0").alias("x0"),
                    F.col("_i0").alias("i0"), F.col("_gap").alias("gap"),
                    F.col("_row").alias("last_row"),
                ),
                "_row",
            ).alias("_m")
        )
        starts = ends.select(*by, "_m.*").groupBy(*keys).applyInPandas(fold, start_schema)
        rows = rows.join(starts, by)
    else:
        rows = rows.withColumns({"_start": F.lit(float("nan")), "_first": F.col("_x0")})
    seen = (F.col("_i0") >= 0) & (F.col("_row") >= F.col("_i0"))
    value = F.when(seen, F.col("_a") * F.col("_first") + F.col("_b")).otherwise(F.col("_start"))
    return rows.withColumn(name, F.when(~F.isnan(value), value)).drop(
        *by[-1:], "_x", "_a", "_b", "_x0", "_i0", "_gap", "_row", "_start", "_first"
    )
