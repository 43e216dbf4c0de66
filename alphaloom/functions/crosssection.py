"""Per-bar features across the universe.

A bar may hold any number of assets.  Means, deviations and regressions are
aggregates per bar (partial sums before the shuffle) joined back to the rows;
ranks and medians use the bucketed positions of `core.ranks`.  No bar is ever
pulled into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.expr import ratio
from ..core.ranks import average_rank, group_quantiles, tally
from .base import Feature, require


def with_group(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Join group aggregates back to the rows.  The aggregate side has one row per
    group; AQE broadcasts it when its measured size allows and splits hot groups
    of the row side otherwise."""
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def rank(df: DataFrame, value: str, name: str = "rank", *, by=("ts",), pct: bool = True) -> DataFrame:
    """Average rank within the bar, as a percentage or plain; NULL for NULL."""
    out = tally(df, list(by), value, prefix="_r_")
    return out.withColumn(name, average_rank("_r_", pct)).drop("_r_lt", "_r_eq", "_r_n")


def zscore(df: DataFrame, value: str, name: str = "z", *, by=("ts",), robust: bool = False) -> DataFrame:
    """Standard score within the bar; robust uses median and scaled MAD."""
    by = list(by)
    if not robust:
        out = with_group(df, by, {"_m": F.avg(value), "_s": F.stddev_samp(value)})
        return out.withColumn(name, ratio(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s")
    out = df.join(group_quantiles(df, by, value, {"_m": 0.5}), by, "left")
    dev = F.abs(F.col(value) - F.col("_m"))
    out = out.join(group_quantiles(out, by, dev, {"_mad": 0.5}), by, "left")
    scale = 1.4826 * F.col("_mad")
    return out.withColumn(name, ratio(F.col(value) - F.col("_m"), scale)).drop("_m", "_mad")


def neutralize(df: DataFrame, value: str, factor: str, name: str = "residual", *, by=("ts",)) -> DataFrame:
    """Residual of the per-bar regression on one factor; NULL below three pairs.

    A constant factor leaves the deviation from the mean.
    """
    both = F.col(value).isNotNull() & F.col(factor).isNotNull()
    y, x = F.when(both, F.col(value)), F.when(both, F.col(factor))
    out = with_group(
        df,
        list(by),
        {
            "_n": F.count(y),
            "_my": F.avg(y),
            "_mx": F.avg(x),
            "_b": F.coalesce(ratio(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0)),
        },
    )
    resid = F.col(value) - F.col("_my") - F.col("_b") * (F.col(factor) - F.col("_mx"))
    return out.withColumn(name, F.when(both & (F.col("_n") >= 3), resid)).drop(
        "_n", "_my", "_mx", "_b"
    )


def unlabelled(df: DataFrame, labels: DataFrame, asset: str = "asset") -> DataFrame:
    """Assets of the panel without an industry label."""
    return df.select(asset).distinct().join(labels, asset, "left_anti")


def industry_neutralize(
    df: DataFrame, labels: DataFrame, value: str, name: str = "neutral", *,
    by=("ts",), asset: str = "asset", industry: str = "industry", check: bool = True,
) -> DataFrame:
    """Deviation from the mean of the asset's industry on the bar."""
    if check:
        missing = unlabelled(df, labels, asset).limit(5).collect()
        require(not missing, f"assets without an industry label: {[r[0] for r in missing]}")
    out = df.join(labels.select(asset, industry), asset)
    out = with_group(out, list(by) + [industry], {"_m": F.avg(value)})
    return out.withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def skip_momentum(lookback: int = 21, skip: int = 1, price: str = "close") -> Feature:
    """p[t-skip] / p[t-skip-lookback] - 1, a per-asset window used across the bar."""
    require(lookback >= 2, "lookback must be >= 2")
    require(skip >= 1, "skip must be >= 1")
    return Feature(
        lambda f: ratio(f.lag(price, skip), f.lag(price, skip + lookback)) - 1,
        needs=(price,),
        back=skip + lookback,
    )
