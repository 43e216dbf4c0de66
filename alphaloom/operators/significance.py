"""Sharpe ratios discounted for the number of trials and the shape of returns."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.expr import bias_corrected_kurtosis, bias_corrected_skew, col
from ..core.normal import expected_max_normal, normal_cdf

MIN_OBS = 30


def moments(df: DataFrame, *, by: list[str], net: str = "net", min_obs: int = MIN_OBS) -> DataFrame:
    """Per series: n, per-period Sharpe sr (0 for a constant series), corrected skew
    and excess kurtosis.  Series below `min_obs` returns are left out."""
    x = F.col(net)
    n, std = F.count(x), F.stddev_samp(x)
    out = df.groupBy(*by).agg(
        n.alias("n"),
        F.when(std >= 1e-12, F.avg(x) / F.nullif(std, F.lit(0.0))).otherwise(0.0).alias("sr"),
        F.coalesce(F.when(n > 3, bias_corrected_skew(n, F.skewness(x))), F.lit(0.0)).alias("skew"),
        F.coalesce(F.when(n > 4, bias_corrected_kurtosis(n, F.kurtosis(x))), F.lit(0.0)).alias("kurt"),
    )
    return out.filter(F.col("n") >= min_obs)


def expected_max_sharpe(n_trials: int | str | Column, variance: str | Column) -> Column:
    """Expected best per-period Sharpe of n_trials strategies without any edge."""
    return F.sqrt(col(variance)) * expected_max_normal(n_trials)


def _shape(weight: Column) -> Column:
    sr = F.col("sr")
    return F.sqrt(F.greatest(1 - F.col("skew") * sr + weight * sr * sr, F.lit(1e-12)))


def deflated_sharpe(
    stats: DataFrame, n_trials: int | str | Column, *, annualization: float = 252,
    benchmark_sharpe: float = 0.0, trial_variance: str | Column | None = None,
) -> DataFrame:
    """Deflated Sharpe per row of `moments`: z and the chance that luck explains it."""
    root = math.sqrt(annualization)
    n = F.col("n")
    variance = 1.0 / F.greatest(n - 1, F.lit(1)) if trial_variance is None else col(trial_variance)
    out = stats.withColumn("_emax", expected_max_sharpe(n_trials, variance))
    z = (F.col("sr") - benchmark_sharpe / root - F.col("_emax")) * F.sqrt(n - 1.0) / _shape(F.col("kurt") / 4.0)
    return out.withColumns(
        {
            "sharpe_ratio": F.col("sr") * root,
            "expected_max_sharpe": F.col("_emax") * root,
            "deflated_sharpe_ratio": (F.col("sr") - F.col("_emax")) * root,
            "z": z,
        }
    ).withColumn("pvalue", 1 - normal_cdf("z")).drop("_emax")


def deflated_sharpe_fork(stats: DataFrame, n_trials: int | str | Column, *, annualization: float = 252) -> DataFrame:
    """Variant with raw kurtosis and a null variance that carries the moment term."""
    n = F.col("n")
    shape = _shape((F.col("kurt") + 3.0 - 1.0) / 4.0)
    sr_std = F.greatest(shape / F.sqrt(n - 1.0), F.lit(1e-6))
    out = stats.withColumns(
        {"_star": sr_std * expected_max_normal(n_trials), "_shape": shape}
    )
    z = (F.col("sr") - F.col("_star")) * F.sqrt(n - 1.0) / F.col("_shape")
    out = out.withColumn("z", z)
    p = F.round(normal_cdf("z"), 4)
    return out.select(
        *[c for c in stats.columns if c not in ("sr", "skew", "kurt", "n")],
        n.alias("n_bars"),
        F.round("sr", 5).alias("per_bar_sharpe"),
        F.round(F.col("sr") * math.sqrt(annualization), 4).alias("annualized_sharpe"),
        F.round("_star", 5).alias("expected_max_sharpe"),
        F.round("skew", 4).alias("skewness"),
        F.round(F.col("kurt") + 3.0, 4).alias("kurtosis"),
        "z",
        p.alias("dsr_probability"),
        F.round(1 - normal_cdf("z"), 4).alias("dsr_pvalue"),
    )


def probabilistic_sharpe(stats: DataFrame, *, benchmark_sharpe: float = 0.0, annualization: float = 252) -> DataFrame:
    """Probability that the true Sharpe exceeds the benchmark."""
    z = (F.col("sr") - benchmark_sharpe / math.sqrt(annualization)) * F.sqrt(F.col("n") - 1.0)
    out = stats.withColumn("z", z / _shape(F.col("kurt") / 4.0))
    return out.withColumn("psr", normal_cdf("z"))


def trial_variance(df: DataFrame, *, trial: list[str], by: list[str] = (), net: str = "net",
                   annualization: float | None = None) -> DataFrame:
    """Sample variance of the Sharpe ratios of all trials with enough returns; the
    job fails where fewer than two are left."""
    scale = 1.0 if annualization is None else float(annualization)
    stats = moments(df, by=[*by, *trial], net=net)
    short = F.raise_error(F.lit("need at least 2 trials with >= 30 observations each"))
    return stats.groupBy(*by).agg(
        F.count("*").alias("n_trials"),
        F.when(F.count("*") < 2, short.cast("double")).otherwise(F.var_samp("sr") * scale).alias("variance"),
    )
