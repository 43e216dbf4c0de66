"""Column expressions with the NULL rules of the library.

NULL is the only missing value.  A ratio with a zero denominator is NULL, never
an error and never infinity; a statistic with too few rows is NULL.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, as grouping has it; the left keys stay."""
    names = {k: f"_of_{k}" for k in keys}
    on = F.lit(True)
    for k, other in names.items():
        on = on & F.col(k).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where den is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def log_ratio(num: str | Column, den: str | Column) -> Column:
    """ln(num / den), NULL where the ratio is undefined or not positive."""
    r = ratio(num, den)
    return F.when(r > 0, F.ln(r))


def clip(c: str | Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def full_frame(agg: Column, value: str | Column, w: WindowSpec, rows: int) -> Column:
    """Window aggregate that is NULL unless the frame holds `rows` non-NULL values."""
    return valid_frame(agg, value, w, rows)


def valid_frame(agg: Column, value: str | Column, w: WindowSpec, at_least: int) -> Column:
    """Window aggregate that is NULL below `at_least` non-NULL values in the frame."""
    return F.when(F.count(col(value)).over(w) >= at_least, agg.over(w))


def sharpe(mean: Column, std: Column, annualization: float) -> Column:
    """mean / std, annualised; zero when the deviation is zero or undefined."""
    return F.coalesce(ratio(mean, std) * F.lit(math.sqrt(annualization)), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate over complete pairs; NULL for a constant side.

    `corr` raises under ANSI for a constant side, so it is put together from
    moments.  All three moments come from one pass with map-side partials.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_samp(F.when(both, x))
    sy = F.stddev_samp(F.when(both, y))
    return ratio(F.covar_samp(x, y), sx * sy)


def bias_corrected_skew(n: Column, pop_skew: Column) -> Column:
    """Adjusted Fisher-Pearson skewness from the population one (n > 2)."""
    n = n.cast("double")
    return F.when(n > 2, pop_skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def bias_corrected_kurtosis(n: Column, pop_excess: Column) -> Column:
    """Sample excess kurtosis from the population excess kurtosis (n > 3)."""
    n = n.cast("double")
    den = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, (n - 1) / den * ((n + 1) * pop_excess + 6))
