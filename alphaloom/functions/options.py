"""Features on option-volatility and dealer-positioning series."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.expr import ratio
from ..core.panel import Frame
from .base import Feature
from .timeseries import lagged_zscore, trailing_counts


def skew_zscore(value: str = "skew", lookback: int = 252) -> Feature:
    return lagged_zscore(value, lookback, lookback // 2)


def lagged_change(value: str = "skew", n: int = 5) -> Feature:
    """x[t-1] - x[t-1-n]."""
    return Feature(lambda f: f.lag(value, 1) - f.lag(value, 1 + n), needs=(value,), back=n + 1)


def lagged_spread(left: str, right: str) -> Feature:
    """left[t-1] - right[t-1]: implied less realised vol, front less back month."""
    return Feature(lambda f: f.lag(left, 1) - f.lag(right, 1), needs=(left, right), back=1)


def vrp_percentile(
    iv: str = "iv", rv: str = "rv", lookback: int = 252, min_valid: int = 120
) -> Feature:
    """Average-tie percentage rank of the lagged iv - rv in its trailing window."""

    def build(f: Frame) -> Column:
        diff = F.col(iv) - F.col(rv)
        seen = F.collect_list(diff).over(f.rows(-lookback, -1))
        last = f.lag(iv, 1) - f.lag(rv, 1)
        lt, eq, n = trailing_counts(seen, last)
        return F.when(
            last.isNotNull() & (n >= min_valid), ratio(lt + (eq + 1) / F.lit(2.0), n)
        )

    return Feature(build, needs=(iv, rv), back=lookback)


def gex_distance(spot: str = "spot", flip: str = "flip") -> Feature:
    """Lagged distance of spot from the gamma flip, as a share of spot."""
    return Feature(
        lambda f: ratio(f.lag(spot, 1) - f.lag(flip, 1), f.lag(spot, 1)),
        needs=(spot, flip),
        back=1,
    )


def dealer_alignment(gex: str = "gex") -> Feature:
    """+1 after a bar with net long gamma, else -1 (unknown counts as -1)."""
    return Feature(
        lambda f: F.when(F.coalesce(f.lag(gex, 1) > 0, F.lit(False)), 1.0).otherwise(-1.0),
        needs=(gex,),
        back=1,
    )


def pe_zscore(value: str = "pe", lookback: int = 252, min_valid: int = 120) -> Feature:
    return lagged_zscore(value, lookback, min_valid)


def pe_quadrant(pe_z: str = "pe_z", vix: str = "vix", threshold: float = 20.0) -> Feature:
    """T/B for the valuation z-score, L/R for the lagged vol index; unknown is low."""

    def build(f: Frame) -> Column:
        top = F.coalesce(F.col(pe_z) > 0, F.lit(False))
        right = F.coalesce(f.lag(vix, 1) > threshold, F.lit(False))
        return F.concat(
            F.when(top, "T").otherwise("B"), F.when(right, "R").otherwise("L")
        )

    return Feature(build, needs=(pe_z, vix), back=1)
