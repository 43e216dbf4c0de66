"""Normal distribution as column arithmetic, so p-values stay in the JVM."""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# Hart's rational approximation of the upper tail (double precision)
# and Acklam's rational approximation of the inverse (1e-9, refined below).
TAIL_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CENTRE_NUM = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRE_DEN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
EDGE_NUM = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
EDGE_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00, 1.0)
EULER_GAMMA = 0.5772156649015329


def _poly(coefs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def _let(value: Column, body) -> Column:
    """Bind a value once; plain reuse of a long expression would copy it everywhere."""
    return F.transform(F.array(value), body)[0]


def normal_cdf(x: str | Column) -> Column:
    return _let(col(x).cast("double"), _cdf)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _poly(TAIL_NUM, a) / _poly(TAIL_DEN, a)
    chain = a + 0.65
    for k in (4, 3, 2, 1):
        chain = a + k / chain
    tail = F.when(a < 7.07106781186547, near).otherwise(bell / chain / math.sqrt(2 * math.pi))
    tail = F.when(a > 37, 0.0).otherwise(tail)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_ppf(p: str | Column) -> Column:
    """Inverse CDF on (0, 1), NULL outside; one Newton step on the approximation."""
    p = col(p).cast("double")
    return _let(F.when((p > 0) & (p < 1), p), _ppf)


def _ppf(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    centre = _poly(CENTRE_NUM, r) * q / _poly(CENTRE_DEN, r)
    edge_p = F.least(p, 1 - p)
    tail = _let(F.sqrt(-2 * F.ln(edge_p)), lambda t: _poly(EDGE_NUM, t) / _poly(EDGE_DEN, t))
    rough = F.when(edge_p >= 0.02425, centre).otherwise(F.when(q < 0, tail).otherwise(-tail))
    bell = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return _let(rough, lambda x: x - (_cdf(x) - p) / bell(x))


def expected_max_normal(n: int | str | Column) -> Column:
    """Expected maximum of n independent standard normals; zero for n <= 1.

    A trial count known when the plan is made becomes a literal.
    """
    if isinstance(n, int):
        if n <= 1:
            return F.lit(0.0)
        ppf = NormalDist().inv_cdf
        a, b = ppf(1 - 1 / n), ppf(1 - 1 / (n * math.e))
        return F.lit((1 - EULER_GAMMA) * a + EULER_GAMMA * b)
    n = F.greatest(col(n).cast("double"), F.lit(1.0))
    a = normal_ppf(1 - 1 / n)
    b = normal_ppf(1 - 1 / (n * math.e))
    return F.when(n > 1, (1 - EULER_GAMMA) * a + EULER_GAMMA * b).otherwise(0.0)
