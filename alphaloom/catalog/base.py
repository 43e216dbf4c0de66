"""Registry of named queries with the SQL that checks them.

Both sides of a check end in the same projection: key columns as they are,
counts as BIGINT, flags as BOOLEAN and floating-point results at eight
significant digits, because two engines add up in different orders. Small results keep
their digits: only what lies under `TINY`, where sums that cancel leave rounding alone, is zero.
`Query.exact` gives the result as the library computes it, unrounded.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Moves exact halves off the rounding boundary, where engines round differently.
OFF_TIES = 1.000000000003
TINY = 1e-12

REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    exact: Callable[[SparkSession, str], DataFrame]


def sig(c: str):
    """Eight significant digits; anything below TINY is zero."""
    x = F.col(c).cast("double")
    short = F.when(F.abs(x) < TINY, F.lit(0.0)).otherwise(
        F.format_string("%.7e", x * OFF_TIES).cast("double")
    )
    return F.when(x.isNotNull(), short).alias(c)


def sig_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN abs({c}) < {TINY!r} THEN 0.0 "
        f"ELSE CAST(printf('%.7e', CAST({c} AS DOUBLE) * {OFF_TIES!r}) AS DOUBLE) END AS {c}"
    )


def query(name: str, *, keys: str = "", ints: str = "", bools: str = "", nums: str = "",
          sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its check."""
    k, i, b, n = keys.split(), ints.split(), bools.split(), nums.split()

    def wrap(fn):
        def exact(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, folder).select(
                *k,
                *[F.col(c).cast("bigint").alias(c) for c in i],
                *[F.col(c).cast("boolean").alias(c) for c in b],
                *n,
            )

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = exact(spark, folder)
            return df.select(*k, *i, *b, *[sig(c) for c in n])

        text = None
        if sql is not None:
            cols = (
                [f"{c} AS {c}" for c in k]
                + [f"CAST({c} AS BIGINT) AS {c}" for c in i]
                + [f"CAST({c} AS BOOLEAN) AS {c}" for c in b]
                + [sig_sql(c) for c in n]
            )
            text = f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS result"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, text, exact)
        return fn

    return wrap

