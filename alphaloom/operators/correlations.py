"""Moments of every pair of two sets of series by blocked matrix products.

Series are dealt into tiles and bars into blocks; a task gets one tile of either side over one
block of bars as dense matrices of returns and of presence, and six products give all
pairwise-complete moments of the tile's pairs at once.  A row is sent once for each tile of the
other side, so the shuffle grows with series x bars; no row is made per pair and bar.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..core.lineage import written

TILE, BARS = 256, 2048  # series and bars of a task's matrices, about
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
CONSTANT = 1e-13  # a variance below this share of the sum of squares is rounding


def _matrix(f: pd.DataFrame, bars: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    at, names = pd.factorize(f["_s"].to_numpy(dtype=object))
    out = np.full((len(bars), len(names)), np.nan)
    out[bars.get_indexer(pd.Index(f["_t"].to_numpy(dtype=object))), at] = f["_v"].to_numpy(dtype=float)
    return names, out


def pair_moments(left: DataFrame, right: DataFrame, *, series: str = "strategy_id", ts: str = "ts", value: str = "net",
                 tile: int = TILE, bars: int = BARS) -> DataFrame:
    """(left_id, right_id, n, sx, sy, sxx, syy, sxy) over the bars where both have a value, for all pairs that
    share one.  A series has one row per bar; of repeated rows one counts.  NULL series and times take no part."""
    sides = []
    for df in (left, right):
        known = df.select(F.col(series).alias("_s"), F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v")).dropna()
        known = written(known, "series")  # counted and sent from one evaluation
        size = known.agg(F.approx_count_distinct("_s"), F.approx_count_distinct("_t")).first()
        sides.append((known, max(1, math.ceil(size[0] / tile)), size[1]))
    (x, n_x, t_x), (y, n_y, t_y) = sides
    blocks = max(1, math.ceil(max(t_x, t_y) / bars))
    block = F.pmod(F.xxhash64("_t"), F.lit(blocks)).alias("_b")
    own = lambda n: F.pmod(F.xxhash64("_s"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select("*", own(n_x).cast("int").alias("_i"), every(n_y).alias("_j"), block)
    y = y.select("*", every(n_x).alias("_i"), own(n_y).cast("int").alias("_j"), block)

    schema = T.StructType([
        T.StructField("left_id", left.schema[series].dataType), T.StructField("right_id", right.schema[series].dataType),
        T.StructField("n", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in MOMENTS[1:]],
    ])
    arrow = to_arrow_schema(schema)

    def products(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        a, b = left_rows.to_pandas(), right_rows.to_pandas()
        times = lambda f: pd.Index(f["_t"].to_numpy(dtype=object))
        shared = times(a).intersection(times(b)).unique()
        if len(shared) == 0:
            return arrow.empty_table()
        a, b = a[times(a).isin(shared)], b[times(b).isin(shared)]
        (p, u), (q, v) = _matrix(a, shared), _matrix(b, shared)
        has_u, has_v = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
        u, v = np.nan_to_num(u), np.nan_to_num(v)
        made = (has_u.T @ has_v, u.T @ has_v, has_u.T @ v, (u * u).T @ has_v, has_u.T @ (v * v), u.T @ v)
        i, j = np.nonzero(made[0])
        columns = [p[i].tolist(), q[j].tolist(), made[0][i, j].astype(np.int64), *[m[i, j] for m in made[1:]]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    key = ["_i", "_j", "_b"]
    made = x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(products, schema)
    if blocks == 1:
        return made
    return made.groupBy("left_id", "right_id").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def pair_correlations(left: DataFrame, right: DataFrame, **kwargs) -> DataFrame:
    """(left_id, right_id, n, correlation); NULL for a side that is constant over the common bars."""
    m = pair_moments(left, right, **kwargs)
    n = F.col("n")
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / n
    varies = lambda s, q: spread(s, q) > CONSTANT * F.col(q)
    both = F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy"))
    corr = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / both
    return m.select(
        "left_id", "right_id", "n", F.when((n > 1) & varies("sx", "sxx") & varies("sy", "syy"), corr).alias("correlation")
    )
