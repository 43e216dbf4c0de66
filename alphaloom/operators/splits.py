"""Walk-forward and purged cross-validation folds over numbered rows.

Which folds a row belongs to follows from its number, so rows explode to their
folds directly; no row table is range-joined to a fold table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core.expr import col, join_groups, ratio
from ..core.panel import Panel
from ..core.scan import numbered
from .backtest import BacktestConfig, run_positions


def counted(panel: Panel) -> DataFrame:
    """Rows numbered along time per key (rn, from zero) with the key's count n."""
    frame = numbered(panel.frame())
    if not frame.segmented:  # the count shares the partition of the numbering
        n = F.count("*").over(Window.partitionBy(*panel.keys))
        return frame.df.withColumn("n", n)
    rows = frame.core()
    sizes = panel.df.groupBy(*panel.keys).agg(F.count("*").alias("n"))
    return join_groups(rows, sizes, list(panel.keys))


def _n_folds(n: Column, train: int, test: int, purge: int) -> Column:
    return F.greatest(F.floor((n - train - purge) / test), F.lit(0)).cast("bigint")


def walk_forward_folds(
    counts: DataFrame, *, n: str = "n", train_size: int, test_size: int, purge: int = 0,
    mode: str = "rolling", strict: bool = True,
) -> DataFrame:
    """Fold bounds for each row of a table of series lengths."""
    if train_size < 1 or test_size < 1 or purge < 0:
        raise ValueError("sizes must be >= 1 and purge >= 0")
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"unknown mode {mode!r}")
    k = _n_folds(F.col(n), train_size, test_size, purge)
    if strict:
        k = F.when(
            F.col(n) < train_size + purge + test_size,
            F.raise_error(F.lit("train_size + purge + test_size exceeds the series length")),
        ).otherwise(k)
    fold = F.explode(F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)))
    out = counts.withColumn("fold", fold)
    start = F.col("fold") * test_size
    return out.withColumns(
        {
            "train_start": start if mode == "rolling" else F.lit(0).cast("bigint"),
            "train_end": start + train_size,
            "test_start": start + train_size + purge,
            "test_end": start + train_size + purge + test_size,
        }
    )


def walk_forward_rows(
    rows: DataFrame, *, train_size: int, test_size: int, purge: int = 0, mode: str = "rolling"
) -> DataFrame:
    """Rows (with rn and n) in every fold whose span from train start to test end
    holds them; `is_test` marks the test slice."""
    rn, k = F.col("rn"), _n_folds(F.col("n"), train_size, test_size, purge)
    span = train_size + purge + test_size
    first = F.greatest(F.ceil((rn - span + 1) / test_size), F.lit(0)).cast("bigint")
    last = F.least(F.floor(rn / test_size), k - 1) if mode == "rolling" else k - 1
    folds = F.when(first <= last, F.sequence(first, last.cast("bigint")))
    out = rows.withColumn("fold", F.explode(folds))
    at = F.col("rn") - F.col("fold") * test_size
    return out.withColumn("is_test", at >= train_size + purge)


def walk_forward_evaluate(
    panel: Panel, strategy: Callable[[Panel], DataFrame], *, train_size: int, test_size: int,
    purge: int = 0, mode: str = "rolling", config: BacktestConfig = BacktestConfig(),
    ret: str = "ret",
) -> Panel:
    """Net returns of the test slices, keyed by (keys, fold).

    `strategy` gets every fold's own history as a panel keyed by (keys, fold) and
    adds `position`; its windows cannot see beyond the fold.  Only the test slice
    is traded, so the execution lag starts afresh there.  `ret` must come from the
    whole series.
    """
    folds = walk_forward_rows(
        counted(panel), train_size=train_size, test_size=test_size, purge=purge, mode=mode
    )
    inside = panel.with_df(folds, keys=panel.keys + ("fold",))
    test = inside.with_df(
        strategy(inside)
        .filter("is_test")
        .withColumn(ret, F.coalesce(F.col(ret), F.lit(0.0)))
        .withColumn("position", F.coalesce("position", F.lit(0.0)))
    )
    return run_positions(test, config, ret=ret)


def array_split_fold(rn: str | Column, n: str | Column, k: int) -> Column:
    """Fold of a row when n rows split into k runs, the first n mod k one longer."""
    rn, n = col(rn), col(n)
    q = F.floor(n / k)
    r = n - q * k
    head = r * (q + 1)
    short = F.floor(ratio(rn - head, q))
    return F.when(rn < head, F.floor(rn / (q + 1))).otherwise(r + short).cast("bigint")


def boundary(k: Column, n: Column, parts: int) -> Column:
    """Start of part k: k steps of n / parts, truncated, in floating point like a
    linear grid (so that exact multiples round the same way)."""
    at = F.floor(k.cast("double") * (n / F.lit(float(parts)))).cast("bigint")
    return F.when(k >= parts, n.cast("bigint")).otherwise(at)


def _role(rn: Column, spans: Column, purge: int, embargo: int) -> Column:
    test = F.exists(spans, lambda s: (rn >= s["lo"]) & (rn < s["hi"]))
    drop = F.exists(spans, lambda s: (rn >= s["lo"] - purge) & (rn < s["hi"] + embargo))
    return F.when(test, "test").when(~drop, "train")


def purged_kfold(rows: DataFrame, *, n_splits: int = 5, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(row columns, fold, role): one contiguous test block per fold; rows within
    `purge` before it or `embargo` after it belong to neither side."""
    if n_splits < 2 or purge < 0 or embargo < 0:
        raise ValueError("n_splits must be >= 2, purge and embargo >= 0")
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    f, n = F.col("fold"), F.col("n")
    span = F.array(
        F.struct(boundary(f, n, n_splits).alias("lo"), boundary(f + 1, n, n_splits).alias("hi"))
    )
    return out.withColumn("role", _role(F.col("rn"), span, purge, embargo)).filter("role IS NOT NULL")


def combinations(spark: SparkSession, n_groups: int, n_test_groups: int) -> DataFrame:
    """(fold, groups): all choices of test groups in lexicographic order.  The size
    is C(n_groups, n_test_groups), a matter of parameters, not of data."""
    if n_groups < 2 or n_test_groups >= n_groups:
        raise ValueError("need n_groups >= 2 and n_test_groups < n_groups")
    out = spark.range(1).select(F.array().cast("array<int>").alias("groups"))
    for i in range(n_test_groups):
        after = F.coalesce(F.try_element_at("groups", F.lit(-1)), F.lit(-1)) + 1
        last = F.lit(n_groups - n_test_groups + i)
        out = out.select(
            "groups", F.explode(F.when(after <= last, F.sequence(after, last))).alias("g")
        ).select(F.concat("groups", F.array("g")).alias("groups"))
    return out.select(
        (F.row_number().over(Window.orderBy("groups")) - 1).alias("fold"), "groups"
    )


def combinatorial_purged(
    rows: DataFrame, *, n_groups: int = 10, n_test_groups: int = 2, purge: int = 0, embargo: int = 0
) -> DataFrame:
    """Roles of every row in every combination of test groups."""
    combos = combinations(rows.sparkSession, n_groups, n_test_groups)
    n_folds = 1
    for i in range(n_test_groups):
        n_folds = n_folds * (n_groups - i) // (i + 1)
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).join(combos, "fold")
    n = F.col("n")
    spans = F.transform(
        "groups",
        lambda g: F.struct(
            boundary(g, n, n_groups).alias("lo"), boundary(g + 1, n, n_groups).alias("hi")
        ),
    )
    return (
        out.withColumn("role", _role(F.col("rn"), spans, purge, embargo))
        .filter("role IS NOT NULL")
        .drop("groups")
    )


def oos_sharpe(
    rows: DataFrame, *, by: list[str], net: str = "net", n_groups: int = 10, n_test_groups: int = 2,
    annualization: float = 252,
) -> DataFrame:
    """Out-of-sample Sharpe of every combination of test groups.

    Rows collapse to moments per (series, group) first; only those few rows meet
    the combinations.
    """
    edges = F.filter(
        F.sequence(F.lit(1), F.lit(n_groups - 1)),
        lambda g: boundary(g, F.col("n"), n_groups) <= F.col("rn"),
    )
    x = F.col(net)
    moments = rows.withColumn("g", F.size(edges)).groupBy(*by, "g").agg(
        F.count(x).alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q")
    )
    combos = combinations(rows.sparkSession, n_groups, n_test_groups).withColumn(
        "g", F.explode("groups")
    ).drop("groups")
    out = moments.join(combos, "g").groupBy(*by, "fold").agg(
        F.sum("c").alias("n_obs"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    mean = ratio("s", "n_obs")
    var = ratio(F.col("q") - F.col("s") * mean, F.col("n_obs") - 1)
    sr = ratio(mean, F.when(var > 0, F.sqrt(var))) * F.sqrt(F.lit(float(annualization)))
    return out.select(*by, "fold", "n_obs", F.coalesce(sr, F.lit(0.0)).alias("sharpe"))
