"""Common drivers of many strategies: components, concentration, attribution."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.expr import correlation, ratio
from ..core.lineage import checkpointed

MAX_SERIES = 4096  # columns of a component model: its k x k matrix sits on the driver


def series_index(df: DataFrame, series: str = "strategy_id", limit: int = MAX_SERIES) -> list[str]:
    """Names of the series in order.  A component model is k x k, so the number of
    series is checked here and a longer list is refused, not cut."""
    names = [r[0] for r in df.select(series).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} series in one component model")
    return sorted(names)


def bar_vectors(df: DataFrame, names: list[str], *, series: str = "strategy_id", ts: str = "ts",
                net: str = "net", fill: float | None = None) -> DataFrame:
    """One vector of all series per bar, of at most MAX_SERIES numbers.  Bars that
    miss a series are dropped, or filled when `fill` is given."""
    cells = F.map_from_entries(F.collect_list(F.struct(series, net)))
    rows = df.filter(F.col(net).isNotNull()).groupBy(ts).agg(cells.alias("m"))
    order = F.array(*[F.lit(n) for n in names])
    if fill is None:
        rows = rows.filter(F.size("m") == len(names))
        pick = lambda n: F.element_at("m", n)
    else:
        pick = lambda n: F.coalesce(F.try_element_at("m", n), F.lit(float(fill)))
    return rows.select(ts, F.transform(order, pick).alias("x")).withColumn("features", array_to_vector("x"))


def covariance(df: DataFrame, *, series: str = "strategy_id", ts: str = "ts", net: str = "net") -> DataFrame:
    """Sample covariance of every pair of series over complete bars, long form.

    Pairs are made inside one bar's vector of bounded length.
    """
    df = checkpointed(df.select(series, ts, net))
    names = series_index(df, series)
    rows = bar_vectors(df, names, series=series, ts=ts, net=net)
    stats = rows.select(F.posexplode("x").alias("i", "v"), "x")
    pairs = stats.select("i", "v", F.posexplode("x").alias("j", "u")).filter("i <= j")
    cov = pairs.groupBy("i", "j").agg(F.covar_samp("v", "u").alias("cov"))
    label = F.array(*[F.lit(n) for n in names])
    return cov.select(
        F.element_at(label, F.col("i") + 1).alias("series_a"),
        F.element_at(label, F.col("j") + 1).alias("series_b"),
        "cov",
    )


def principal_components(df: DataFrame, *, series: str = "strategy_id", ts: str = "ts",
                         net: str = "net", min_bars: int = 30) -> tuple[list[str], object]:
    """Series names and the fitted component model over complete bars.

    The matrix is read several times, so it is checkpointed once.
    """
    df = checkpointed(df.select(series, ts, net))
    names = series_index(df, series)
    if len(names) < 2:
        raise ValueError("need at least 2 series")
    rows = bar_vectors(df, names, series=series, ts=ts, net=net).select("features")
    if len(rows.take(min_bars)) < min_bars:
        raise ValueError(f"need at least {min_bars} aligned observations")
    model = PCA(k=len(names), inputCol="features", outputCol="pcs").fit(rows)
    return names, model


def pca_table(df: DataFrame, **kwargs) -> DataFrame:
    """(series, loading of the first component, component, explained share)."""
    names, model = principal_components(df, **kwargs)
    spark = df.sparkSession
    pc = model.pc.toArray()
    rows = [
        (n, i, float(pc[i, 0]), float(model.explainedVariance[i])) for i, n in enumerate(names)
    ]
    return spark.createDataFrame(
        rows, "strategy_id string, component int, pc1_loading double, explained_share double"
    )


def concentration(candidates: DataFrame, survivors: DataFrame, *, series: str = "strategy_id",
                  ts: str = "ts", net: str = "net", min_bars: int = 60, cut: bool = True) -> DataFrame:
    """Share of each candidate's variance along the survivors' first component over
    the bars both have.

    Zero with fewer than two survivors, fewer than `min_bars` common bars or a
    constant series.  The k x k covariance of the survivors is made once for every
    distinct set of bars among the candidates, not once per candidate; a candidate
    then needs its k covariances with the survivors only.  Both tables are read several
    times, so they are checkpointed unless `cut` says that they are cheap to read.
    """
    if cut:
        candidates = checkpointed(candidates.select(series, ts, net))
        survivors = checkpointed(survivors.select(series, ts, net))
    names = series_index(survivors, series)
    ids = candidates.select(series).distinct()
    if len(names) < 2:
        return ids.withColumn("concentration", F.lit(0.0))
    vectors = bar_vectors(survivors, names, series=series, ts=ts, net=net).select(ts, "x")
    seen = F.xxhash64(ts)
    rows = candidates.filter(F.col(net).isNotNull()).join(vectors, ts)
    marks = rows.groupBy(series).agg(
        F.count("*").alias("n"), F.var_samp(net).alias("_var"),
        F.concat_ws("|", F.count("*"), F.bit_xor(seen), F.min(ts), F.max(ts)).alias("_bars"),
    ).filter(F.col("n") >= min_bars)
    chosen = marks.groupBy("_bars").agg(F.min(series).alias(series))
    left = rows.join(chosen, series).select("_bars", F.posexplode("x").alias("i", "v"), "x")
    cov = (
        left.select("_bars", "i", "v", F.posexplode("x").alias("j", "u"))
        .filter("i <= j")
        .groupBy("_bars", "i", "j")
        .agg(F.covar_samp("v", "u").alias("c"))
    )

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["j"].max()) + 1
        mat = np.zeros((k, k))
        i, j = pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)
        mat[i, j] = mat[j, i] = pdf["c"].to_numpy(float)
        values, vectors_ = np.linalg.eigh(mat)
        return pd.DataFrame(
            {"_bars": pdf["_bars"].iloc[0], "i": np.arange(k), "w": vectors_[:, -1], "lam": values[-1]}
        )

    axis = cov.groupBy("_bars").applyInPandas(leading, "_bars string, i int, w double, lam double")
    cross = rows.select(series, net, F.posexplode("x").alias("i", "v")).groupBy(series, "i").agg(
        F.covar_samp("v", net).alias("c")
    )
    r2 = (
        cross.join(marks, series)
        .join(axis, ["_bars", "i"])
        .groupBy(series)
        .agg(F.sum(F.col("c") * F.col("w")).alias("s"), F.first("_var").alias("v"), F.first("lam").alias("lam"))
        .select(series, ratio(F.col("s") * F.col("s"), F.col("v") * F.col("lam")).alias("r2"))
    )
    return ids.join(r2, series, "left").select(
        series, F.coalesce("r2", F.lit(0.0)).alias("concentration")
    )


def position_concentration(positions: DataFrame, *, by: list[str], asset: str = "asset", ts: str = "ts",
                           position: str = "position") -> DataFrame:
    """Per thesis: variance share of the first component of its position columns,
    NULL for a single asset.

    The covariance is a k x k table per thesis from one grouped pass; the
    eigenvalues of each come from a small numpy call on executors.  A thesis of more
    than MAX_SERIES assets is refused, not cut.
    """
    too_many = F.raise_error(F.lit(f"more than {MAX_SERIES} assets in one component model"))
    bars = positions.groupBy(*by, ts).agg(
        F.map_from_entries(F.collect_list(F.struct(asset, F.coalesce(position, F.lit(0.0))))).alias("m")
    )
    assets = positions.select(*by, asset).distinct()
    sizes = assets.groupBy(*by).agg(F.count("*").alias("_k"))
    ok = F.when(F.col("_k") > MAX_SERIES, too_many.cast("boolean")).otherwise(F.lit(True))
    names = assets.join(sizes.filter(ok), by).groupBy(*by).agg(
        F.array_sort(F.collect_list(asset)).alias("names")
    )
    rows = bars.join(names, by).select(
        *by, F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0))).alias("x")
    )
    left = rows.select(*by, F.size("x").alias("k"), F.posexplode("x").alias("i", "v"), "x")
    cov = (
        left.select(*by, "k", "i", "v", F.posexplode("x").alias("j", "u"))
        .filter("i <= j")
        .groupBy(*by, "k", "i", "j")
        .agg(F.covar_samp("v", "u").alias("c"))
    )
    schema = ", ".join(f"`{c}` {positions.schema[c].dataType.simpleString()}" for c in by)

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        mat = np.zeros((k, k))
        i, j = pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)
        mat[i, j] = mat[j, i] = pdf["c"].to_numpy(float)
        eig = np.linalg.eigvalsh(mat)
        eig = eig[eig > 0]
        share = float(eig.max() / eig.sum()) if len(eig) else 0.0
        return pdf[by].head(1).assign(n_assets=k, top_share=np.nan if k == 1 else share)

    out = cov.groupBy(*by).applyInPandas(top, f"{schema}, n_assets bigint, top_share double")
    return out.withColumn("top_share", F.when(F.col("n_assets") > 1, F.col("top_share")))


def attribution(df: DataFrame, factors: list[str], *, by: list[str], y: str = "net",
                annualization: float = 252, min_bars: int = 60) -> DataFrame:
    """Ordinary least squares of returns on factor columns, per series.

    One grouped pass sums the cross products (a handful of columns per series);
    the small normal equations are then solved on executors, a batch at a time.
    """
    ok = F.col(y).isNotNull()
    for f in factors:
        ok = ok & F.col(f).isNotNull()
    rows = df.filter(ok)
    terms = ["_one", *factors]
    rows = rows.withColumn("_one", F.lit(1.0))
    k = len(terms)
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.var_pop(y).alias("vy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    sums += [
        F.sum(F.col(terms[i]) * F.col(terms[j])).alias(f"x{i}_{j}")
        for i in range(k) for j in range(i, k)
    ]
    sums += [F.sum(F.col(terms[i]) * F.col(y)).alias(f"y{i}") for i in range(k)]
    moments = rows.groupBy(*by).agg(*sums).filter(F.col("n") >= min_bars)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    coefs = "".join(f", beta_{f} double, t_{f} double" for f in factors)
    schema = f"{keys}, n_observations bigint, alpha double, t_alpha double{coefs}, r_squared double"

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                gram = np.array(
                    [[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
                )
                xy = np.array([r[f"y{i}"] for i in range(k)])
                inv = np.linalg.pinv(gram)
                beta = inv @ xy
                n = r["n"]
                sse = max(r["syy"] - 2 * beta @ xy + beta @ gram @ beta, 0.0)
                sst = r["vy"] * n
                se = np.sqrt(np.maximum(np.diag(inv) * sse / max(n - k, 1), 0.0))
                t = [float(b / s) if s > 0 else None for b, s in zip(beta, se)]
                row = {c: r[c] for c in by} | {"n_observations": n, "alpha": beta[0], "t_alpha": t[0]}
                for i, f in enumerate(factors, start=1):
                    row |= {f"beta_{f}": beta[i], f"t_{f}": t[i]}
                out.append(row | {"r_squared": 1 - sse / sst if sst > 0 else 0.0})
            names = [*by, "n_observations", "alpha", "t_alpha"]
            names += [c for f in factors for c in (f"beta_{f}", f"t_{f}")] + ["r_squared"]
            yield pd.DataFrame(out, columns=names)

    res = moments.mapInPandas(solve, schema)
    return res.withColumn("annualized_alpha", F.col("alpha") * annualization)


def single_factor(df: DataFrame, factor: str, *, by: list[str], y: str = "net") -> DataFrame:
    """One-factor regression by moments alone."""
    both = F.col(y).isNotNull() & F.col(factor).isNotNull()
    yy, xx = F.when(both, F.col(y)), F.when(both, F.col(factor))
    beta = ratio(F.covar_samp(yy, xx), F.var_samp(xx))
    return df.groupBy(*by).agg(
        F.count(yy).alias("n_observations"),
        beta.alias("beta"),
        (F.avg(yy) - beta * F.avg(xx)).alias("alpha"),
        F.pow(correlation(y, factor), 2).alias("r_squared"),
    )
