"""Acceptance gates: many candidates against the accepted strategies at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from .correlations import pair_correlations
from .factors import concentration
from .significance import deflated_sharpe, moments


def survivor_correlations(candidates: DataFrame, survivors: DataFrame, *, series: str = "strategy_id",
                          ts: str = "ts", net: str = "net", min_bars: int = 30) -> DataFrame:
    """Correlation of each candidate with each survivor over common bars.

    The result has a row per (candidate, survivor); their moments are blocked matrix
    products over tiles of series, not rows per pair and bar.
    """
    pairs = pair_correlations(candidates, survivors, series=series, ts=ts, value=net).where("left_id <> right_id")
    out = pairs.filter((F.col("n") >= min_bars) & F.col("correlation").isNotNull())
    return out.select(
        F.col("left_id").alias("candidate_id"), F.col("right_id").alias("survivor_id"), F.col("n").alias("n_overlap_bars"),
        "correlation", F.abs("correlation").alias("abs_correlation"),
    )


def max_correlation(candidates: DataFrame, survivors: DataFrame, **kwargs) -> DataFrame:
    """Largest absolute correlation per candidate, zero without a comparable survivor."""
    series = kwargs.get("series", "strategy_id")
    best = survivor_correlations(candidates, survivors, **kwargs).groupBy("candidate_id").agg(
        F.max("abs_correlation").alias("m"),
        F.max_by("survivor_id", F.struct("abs_correlation", "survivor_id")).alias("most_correlated"),
    )
    ids = candidates.select(F.col(series).alias("candidate_id")).distinct()
    return ids.join(best, "candidate_id", "left").select(
        F.col("candidate_id").alias(series), F.coalesce("m", F.lit(0.0)).alias("max_correlation"), "most_correlated"
    )


def evaluate(candidates: DataFrame, critic: DataFrame, survivors: DataFrame, *, n_trials: int,
             annualization: float = 252, dsr_max: float = 0.05, corr_max: float = 0.60, pca_max: float = 0.50,
             series: str = "strategy_id") -> DataFrame:
    """All gates for all candidates; the first that fails names the rejection.

    `critic` has (series, critic_passes).  The component gate is computed for
    candidates that pass the cheaper ones only.
    """
    # every gate reads both tables
    candidates = checkpointed(candidates.select(series, "ts", "net"))
    survivors = checkpointed(survivors.select(series, "ts", "net"))
    ids = critic.select(series, "critic_passes")
    dsr = deflated_sharpe(
        moments(candidates, by=[series]), max(n_trials, 1), annualization=annualization
    ).select(series, "pvalue")
    corr = max_correlation(candidates, survivors, series=series).select(series, "max_correlation")
    base = ids.join(dsr, series, "left").join(corr, series, "left").withColumn(
        "max_correlation", F.coalesce("max_correlation", F.lit(0.0))
    )
    p, c = F.col("pvalue"), F.col("max_correlation")
    early = (
        F.when(~F.col("critic_passes"), "critic")
        .when(p.isNull(), "dsr_insufficient_data")
        .when(p >= dsr_max, F.concat(F.lit("deflated_sharpe_pvalue="), F.format_string("%.3f", p), F.lit(f">={dsr_max}")))
        .when(c >= corr_max, F.concat(F.lit("correlation="), F.format_string("%.2f", c), F.lit(f">={corr_max}")))
    )
    base = base.withColumn("_early", early)
    alive = candidates.join(base.filter("_early IS NULL").select(series), series, "left_semi")
    pca = concentration(alive, survivors, series=series, cut=False).withColumnRenamed("concentration", "pca_concentration")
    out = base.join(pca, series, "left")
    q = F.col("pca_concentration")
    late = F.when(q >= pca_max, F.concat(F.lit("pca_concentration="), F.format_string("%.2f", q), F.lit(f">={pca_max}")))
    reason = F.coalesce("_early", late)
    judged = F.col("critic_passes") & p.isNotNull()
    return out.select(
        series, reason.isNull().alias("passes"), reason.alias("rejection_reason"),
        F.when(F.col("critic_passes"), p).alias("pvalue"),
        F.when(judged & (p < dsr_max), c).alias("max_correlation"), "pca_concentration",
    )


def evaluate_fork(dsr: DataFrame, corr: DataFrame, pca: DataFrame, chance: DataFrame, *, dsr_max: float = 0.95,
                  corr_max: float = 0.60, pca_max: float = 0.50, series: str = "strategy_id") -> DataFrame:
    """Pass, warning or fail per gate from the stage tables, overall and first failure.

    dsr: (series, dsr_pvalue); corr: (series, max_correlation); pca: (series,
    n_assets, top_share); chance: (series, verdict of the permutation test).
    """
    verdict = lambda test: F.when(test, "pass").otherwise("fail")
    j = (
        dsr.select(series, "dsr_pvalue")
        .join(corr.select(series, "max_correlation"), series, "left")
        .join(pca.select(series, "n_assets", "top_share"), series, "left")
        .join(chance.select(series, F.col("verdict").alias("_tier_a")), series, "left")
    )
    gates = {
        "deflated_sharpe": verdict(F.coalesce(F.col("dsr_pvalue") < dsr_max, F.lit(False))),
        "correlation": verdict(F.coalesce("max_correlation", F.lit(0.0)) < corr_max),
        "pca_concentration": F.when(F.col("n_assets").isNull(), "fail").when(F.col("n_assets") <= 1, "pass").otherwise(
            verdict(F.coalesce("top_share", F.lit(0.0)) < pca_max)
        ),
        "vs_random": F.when(F.col("_tier_a").isNull(), "warning").when(F.col("_tier_a") == "pass", "pass")
        .when(F.col("_tier_a") == "borderline", "warning").otherwise("fail"),
    }
    out = j.withColumns({f"gate_{g}": v for g, v in gates.items()})
    failed = lambda g: F.col(f"gate_{g}") == "fail"
    first = F.coalesce(*[F.when(failed(g), g) for g in gates])
    warned = F.lit(False)
    for g in gates:
        warned = warned | (F.col(f"gate_{g}") == "warning")
    overall = F.when(first.isNotNull(), "fail").when(warned, "warning").otherwise("pass")
    return out.withColumns({"overall": overall, "first_failure": first}).drop("_tier_a")
