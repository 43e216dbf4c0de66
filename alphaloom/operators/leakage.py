"""Does a feature see the future?  Two audits and the pipeline that runs them."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.expr import correlation, ratio
from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..core.scan import numbered
from ..functions.base import Feature, add_features, require


class LeakageError(ValueError):
    """A feature correlates with, or changes with, bars it should not have seen."""


def correlation_audit(
    panel: Panel, features: list[str], target: str, *, future: int = 1, past: int = 1,
    threshold: float = 2.0, min_correlation: float = 0.05, suspicious: float = 0.20, min_pairs: int = 30,
) -> DataFrame:
    """Per key and feature: correlation with the past and the future target.

    All features travel as one long table: a row explodes to its features and each
    (key, feature) collapses to moments map-side.
    """
    frame = panel.frame(back=past, ahead=future)
    rows = frame.core(
        frame.df.withColumns({"_past": frame.lag(target, past), "_future": frame.lead(target, future)})
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = rows.select(*panel.keys, "_past", "_future", F.explode(pairs).alias("p")).select(
        *panel.keys, "_past", "_future", "p.*"
    )
    def strength(side: str):
        n = F.count(F.when(F.col("x").isNotNull(), F.col(side)))
        return F.when(n >= min_pairs, F.coalesce(F.abs(correlation("x", side)), F.lit(0.0))).otherwise(0.0)

    out = long.groupBy(*panel.keys, "feature").agg(
        F.count("x").alias("_seen"), strength("_past").alias("past_corr"), strength("_future").alias("future_corr")
    ).filter("_seen > 0").drop("_seen")
    strong = F.col("past_corr") >= min_correlation
    score = F.when(strong, ratio("future_corr", "past_corr")).otherwise(F.col("future_corr"))
    direct = F.col("future_corr") >= suspicious
    return out.withColumn("score", score).withColumns(
        {
            "leaky": direct | (strong & (F.col("score") >= threshold)),
            "reason": F.when(direct, "forward_reference").when(strong & (F.col("score") >= threshold), "future_over_past"),
        }
    )


def structural_audit(
    panel: Panel, features: dict[str, Feature], *, probes: int = 20, horizon: int = 10, tolerance: float = 1e-9
) -> DataFrame:
    """Share of probe bars at which a feature changes when later bars are removed.

    One job for all keys, features and probes: each key's rows are copied to the
    probes at or after them, features run per (key, probe), and the last row of
    each copy is compared with the value on the full history.
    """
    require(probes >= 1 and horizon >= 1, "probes and horizon must be >= 1")
    keys, names = list(panel.keys), list(features)
    base = panel.df.columns
    full = panel.with_df(add_features(panel, features))
    full_rows = checkpointed(numbered(full.frame(), "_rn").core())
    sizes = panel.df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(
        F.col("_rows") >= probes + horizon + 30
    ).select(*keys)

    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("full")) for n in names])
    long = full_rows.join(sizes, keys, "left_semi").select(
        *keys, "_rn", panel.ts, F.explode(pairs).alias("p")
    ).select(*keys, "_rn", panel.ts, "p.*").filter("full IS NOT NULL")
    by = keys + ["feature"]
    valid = numbered(Panel(long, keys=tuple(by), ts=panel.ts, grain=panel.grain,
                           segment_rows=panel.segment_rows).frame(), "_pos").core()
    counts = long.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2 * probes)
    n = F.col("_n")
    low = F.greatest(F.lit(30), F.floor(n / 3))
    high = n - horizon - 1
    step = (high - low) / F.lit(float(max(probes - 1, 1)))
    at = F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.struct(
            i.alias("probe"),
            F.when((i == probes - 1) & (i > 0), high).otherwise(F.floor(i * step + low)).cast("bigint").alias("_pos")))
    )
    wanted = counts.select(*by, at.alias("a")).select(*by, "a.*")
    chosen = valid.join(wanted, by + ["_pos"]).select(*by, "probe", F.col("_rn").alias("_end"), "full")

    # every probe of a key as (feature, probe, end) beside the key's rows: bounded by
    # features x probes
    ends = chosen.groupBy(*keys).agg(F.collect_set(F.struct("feature", "probe", "_end")).alias("_ends"))
    copies = (
        full_rows.select(*base, "_rn")
        .join(ends, keys)
        .withColumn("_e", F.explode(F.filter("_ends", lambda e: e["_end"] >= F.col("_rn"))))
        .select(*base, "_rn", F.col("_e.feature").alias("_feature"), F.col("_e.probe").alias("_probe"), F.col("_e._end").alias("_end"))
    )
    cut = Panel(copies, keys=tuple(keys) + ("_feature", "_probe"), ts=panel.ts, grain=panel.grain,
                segment_rows=panel.segment_rows)
    again = add_features(cut, features).filter(F.col("_rn") == F.col("_end"))
    value = F.coalesce(*[F.when(F.col("_feature") == n_, F.col(n_)) for n_ in names])
    again = again.select(*keys, F.col("_feature").alias("feature"), F.col("_probe").alias("probe"), value.alias("cut"))
    both = chosen.join(again, by + ["probe"], "left")
    diff = F.abs(F.col("full") - F.col("cut"))
    bad = F.col("cut").isNull() | (diff > tolerance)
    return both.groupBy(*by).agg(
        F.sum(bad.cast("bigint")).alias("n_disagree"),
        (F.sum(bad.cast("bigint")) / F.lit(float(probes))).alias("score"),
        F.coalesce(F.max(F.when(diff > tolerance, diff)), F.lit(0.0)).alias("max_diff"),
    ).withColumn("leaky", F.col("n_disagree") > 0)


def summary(audit: DataFrame, by: list[str]) -> DataFrame:
    """One line per key: how many features are suspect."""
    bad, n = F.sum(F.col("leaky").cast("bigint")), F.count("*")
    return audit.groupBy(*by).agg(
        F.when(bad == 0, F.concat(F.lit("OK: "), n.cast("string"), F.lit(" features, no leakage detected.")))
        .otherwise(F.concat(F.lit("LEAKAGE: "), bad.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" features suspect.")))
        .alias("summary")
    )


@dataclass(frozen=True)
class FeaturePipeline:
    """Ordered named features over one panel, with optional audits."""

    steps: tuple[tuple[str, Feature], ...]

    def __post_init__(self):
        require(len(self.steps) > 0, "a pipeline needs at least one step")
        names = [n for n, _ in self.steps]
        require(len(set(names)) == len(names), "duplicate feature names")

    def transform(self, panel: Panel) -> DataFrame:
        """All features in one pass: windows of one partition share one sort."""
        return add_features(panel, dict(self.steps))

    def fit_transform(self, panel: Panel, target: str | None = None, *, structural: bool = False) -> DataFrame:
        """Features, after the audits; raises LeakageError naming the suspects."""
        out = self.transform(panel)
        names = [n for n, _ in self.steps]
        bad = []
        if target is not None:
            audit = correlation_audit(panel.with_df(out), names, target)
            bad += [r["feature"] for r in audit.filter("leaky").select("feature").distinct().collect()]
        if structural:
            audit = structural_audit(panel, dict(self.steps))
            bad += [r["feature"] for r in audit.filter("leaky").select("feature").distinct().collect()]
        if bad:
            raise LeakageError(f"leakage suspected in {sorted(set(bad))}")
        return out
