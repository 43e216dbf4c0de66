"""Append-only trial ledger: events in, the current trial table out.

Plain files have no UPDATE, so every action is an appended event (record, override,
deploy, seed) and the trial table is what replaying them gives.  The replay is
running sums and last values along each hypothesis' events, one pass for all.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.expr import join_groups
from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..core.ranks import tally
from ..core.scan import cumulative
from ..core.schema import struct

EVENT_SCHEMA = struct(
    "seq bigint, hypothesis_id string, kind string, hypothesis_text string, rationale string, "
    "code string, metrics_json string, accepted boolean, rejection_reason string, "
    "returns_json string, market_type string, size_multiplier double, status string, "
    "failure string, reason string, created_at timestamp"
)
STATUSES = ("paper", "live", "retired", "archived")


def _complete(df: DataFrame) -> DataFrame:
    """All event columns, NULL where a kind of event has none."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA
        ]
    )


def record_events(trials: DataFrame) -> DataFrame:
    return _complete(trials.withColumn("kind", F.lit("record")))


def override_events(overrides: DataFrame) -> DataFrame:
    return _complete(overrides.withColumn("kind", F.lit("override")))


def deploy_events(deployments: DataFrame) -> DataFrame:
    ok = F.col("status").isin(*STATUSES)
    bad = F.raise_error(F.lit("invalid deployment status")).cast("string")
    return _complete(
        deployments.withColumn("kind", F.lit("deploy")).withColumn(
            "status", F.when(ok, F.col("status")).otherwise(bad)
        )
    )


def seed_events(spark: SparkSession, count: int, *, after: int = 0, note: str = "pre_system_seed") -> DataFrame:
    """Placeholder trials so that the trial count starts honest."""
    ids = spark.range(1, count + 1)
    return _complete(
        ids.select(
            (F.col("id") + after).alias("seq"), F.format_string("seed_%03d", "id").alias("hypothesis_id"),
            F.lit("seed").alias("kind"), F.concat(F.lit("Pre-system trial seed "), F.col("id").cast("string")).alias("hypothesis_text"),
            F.lit(note).alias("rationale"), F.lit("{}").alias("metrics_json"), F.lit(False).alias("accepted"),
            F.lit("pre_system_seed").alias("rejection_reason"), F.current_timestamp().alias("created_at"),
        )
    )


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark.read.option("mergeSchema", "true").parquet(path))


def _replayed(events: DataFrame) -> DataFrame:
    """Events with `trial_no`, the newest row of their hypothesis as they happen, and `_acc`, whether
    that row is accepted then.  Events before any row are gone."""
    is_record = F.col("kind").isin("record", "seed")
    verdict = F.when(F.col("kind") == "override", F.lit(True)).when(is_record, F.col("accepted"))
    ev = events.withColumn("_at", F.timestamp_micros("seq"))
    frame = Panel(ev, keys=("hypothesis_id",), ts="_at", block="second").frame()
    run = cumulative(frame, {"_recs": ("sum", is_record.cast("int")), "_acc": ("last", verdict)}).core()
    # a lone override makes a placeholder; a deployment of it before the first record makes it a row of its own
    before = lambda kind: F.when((F.col("_recs") == 0) & (F.col("kind") == kind), F.col("seq"))
    heads = run.groupBy("hypothesis_id").agg(F.min(before("override")).alias("_held"), F.max(before("deploy")).alias("_early"))
    own_row = F.coalesce(F.col("_early") > F.col("_held"), F.lit(False)).cast("int")
    row = F.when(F.col("_recs") == 0, (F.col("seq") >= F.col("_held")).cast("int")).otherwise(F.col("_recs") + own_row)
    run = join_groups(run, heads, ["hypothesis_id"]).withColumn("trial_no", row.cast("bigint"))
    return run.filter("trial_no > 0").drop("_recs", "_held", "_early")


def trials(events: DataFrame) -> DataFrame:
    """One row per trial, as the events leave it.

    A record makes a new row, except that the first record after a lone override
    fills the override's placeholder.  An override accepts the newest row; a
    deployment changes every row of the hypothesis accepted at that moment.

    The work is linear in the events.  Only the newest row can change its verdict, so a
    deployment is weighed at its own moment for that row alone; all older rows have their
    final verdict by then, and of the deployments that reach them only the hypothesis' last
    ones (of any kind, to paper, live) can show.
    """
    is_record = F.col("kind").isin("record", "seed")
    is_override, is_deploy = F.col("kind") == "override", F.col("kind") == "deploy"
    run = checkpointed(_replayed(events))
    verdict = F.when(is_override, F.lit(True)).when(is_record, F.col("accepted"))
    applied = is_deploy & F.coalesce("_acc", F.lit(False))
    rec = lambda c: F.max_by(F.struct(c), F.when(is_record, F.col("seq")))[c]
    last = lambda value, when: F.max_by(F.struct(value.alias("v")), F.when(when, F.col("seq")))["v"]
    none = F.lit(None).cast("string")
    day = F.col("created_at").cast("date")
    move = F.struct(F.col("seq"), F.col("trial_no").alias("row"), "status", F.col("size_multiplier").alias("size"), day.alias("day"))
    newest = lambda when: F.max(F.when(when, move))
    kinds = {"any": F.lit(True), "paper": F.col("status") == "paper", "live": F.col("status") == "live"}
    reset = F.struct(
        F.col("seq"), F.col("trial_no").alias("row"), F.lit("archived").alias("status"),
        F.coalesce("size_multiplier", F.lit(1.0)).alias("size"), day.alias("day"),
    )
    out = run.groupBy("hypothesis_id", "trial_no").agg(
        F.min(F.when(~is_deploy, F.col("seq"))).alias("first_seq"),
        F.min_by("created_at", F.when(~is_deploy, F.col("seq"))).alias("created_at"),
        F.coalesce(rec("hypothesis_text"), F.first("hypothesis_id")).alias("hypothesis_text"),
        F.coalesce(rec("rationale"), F.lit("override applied pre-validation")).alias("rationale"),
        F.coalesce(rec("code"), F.lit("")).alias("code"),
        F.coalesce(rec("metrics_json"), F.lit("{}")).alias("metrics_json"),
        rec("returns_json").alias("returns_json"),
        rec("market_type").alias("market_type"),
        last(verdict, is_record | is_override).alias("accepted"),
        last(F.when(is_record, F.col("rejection_reason")).otherwise(none), is_record | is_override).alias("rejection_reason"),
        F.max(F.when(is_record, reset)).alias("_reset"),
        *[newest(applied & k).alias(f"_own_{n}") for n, k in kinds.items()],
        F.sum(is_override.cast("bigint")).alias("n_overrides"),
    )
    moves = run.filter(is_deploy).groupBy("hypothesis_id").agg(*[newest(k).alias(f"_last_{n}") for n, k in kinds.items()])
    out = join_groups(out, moves, ["hypothesis_id"], "left")
    # a later row was the newest one when it came, so this row had its final verdict
    later = lambda n: F.when(F.col("accepted") & (F.col(f"_last_{n}.row") > F.col("trial_no")), F.col(f"_last_{n}"))
    out = out.withColumns({f"_{n}": F.greatest(f"_own_{n}", later(n), *(["_reset"] if n == "any" else [])) for n in kinds})
    out = checkpointed(out.select(
        "hypothesis_id", "trial_no", "first_seq", "created_at", "hypothesis_text", "rationale", "code", "metrics_json", "returns_json",
        "market_type", "accepted", "rejection_reason", F.coalesce("_any.status", F.lit("override_pending")).alias("deployment_status"),
        F.coalesce("_any.size", F.lit(1.0)).alias("size_multiplier"), F.col("_paper.day").alias("paper_start_date"),
        F.col("_live.day").alias("live_start_date"), "n_overrides",
    ))
    placed = tally(out, [], "first_seq", prefix="_n_")
    return placed.withColumn("n_trials_at_time", F.col("_n_lt")).drop("_n_lt", "_n_eq", "_n_n")


def n_trials(trial_rows: DataFrame) -> DataFrame:
    return trial_rows.agg(F.count("*").alias("n_trials"))


def status(trial_rows: DataFrame) -> DataFrame:
    """Counts of trials, accepted, deployed and overridden, and the newest date."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return trial_rows.agg(
        F.count("*").alias("total_trials"),
        n(F.col("accepted")).alias("accepted_count"),
        n(F.col("deployment_status").isin("paper", "live")).alias("deployed_strategies"),
        n(F.col("n_overrides") > 0).alias("override_count"),
        F.max_by("created_at", "first_seq").alias("last_trial_date"),
    )


def recent(trial_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The newest trials with a readable verdict (a top-k on the insert order)."""
    text = F.concat(F.lit("REJECT ("), F.coalesce(F.nullif("rejection_reason", F.lit("")), F.lit("unspec")), F.lit(")"))
    sharpe = F.get_json_object("metrics_json", "$.sharpe_ratio").try_cast("double")
    return trial_rows.orderBy(F.col("first_seq").desc()).limit(limit).select(
        "first_seq", "hypothesis_id", F.substring("hypothesis_text", 1, 80).alias("hypothesis_text"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), "accepted",
        F.when(F.col("accepted"), "ACCEPT").otherwise(text).alias("verdict"), "deployment_status", "created_at",
    )


def survivors(trial_rows: DataFrame) -> DataFrame:
    return trial_rows.filter("accepted")


def accepted_returns(trial_rows: DataFrame, *, skip_retired: bool = False) -> DataFrame:
    """(hypothesis_id, trial_no, ts, ret) of accepted trials from the stored JSON;
    text that is not a return series is skipped."""
    rows = survivors(trial_rows)
    if skip_retired:
        rows = rows.filter(F.coalesce(F.col("deployment_status") != "retired", F.lit(True)))
    parsed = F.from_json("returns_json", "index array<string>, values array<double>")
    pairs = F.explode(F.arrays_zip(F.col("_p.index").alias("ts"), F.col("_p.values").alias("ret")))
    return rows.withColumn("_p", parsed).filter(
        F.col("_p.index").isNotNull() & F.col("_p.values").isNotNull()
    ).select("hypothesis_id", "trial_no", pairs.alias("_r")).select(
        "hypothesis_id", "trial_no", F.col("_r.ts").try_cast("timestamp").alias("ts"), F.col("_r.ret").alias("ret")
    )


def overrides_audit(events: DataFrame) -> DataFrame:
    """Every override ever applied, in order."""
    return events.filter("kind = 'override'").select(
        "seq", "hypothesis_id", "failure", "reason", "created_at"
    ).orderBy("seq")


def portfolio_greeks(trial_rows: DataFrame, greeks: DataFrame, *, ts: list[str], limits: dict[str, float] | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """(per strategy, net over all): last greeks of deployed option strategies times
    their size; a size of zero or none counts as one."""
    names = ("delta", "gamma", "vega", "theta")
    deployed = trial_rows.filter(
        F.col("deployment_status").isin("paper", "live") & (F.col("market_type") == "options")
    ).select("hypothesis_id", "trial_no", F.coalesce(F.nullif("size_multiplier", F.lit(0.0)), F.lit(1.0)).alias("size"))
    exits = greeks.join(deployed, "hypothesis_id", "left_semi").groupBy("hypothesis_id").agg(
        F.max_by(F.struct(*names), F.struct(*ts)).alias("g")
    )
    per = deployed.join(exits, "hypothesis_id").select(
        "hypothesis_id", "trial_no", "size",
        *[(F.coalesce(F.col(f"g.{n}"), F.lit(0.0)) * F.col("size")).alias(n) for n in names],
    )
    net = per.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"net_{n}") for n in names])
    for n, cap in (limits or {}).items():
        net = net.withColumn(f"{n}_breached", F.abs(f"net_{n}") > cap)
    return per, net
