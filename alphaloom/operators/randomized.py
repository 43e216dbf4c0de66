"""Strategies against chance: permuted timing, random rules, bootstrapped series.

Trials never meet the data in a cross join: a bar row explodes to its own trials,
draws come from digests of ids, and each trial collapses to moments map-side.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.draws import hash_order, spread, stream_base, trial_draws, uniforms
from ..core.expr import col, join_groups, ratio, sharpe
from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..core.ranks import group_quantiles, tally
from ..core.scan import numbered
from .splits import counted

ACTIVE = 1e-6
MAX_RULES = 100_000


def reconstruct_asset_returns(panel: Panel, *, position: str = "position", net: str = "net",
                              name: str = "asset_ret", eps: float = ACTIVE) -> Panel:
    """net[t] / position[t-1], unknown where nothing was held."""
    frame = panel.frame(back=1)
    prior = frame.lag(position, 1)
    return panel.with_df(
        frame.core(
            frame.df.withColumn("_prior", prior)
            .withColumn(name, F.when(F.abs("_prior") > eps, ratio(net, "_prior")))
            .drop("_prior")
        )
    )


def verdict(actual: str | Column, p95: str | Column, p50: str | Column) -> Column:
    return F.when(col(actual) > col(p95), "pass").when(col(actual) > col(p50), "borderline").otherwise("fail")


def permutation_trials(panel: Panel, *, n: int = 1000, seed: int = 7, position: str = "position",
                       net: str = "net", asset_ret: str | None = None, annualization: float = 252
                       ) -> tuple[DataFrame, DataFrame]:
    """(profile per key, Sharpe per key and trial) of randomly timed positions.

    Each trial holds as many bars as the strategy did, on bars whose asset return is
    known (any bar where too few are), with sizes drawn from its own and its long
    share kept.
    """
    keys = list(panel.keys)
    if asset_ret is None:
        panel, asset_ret = reconstruct_asset_returns(panel, position=position, net=net), "asset_ret"
    frame = panel.frame(back=1)
    rows = frame.core(frame.df.withColumn("_prior", frame.lag(position, 1))).select(
        *keys, panel.ts, net, F.col(asset_ret).alias("_asset"), "_prior",
        F.coalesce(F.abs("_prior") > ACTIVE, F.lit(False)).alias("_active"),
    )
    rows = checkpointed(rows)  # read by the profile, the sizes and the pool
    profile = rows.groupBy(*keys).agg(
        F.count("*").alias("n_bars"),
        F.sum(F.col("_active").cast("bigint")).alias("n_active"),
        F.count("_asset").alias("n_observed"),
        F.avg(F.when(F.col("_active"), (F.col("_prior") > 0).cast("double"))).alias("long_share"),
        sharpe(F.avg(net), F.stddev_samp(net), annualization).alias("actual_sharpe"),
    )
    # sizes to draw from, numbered per key
    active = panel.with_df(rows.filter("_active").select(*keys, panel.ts, F.abs("_prior").alias("_size")))
    sizes = numbered(active.frame(), "_k").core().select(*keys, "_k", "_size")

    draw_from = profile.filter("n_active > 0").select(*keys, "n_bars", "n_active", "n_observed", "long_share")
    open_bars = rows.join(draw_from, keys).filter(
        F.col("_asset").isNotNull() | (F.col("n_observed") < F.col("n_active"))
    )
    if panel.bounded:  # a key's bars are bounded by its calendar, so they travel as arrays
        sums = _array_sums(open_bars, sizes, keys, panel.ts, n, seed)
    else:
        sums = _row_sums(panel, open_bars, sizes, keys, panel.ts, n, seed)
    mean = ratio("_s", "_n")
    var = ratio(F.col("_q") - F.col("_s") * mean, F.col("_n") - 1)
    sr = ratio(mean, F.when(var > 0, F.sqrt(var))) * math.sqrt(annualization)
    return profile, sums.select(*keys, "trial", F.coalesce(sr, F.lit(0.0)).alias("sharpe"))


def _row_sums(panel: Panel, open_bars: DataFrame, sizes: DataFrame, keys: list[str], ts: str, n: int, seed: int) -> DataFrame:
    """Per key and trial the sum and square sum of random returns; a row per bar and trial."""
    bars = numbered(panel.with_df(open_bars).frame(), "_bar").core()
    pool = spread(bars, *keys, ts).select(
        *keys, "_bar", F.coalesce("_asset", F.lit(0.0)).alias("_r"), "n_bars", "n_active", "long_share",
        stream_base(seed, *keys).alias("_base"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("trial"),
    )

    @F.pandas_udf("order long, u double, v double")
    def draws(base: pd.Series, trial: pd.Series, bar: pd.Series) -> pd.DataFrame:
        order, u, v = trial_draws(base.to_numpy(), trial.to_numpy(), bar.to_numpy())
        return pd.DataFrame({"order": order.astype(np.int64), "u": u, "v": v})

    pool = pool.withColumn("_d", draws("_base", "trial", "_bar")).withColumn("_place", F.struct("_d.order", "_bar"))
    picked = tally(pool, [*keys, "trial"], "_place", prefix="_p_").filter(F.col("_p_lt") < F.col("n_active"))
    held = picked.withColumns(
        {
            "_k": F.floor(F.col("_d.u") * F.col("n_active")).cast("bigint"),
            "_side": F.when(F.col("_d.v") < F.col("long_share"), 1.0).otherwise(-1.0),
        }
    ).join(sizes, [*keys, "_k"])
    x = F.col("_size") * F.col("_side") * F.col("_r")
    return held.groupBy(*keys, "trial").agg(
        F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.first("n_bars").alias("_n")
    )


TRIAL_BLOCK = 50  # trials that one input row of the array form stands for


def _array_sums(open_bars: DataFrame, sizes: DataFrame, keys: list[str], ts: str, n: int, seed: int) -> DataFrame:
    """The same sums with a key's bars as arrays: blocks of trials are spread over the
    tasks, drawn as matrices, and only one row per trial leaves them."""
    held = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_size"))).alias("_sizes"))
    bars = open_bars.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.coalesce("_asset", F.lit(0.0)).alias("r")))).alias("_bars"),
        F.first("n_bars").alias("_n"), F.first("n_active").alias("_active"), F.first("long_share").alias("_long"),
    )
    blocks = join_groups(bars, held, keys).select(
        *keys, stream_base(seed, *keys).alias("x_base"), F.col("_bars.r").alias("x_r"),
        F.col("_sizes._size").alias("x_size"), F.col("_n").alias("x_n"), F.col("_active").alias("x_active"),
        F.col("_long").alias("x_long"),
        F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(TRIAL_BLOCK))).alias("x_first"),
    )
    schema = T.StructType(
        [bars.schema[k] for k in keys] + [T.StructField("trial", T.IntegerType()), T.StructField("_s", T.DoubleType()),
                                          T.StructField("_q", T.DoubleType()), T.StructField("_n", T.LongType())]
    )

    def block(row) -> pd.DataFrame:
        trials = np.arange(row.x_first, min(row.x_first + TRIAL_BLOCK, n + 1))
        r = np.asarray(row.x_r, dtype=float)
        order, u, v = trial_draws(np.int64(row.x_base), trials[:, None], np.arange(len(r))[None, :])
        picked = np.argsort(order, axis=1, kind="stable")[:, : row.x_active]
        u, v = (np.take_along_axis(d, picked, axis=1) for d in (u, v))
        size = np.asarray(row.x_size, dtype=float)[np.floor(u * row.x_active).astype(int)]
        x = size * np.where(v < row.x_long, 1.0, -1.0) * r[picked]
        made = {k: [getattr(row, k)] * len(trials) for k in keys}
        return pd.DataFrame(made | {"trial": trials, "_s": x.sum(axis=1), "_q": (x * x).sum(axis=1), "_n": row.x_n})

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.concat([block(row) for row in f.itertuples(index=False)])[schema.names]

    return spread(blocks, *keys, "x_first").mapInPandas(run, schema)


def permutation_test(panel: Panel, **kwargs) -> DataFrame:
    """Where the strategy's Sharpe falls among its randomly timed copies."""
    n, ann = kwargs.get("n", 1000), kwargs.get("annualization", 252)
    keys = list(panel.keys)
    profile, trials = permutation_trials(panel, **{**kwargs, "n": n, "annualization": ann})
    joined = trials.join(profile.select(*keys, "actual_sharpe"), keys)
    s = F.col("sharpe")
    # one number per trial: the percentile state is bounded by the number of trials
    summary = joined.groupBy(*keys).agg(
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"),
        F.percentile(s, F.lit(0.5)).alias("p50"), F.percentile(s, F.lit(0.95)).alias("p95"),
        (F.avg((s < F.col("actual_sharpe")).cast("double")) * 100).alias("pct"),
    )
    out = profile.join(summary, keys, "left")
    ok = F.col("n_active") > 0
    return out.select(
        *keys,
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.round("actual_sharpe", 4).alias("actual_sharpe"),
        F.round("mean", 4).alias("random_sharpe_mean"),
        F.round("std", 4).alias("random_sharpe_std"),
        F.round("p50", 4).alias("random_sharpe_p50"),
        F.round("p95", 4).alias("random_sharpe_p95"),
        F.round("pct", 2).alias("actual_percentile"),
        F.col("n_active").alias("n_active_bars"),
        F.when(ok, verdict("actual_sharpe", "p95", "p50")).alias("verdict"),
    )


# --- random rules ------------------------------------------------------------------------


def random_rules(spark: SparkSession, features: list[str], *, n: int = 1000, stages: tuple[int, ...] = (1, 2, 3),
                 low: float = -3.0, high: float = 3.0, seed: int = 7,
                 directions: tuple[str, ...] = ("long", "short", "both"), max_hold: int = 10,
                 freshness: tuple[int, ...] = (1, 2, 3, 5, 7), trends: tuple[str, ...] = ("none", "short_only", "both"),
                 ) -> DataFrame:
    """Random rules: distinct features, each above or below a threshold, and the constraints of a
    real strategy: how many bars a condition stays fresh, how many bars a position is held, and
    which sides need the trend with them."""
    pick = lambda values, u: F.element_at(
        F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1
    )
    rules = spark.range(n).withColumnRenamed("id", "rule_id")
    u = uniforms(2, seed, "rule_id")
    v = uniforms(3, seed + 1, "rule_id")
    rules = rules.select(
        "rule_id",
        pick(stages, u[0]).alias("n_stages"),
        pick(directions, u[1]).alias("direction"),
        pick(freshness, v[0]).alias("freshness"),
        (F.floor(v[1] * max_hold) + 1).cast("int").alias("hold"),
        pick(trends, v[2]).alias("trend"),
    )
    per_feature = []
    for f in features:
        a, b, c = uniforms(3, seed + 2, "rule_id", F.lit(f))
        per_feature.append(
            F.struct(
                a.alias("order"), F.lit(f).alias("feature"),
                F.when(b < 0.5, ">").otherwise("<").alias("op"),
                (low + (high - low) * c).alias("threshold"), F.lit(None).cast("string").alias("target"),
            )
        )
    conds = F.slice(F.array_sort(F.array(*per_feature)), 1, F.col("n_stages"))
    return rules.withColumn("conditions", conds).drop("n_stages")


def candidate_rules(df: DataFrame, numeric: list[str], categorical: list[str], *, n: int = 2000,
                    seed: int = 7, max_conditions: int = 4) -> DataFrame:
    """Random filters on a candidate table: a category equal to one of its values, a
    number above or below a level between its 10% and 90% quantiles, and a side."""
    spark = df.sparkSession
    cats = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categorical]).first().asDict()
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in numeric])
    long = df.select(F.explode(named).alias("p")).select("p.*")
    levels = {
        r["feature"]: (float(r["a"]), float(r["b"]))
        for r in group_quantiles(long, ["feature"], "x", {"a": 0.1, "b": 0.9}).collect()
        if r["a"] is not None
    }
    options = []
    for f in [*[c for c in categorical if cats[c]], *[c for c in numeric if c in levels]]:
        a, b, c = uniforms(3, seed + 2, "rule_id", F.lit(f))
        if f in levels:
            lo, hi = levels[f]
            op, thr = F.when(b < 0.5, ">").otherwise("<"), lo + (hi - lo) * c
            tgt = F.lit(None).cast("string")
        else:
            values = F.array(*[F.lit(v) for v in cats[f]])
            op, thr = F.lit("="), F.lit(None).cast("double")
            tgt = F.element_at(values, F.floor(c * len(cats[f])).cast("int") + 1)
        options.append(
            F.struct(a.alias("order"), F.lit(f).alias("feature"), op.alias("op"),
                     thr.alias("threshold"), tgt.alias("target"))
        )
    u = uniforms(2, seed, "rule_id")
    count = (F.floor(u[0] * max_conditions) + 1).cast("int")
    side = F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("both")), F.floor(u[1] * 3).cast("int") + 1)
    return spark.range(n).withColumnRenamed("id", "rule_id").select(
        "rule_id", side.alias("direction"),
        F.slice(F.array_sort(F.array(*options)), 1, count).alias("conditions"),
    )


def rule_moments(df: DataFrame, rules: DataFrame, *, value: str, group: str | None = None,
                 side: str | None = None, signed: bool = True) -> DataFrame:
    """Per rule (and group): selected rows, and count, sum and sum of squares of the
    value over them.

    The rules are a small table of a size set by a parameter and checked here; they
    travel with the task.  Every task evaluates all rules on its Arrow batches with
    numpy and hands on one line of moments per rule, so the shuffle is rules x tasks
    however many rows there are.  `side` names a text column that long / short rules
    must find in it; without it long and short set the sign of the value and `both`
    follows the first condition.
    """
    table = rules.limit(MAX_RULES + 1).collect()
    if len(table) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    specs = [
        (
            r["rule_id"], r["direction"],
            [(c["feature"], c["op"], c["threshold"], c["target"]) for c in r["conditions"]],
        )
        for r in table
    ]
    used = sorted({f for _, _, cs in specs for f, *_ in cs})
    cols = [*used, value, *([group] if group else []), *([side] if side else [])]
    fields = [T.StructField("rule_id", T.LongType())]
    if group:
        fields.append(df.schema[group])
    fields += [T.StructField(c, T.LongType()) for c in ("n_rows", "n")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("s", "q")]

    def evaluate(batches):
        total: dict = {}
        for pdf in batches:
            groups = pdf.groupby(group, sort=False) if group else [(None, pdf)]
            for g, part in groups:
                acc = total.setdefault(g, np.zeros((len(specs), 4)))
                x = part[value].to_numpy(dtype=float)
                known = ~np.isnan(x)
                x0 = np.where(known, x, 0.0)
                data = {
                    f: part[f].to_numpy() for f in used
                }
                tests: dict = {}
                sides = part[side].fillna("").to_numpy(dtype=str) if side else None
                for i, (_, direction, conds) in enumerate(specs):
                    mask = np.ones(len(part), dtype=bool)
                    for cond in conds:
                        if cond not in tests:
                            f, op, thr, tgt = cond
                            v = data[f]
                            if op == "=":
                                tests[cond] = v == tgt
                            else:
                                v = v.astype(float)
                                tests[cond] = v > thr if op == ">" else v < thr
                        mask &= tests[cond]
                    sign = 1.0
                    if side:
                        word = {"long": "LONG", "short": "SHORT"}.get(direction)
                        if word:
                            if word not in tests:
                                tests[word] = np.char.find(sides, word) >= 0
                            mask &= tests[word]
                    elif signed:
                        if direction == "short" or (direction == "both" and conds and conds[0][1] == "<"):
                            sign = -1.0
                    hit = mask & known
                    y = x0[hit]
                    acc[i] += (mask.sum(), hit.sum(), sign * y.sum(), (y * y).sum())
        for g, acc in total.items():
            out = {"rule_id": [s[0] for s in specs]}
            if group:
                out[group] = [g] * len(specs)
            out |= {"n_rows": acc[:, 0].astype(int), "n": acc[:, 1].astype(int), "s": acc[:, 2], "q": acc[:, 3]}
            yield pd.DataFrame(out)

    parts = df.select(*cols).mapInPandas(evaluate, T.StructType(fields))
    by = ["rule_id", *([group] if group else [])]
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n", "s", "q")])


def moment_sharpe(n: str | Column, s: str | Column, q: str | Column, scale: str | Column | float) -> Column:
    """Sharpe from count, sum and sum of squares; zero without deviation."""
    n, s, q = col(n), col(s), col(q)
    mean = ratio(s, n)
    var = ratio(q - s * mean, n - 1)
    scale = F.lit(scale) if isinstance(scale, (int, float)) else col(scale)
    return F.coalesce(ratio(mean, F.when(var > 0, F.sqrt(var))) * scale, F.lit(0.0))


@dataclass(frozen=True)
class RuleTable:
    """Rules as arrays, one column of a bar matrix per rule; a stage that a rule lacks always holds."""

    ids: np.ndarray
    used: list[str]
    feature: np.ndarray  # stages x rules: number in `used`, -1 for no stage
    above: np.ndarray
    level: np.ndarray
    freshness: np.ndarray
    hold: np.ndarray
    sign: np.ndarray
    needs_trend: np.ndarray

    @classmethod
    def of(cls, rules: DataFrame) -> "RuleTable":
        rows = rules.limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        used = sorted({c["feature"] for r in rows for c in r["conditions"]})
        stages = max((len(r["conditions"]) for r in rows), default=0)
        feature = np.full((stages, len(rows)), -1)
        above, level = np.zeros(feature.shape, bool), np.zeros(feature.shape)
        for k, r in enumerate(rows):
            for j, c in enumerate(r["conditions"]):
                feature[j, k], above[j, k], level[j, k] = used.index(c["feature"]), c["op"] == ">", c["threshold"]
        first = [r["conditions"][0]["op"] if r["conditions"] else ">" for r in rows]
        short = np.array([r["direction"] == "short" or (r["direction"] == "both" and op == "<") for r, op in zip(rows, first, strict=True)], bool)
        trend = np.array([r["trend"] for r in rows], str)
        return cls(
            np.array([r["rule_id"] for r in rows], np.int64), used, feature, above, level,
            np.array([r["freshness"] for r in rows], np.int64), np.array([r["hold"] for r in rows], np.int64),
            np.where(short, -1.0, 1.0), (trend == "both") | ((trend == "short_only") & short),
        )

    def part(self, s: slice) -> "RuleTable":
        f = lambda a: a[..., s]
        return replace(self, **{n: f(getattr(self, n)) for n in ("ids", "feature", "above", "level", "freshness", "hold", "sign", "needs_trend")})

    def entries(self, features: np.ndarray, trend: np.ndarray) -> np.ndarray:
        """bars x rules: may a position begin? Each condition was seen within the freshness window, and the
        trend is on the rule's side where the rule asks for it."""
        bars = np.ones((len(features), len(self.ids)), bool)
        for j in range(len(self.feature)):
            x = features[:, self.feature[j]]
            seen = np.where(self.above[j], x > self.level[j], x < self.level[j])
            fresh = seen.copy()
            for lag in range(1, int(self.freshness.max(initial=1))):
                fresh[lag:] |= seen[:-lag] & (self.freshness > lag)
            bars &= fresh | (self.feature[j] < 0)
        with_trend = np.sign(trend)[:, None] == self.sign
        return bars & (with_trend | ~self.needs_trend)

    def held(self, entries: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bars x rules held, and the bars still to be held after the last one; `left` before the first. A
        position runs its time before the next entry counts."""
        out = np.empty_like(entries)
        for t in range(len(entries)):
            left = np.where((left == 0) & entries[t], self.hold, left)
            out[t] = left > 0
            left = np.maximum(left - 1, 0)
        return out, left


CELLS = 1 << 22  # bars x rules of one matrix


def _by_group(batches, by: list[str]):
    """Whole groups of a stream that is sorted by group."""
    kept: list[pd.DataFrame] = []
    for f in batches:
        if len(f) == 0:
            continue
        new = np.zeros(len(f), bool)
        for k in by:
            c = f[k]
            new[1:] |= ~((c.iloc[1:].values == c.iloc[:-1].values) | (c.iloc[1:].isna().values & c.iloc[:-1].isna().values))
        cut = [0, *np.flatnonzero(new), len(f)]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = f.iloc[a:z]
            if kept and a == 0:
                before = kept[-1].iloc[-1]
                same = all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in ((before[k], part.iloc[0][k]) for k in by))
                if not same:
                    yield pd.concat(kept)
                    kept = []
            elif kept:
                yield pd.concat(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept)


def position_moments(panel: Panel, rules: DataFrame, *, ret: str, trend: str, lag: int = 1) -> DataFrame:
    """Per rule: bars held with a known return, and sum and sum of squares of what they earn.

    A position of bar t earns the return of bar t + lag.  The rules are a small table of a size
    checked here and travel with the task.  A task takes one key (or one segment of a long
    history) after the other as a matrix of bars x rules, and hands on one line of moments per
    rule, so the shuffle is rules x tasks.  Over segments the hold counter is state: each segment
    first says which count it would leave for every count it may begin with, these tables are chained
    along the key, and the segments then run from their true counts.
    """
    table = RuleTable.of(rules)
    most_fresh, most_hold = int(table.freshness.max(initial=1)), int(table.hold.max(initial=1))
    frame = panel.frame(back=most_fresh - 1, ahead=lag)
    part, ts = list(frame.part), panel.ts
    df = frame.df.withColumn("_earned", frame.lead(ret, lag))
    core = F.col("_core") if frame.segmented else F.lit(True)
    cols = list(dict.fromkeys([*part, ts, *table.used, trend]))
    df = checkpointed(df.select(*cols, "_earned", core.alias("_in"))) if frame.segmented else df.select(*cols, "_earned", core.alias("_in"))
    groups = df.repartition(*part).sortWithinPartitions(*part, ts)

    def matrices(f: pd.DataFrame):
        """(rules, entries of the core bars, earned) for slices of the rules."""
        features = f[table.used].to_numpy(dtype=float).reshape(len(f), -1)
        side, inside = f[trend].to_numpy(dtype=float), f["_in"].to_numpy(dtype=bool)
        step = max(1, CELLS // max(len(f), 1))
        for lo in range(0, len(table.ids), step):
            some = table.part(slice(lo, lo + step))
            yield slice(lo, lo + step), some, some.entries(features, side)[inside]

    chained = frame.segmented
    if chained:
        key = [df.schema[c] for c in part]

        def tables(batches):
            for f in _by_group(batches, part):
                after = np.empty((most_hold, len(table.ids)), np.uint16)
                for at, some, entries in matrices(f):
                    for left in range(most_hold):
                        after[left, at] = some.held(entries, np.full(len(some.ids), left))[1]
                yield f[part].head(1).assign(after=[after.tobytes()])

        def chain(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("_seg")
            left, out = np.zeros(len(table.ids), np.uint16), []
            for after in f["after"]:
                out.append(left.tobytes())
                left = np.frombuffer(after, np.uint16).reshape(most_hold, -1)[left, np.arange(len(left))]
            return f[part].assign(left=out)

        known = groups.mapInPandas(tables, T.StructType([*key, T.StructField("after", T.BinaryType())]))
        by_key = known.groupBy(*panel.keys) if panel.keys else known.groupBy()
        starts = by_key.applyInPandas(chain, T.StructType([*key, T.StructField("left", T.BinaryType())]))
        groups = join_groups(df, starts, part).repartition(*part).sortWithinPartitions(*part, ts)

    def evaluate(batches):
        total = np.zeros((3, len(table.ids)))
        for f in _by_group(batches, part):
            earned = f["_earned"].to_numpy(dtype=float)[f["_in"].to_numpy(dtype=bool)]
            known, gain = ~np.isnan(earned), np.nan_to_num(earned)
            first = np.frombuffer(f["left"].iloc[0], np.uint16).astype(np.int64) if chained else np.zeros(len(table.ids), np.int64)
            for at, some, entries in matrices(f):
                held = some.held(entries, first[at])[0]
                total[0, at] += known.astype(float) @ held
                total[1, at] += some.sign * (gain @ held)
                total[2, at] += (gain * gain) @ held
        yield pd.DataFrame({"rule_id": table.ids, "n": total[0].astype(np.int64), "s": total[1], "q": total[2]})

    lines = groups.mapInPandas(evaluate, "rule_id long, n long, s double, q double")
    return lines.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def rule_search(panel: Panel, rules: DataFrame, actual_sharpe: float, *, ret: str, trend: str, lag: int = 1,
                margin: float = 0.10, annualization: float = 252) -> DataFrame:
    """Best Sharpe any random rule reaches on the panel, and whether the strategy
    beats it by the margin.  A rule earns what its positions earn and nothing
    otherwise, so every Sharpe is over all bars with a return."""
    moments = position_moments(panel, rules, ret=ret, trend=trend, lag=lag)
    n_all = panel.df.agg(F.count(ret)).first()[0]
    sharpes = moments.withColumn(
        "sharpe", moment_sharpe(F.lit(n_all), "s", "q", math.sqrt(annualization))
    )
    best = sharpes.agg(
        F.max("sharpe").alias("best_random_sharpe"),
        F.max_by("rule_id", F.struct("sharpe", -F.col("rule_id"))).alias("best_rule_id"),
        F.count("*").alias("n_rules"),
    )
    b, actual = F.col("best_random_sharpe"), F.lit(float(actual_sharpe))
    required = F.when(b > 0, b * (1 + margin)).otherwise(b + F.abs(b) * margin + 1e-9)
    return best.select(
        actual.alias("actual_sharpe"), "best_random_sharpe", "best_rule_id", "n_rules",
        F.when(b > 0, F.round((actual / b - 1) * 100, 2)).alias("actual_vs_best_pct"),
        F.when(actual >= required, "pass").when(actual >= b, "borderline").otherwise("fail").alias("verdict"),
    )


# --- candidate trades ------------------------------------------------------------------


def pair_value(text: str | Column, key: str) -> Column:
    """Value of a key in 'k=v; k=v' text, trimmed; NULL without the key.  The last of
    repeated keys wins."""
    pattern = rf"^(?:.*;)?\s*{key}\s*=\s*([^;]*?)\s*(?:;.*)?$"
    found = col(text).rlike(pattern)
    return F.when(found, F.regexp_extract(col(text), pattern, 1))


NUMERIC = ("iv", "rr", "put", "call")
CATEGORICAL = ("m1", "m2", "stall", "divergence")


def candidate_panel(df: DataFrame, *, text: str = "ExtraInputs", net_pct: str = "Net%",
                    status: str = "Status") -> DataFrame:
    """Candidate trades with their features as columns."""
    made = {c: pair_value(text, c) for c in CATEGORICAL}
    made |= {c: pair_value(text, c).try_cast("double") for c in NUMERIC}
    made["net"] = F.col(f"`{net_pct}`").try_cast("double") / 100.0
    made["is_accepted"] = F.coalesce(F.col(status) == "ACCEPTED", F.lit(False))
    return df.withColumns(made)


def span_years(df: DataFrame, entry: str = "Entry") -> float:
    """Years between the first and the last entry."""
    lo, hi = df.agg(F.min(F.col(entry).cast("date")), F.max(F.col(entry).cast("date"))).first()
    return max((hi - lo).days / 365.25, 1e-9)


def trade_sharpe(df: DataFrame, *, by: list[str], years: float, net: str = "net") -> DataFrame:
    """Per-trade Sharpe and its annualised form by realised trade frequency."""
    x, n = F.col(net), F.count(net)
    per_trade = F.when(n >= 2, F.coalesce(ratio(F.avg(x), F.stddev_samp(x)), F.lit(0.0))).otherwise(0.0)
    return df.groupBy(*by).agg(
        n.alias("n_trades"), per_trade.alias("per_trade_sharpe"),
        (per_trade * F.sqrt(n / years)).alias("annualized_sharpe"),
    )


def consensus_rule_search(df: DataFrame, *, n: int = 2000, min_trades: int = 50, margin: float = 0.10,
                          seed: int = 7) -> DataFrame:
    """Accepted trades against the best of random filters on the same features.

    The candidates are read several times, so their parsed columns are checkpointed.
    """
    df = checkpointed(df.select(*NUMERIC, *CATEGORICAL, "Entry", "Direction", "net", "is_accepted"))
    years = span_years(df)
    rules = candidate_rules(df, list(NUMERIC), list(CATEGORICAL), n=n, seed=seed)
    moments = rule_moments(df, rules, value="net", side="Direction")
    sharpes = moments.filter(F.col("n_rows") >= min_trades).withColumn(
        "sharpe", moment_sharpe("n", "s", "q", F.sqrt(F.col("n") / years))
    )
    acc = F.when(F.col("is_accepted"), F.col("net"))
    base = df.agg(
        F.count("*").alias("n_candidates"), F.sum(F.col("is_accepted").cast("bigint")).alias("n_accepted"),
        F.coalesce(ratio(F.avg(acc), F.stddev_samp(acc)), F.lit(0.0)).alias("real_pertrade_sharpe"),
        (F.coalesce(ratio(F.avg(acc), F.stddev_samp(acc)), F.lit(0.0)) * F.sqrt(F.count(acc) / years)).alias("real"),
        (F.coalesce(ratio(F.avg("net"), F.stddev_samp("net")), F.lit(0.0)) * F.sqrt(F.count("net") / years)).alias("pool"),
    ).first()
    real = F.lit(base["real"])
    s = F.col("sharpe")
    best = sharpes.agg(
        F.max(s).alias("best"), F.coalesce(F.percentile(s, F.lit(0.5)), F.lit(0.0)).alias("p50"),
        F.coalesce(F.percentile(s, F.lit(0.95)), F.lit(0.0)).alias("p95"),
        F.coalesce(F.avg((s < real).cast("double")), (real > 0).cast("double")).alias("share"),
        F.count("*").alias("n_valid_rules"),
    )
    b = F.coalesce(F.col("best"), F.lit(float("-inf")))
    required = F.when(b > 0, b * (1 + margin)).otherwise(b)
    return best.select(
        F.round(F.lit(years), 2).alias("span_years"),
        F.lit(base["n_candidates"]).alias("n_candidates"), F.lit(base["n_accepted"]).alias("n_accepted"),
        F.round(real, 4).alias("real_annualized_sharpe"),
        F.round(F.lit(base["real_pertrade_sharpe"]), 4).alias("real_pertrade_sharpe"),
        F.round(F.lit(base["pool"]), 4).alias("full_pool_sharpe"),
        F.round("best", 4).alias("best_random_sharpe"), F.round("p50", 4).alias("random_sharpe_p50"),
        F.round("p95", 4).alias("random_sharpe_p95"), F.round(F.col("share") * 100, 2).alias("real_percentile"),
        "n_valid_rules",
        F.when((real >= required) & (real > 0), "pass").when(real >= b, "borderline").otherwise("fail").alias("verdict"),
    )


# The words of the assessment.
ASSESSMENTS = {
    "capital": "capital_constraint_not_signal_filter",
    "losers": "ADDS_VALUE_blocked_losers",
    "risky": "GOOD_RISK_CONTROL_blocked_high_variance_winners",
    "clean": "COSTS_ALPHA_blocked_clean_winners",
}


def filter_value(df: DataFrame, *, status: str = "Status", net: str = "net") -> DataFrame:
    """What each filter blocked, against what was accepted, mean and tail."""
    x = F.col(net)
    stats = df.groupBy(status).agg(
        F.count("*").alias("n_blocked"), (F.avg(x) * 100).alias("mean"),
        (F.stddev_samp(x) * 100).alias("std"), (F.min(x) * 100).alias("worst"),
    ).withColumn("_one", F.lit(1))
    kept = stats.filter(F.col(status) == "ACCEPTED").select(
        "_one", F.col("std").alias("kept_std"), F.col("worst").alias("kept_worst")
    )
    capital = F.col(status).contains("BUDGET") | F.col(status).contains("SECTOR")
    risky = (F.col("std") > 1.5 * F.col("kept_std")) | (F.col("worst") < 1.8 * F.col("kept_worst"))
    label = (
        F.when(capital, ASSESSMENTS["capital"]).when(F.col("mean") < 0, ASSESSMENTS["losers"])
        .when(risky, ASSESSMENTS["risky"]).otherwise(ASSESSMENTS["clean"])
    )
    return stats.filter(F.col(status) != "ACCEPTED").join(kept, "_one", "left").select(
        status, "n_blocked", F.round("mean", 3).alias("blocked_mean_net_pct"),
        F.round("std", 3).alias("blocked_std_pct"), F.round("worst", 3).alias("blocked_worst_pct"),
        label.alias("assessment"),
    )


# --- block bootstrap -------------------------------------------------------------------


def block_bootstrap(panel: Panel, *, value: str, replicates: int = 100, block: int = 5, seed: int = 7) -> DataFrame:
    """Circular block bootstrap: (keys, replicate, i, value).

    Replicate positions are made from the series length alone and fetch their value
    by row number, so the join keys are as fine as single rows.
    """
    keys = list(panel.keys)
    rows = counted(panel.select(value))
    lengths = rows.groupBy(*keys).agg(F.max("n").alias("n"))
    copies = lengths.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    blocks = spread(copies, *keys, "replicate").withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block)))
    )
    (u,) = uniforms(1, seed, *keys, "replicate", "b")
    cells = blocks.withColumn("start", F.floor(u * F.col("n"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    ).select(
        *keys, "replicate", (F.col("b") * block + F.col("j")).alias("i"), "n",
        ((F.col("start") + F.col("j")) % F.col("n")).alias("rn"),
    ).filter("i < n")
    return cells.join(rows.select(*keys, "rn", value), [*keys, "rn"]).select(*keys, "replicate", "i", value)
