"""Structured Streaming forms of the running side."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core.lineage import scratch_path
from ..core.panel import Panel
from ..operators.production import live_diagnose
from ..sources.files import DECISION_SCHEMA


def run_available(stream: DataFrame, path: str, *, fmt: str = "parquet", checkpoint: str | None = None,
                  mode: str = "append") -> DataFrame:
    """Process what has arrived and stop; the checkpoint lies in the shared folder, so
    a lost driver or executor resumes where it stopped."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    query = (
        stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(path)


def run_to_the_end(stream: DataFrame, path: str, keys: list[str], *, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived and return the newest state of every key, also of windows that
    the watermark hasn't closed.

    Each batch is stored with its number, so a batch that is run again replaces itself; of a
    key that several batches changed the newest batch counts.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(each).outputMode("update")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    seen = spark.read.option("basePath", path).parquet(path)
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_now")).select(*keys, "_now.*")


def window_metrics(events: DataFrame, *, by: list[str], value: str = "value", ts: str = "ts", width: str = "1 hour",
                   slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Metrics per event-time window; rows later than `late` are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total", "min", "max")


TRIP_STATE = "equity double, peak double, recent array<double>, reason string, trip_ts timestamp"
TRIP_OUTPUT = "strategy_id string, ts timestamp, tripped boolean, trip_reason string, trip_ts timestamp, equity double"


def _first_trip(equity: np.ndarray, peak: np.ndarray, net: np.ndarray, sharpe: np.ndarray, max_drawdown: float,
                max_loss: float, min_sharpe: float | None) -> tuple[int, str] | None:
    """Place and name of the first rule that trips; the rules' order decides on one bar."""
    with np.errstate(divide="ignore", invalid="ignore"):
        tests = [(f"drawdown>{max_drawdown:.2%}", (peak != 0) & (equity / peak - 1.0 <= -max_drawdown))]
    tests.append((f"daily_loss>{max_loss:.2%}", net <= -max_loss))
    if min_sharpe is not None:
        tests.append((f"sharpe<{min_sharpe}", sharpe < min_sharpe))
    hits = [(int(np.argmax(t)), k, name) for k, (name, t) in enumerate(tests) if t.any()]
    return (min(hits)[0], min(hits)[2]) if hits else None


def _rolling_sharpe(values: np.ndarray, window: int) -> np.ndarray:
    """Annualised, for each value with a full window; NaN before and for a constant window."""
    out = np.full(len(values), np.nan)
    if len(values) >= window:
        seen = np.lib.stride_tricks.sliding_window_view(values, window)
        sd = seen.std(axis=1, ddof=1)
        out[window - 1 :] = np.where(sd > 0, seen.mean(axis=1) / np.where(sd > 0, sd, 1.0) * math.sqrt(252), np.nan)
    return out


def kill_switch_stream(
    returns: DataFrame, *, max_drawdown: float = 0.10, max_loss: float = 0.03, min_sharpe: float | None = None,
    window: int = 60,
) -> DataFrame:
    """Status per strategy after each micro-batch of (strategy_id, ts, net and, optionally, reset).

    Equity, peak, the last returns and the trip survive between batches.  Once tripped, a
    strategy stays tripped until a row whose `reset` is TRUE; that row's return and those
    after it are tested again.  A NULL return is a hole in the data and changes nothing.
    """
    if "reset" not in returns.columns:
        returns = returns.withColumn("reset", F.lit(False))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, recent, reason, trip_ts = state.get if state.exists else (1.0, None, [], None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        reset = rows["reset"].fillna(False).to_numpy(dtype=bool)
        net, held = rows["net"].to_numpy(dtype=float), rows["net"].notna().to_numpy()
        part = np.cumsum(reset)[held]  # runs of returns between resets
        x, times = net[held], rows["ts"].to_numpy()[held]
        levels = equity * np.cumprod(1.0 + x)
        peaks = np.maximum.accumulate(levels if peak is None else np.concatenate([[peak], levels]))[-len(x) :] if len(x) else levels
        history = np.concatenate([np.array(recent or [], dtype=float), x])
        sharpe = _rolling_sharpe(history, window)[len(history) - len(x) :]
        for k in range(int(reset.sum()) + 1):
            if k:
                reason, trip_ts = None, None
            run = np.flatnonzero(part == k)
            if reason is None and len(run):
                hit = _first_trip(levels[run], peaks[run], x[run], sharpe[run], max_drawdown, max_loss, min_sharpe)
                if hit:
                    reason, trip_ts = hit[1], pd.Timestamp(times[run[hit[0]]]).to_pydatetime()
        if len(x):
            equity, peak = float(levels[-1]), float(peaks[-1])
        state.update((equity, peak, history[-window:].tolist(), reason, trip_ts))
        yield pd.DataFrame(
            {
                "strategy_id": [key[0]], "ts": [rows["ts"].iloc[-1]], "tripped": [reason is not None],
                "trip_reason": [reason], "trip_ts": [pd.Timestamp(trip_ts) if trip_ts else pd.NaT], "equity": [equity],
            }
        )

    return returns.groupBy("strategy_id").applyInPandasWithState(
        advance, TRIP_OUTPUT, TRIP_STATE, "append", GroupStateTimeout.NoTimeout
    )


def live_diagnose_stream(live: DataFrame, baseline: Panel, store: str, report: str, *, window: int = 60,
                         annualization: float = 252, checkpoint: str | None = None) -> StreamingQuery:
    """Store each batch of (strategy_id, ts, net) and diagnose the strategies in it.

    A batch is stored under its id, so a batch that is run again replaces itself.
    """
    spark = live.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        seen = spark.read.parquet(store).drop("batch").join(
            batch.select("strategy_id").distinct(), "strategy_id", "left_semi"
        )
        out = live_diagnose(
            baseline, Panel(seen, keys=("strategy_id",), ts="ts", grain=baseline.grain), window=window,
            annualization=annualization,
        )
        out.write.mode("overwrite").parquet(f"{report}/batch={batch_id}")

    return (
        live.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "diagnose-state"))
        .trigger(availableNow=True).start()
    )


def decision_log(spark: SparkSession, source: str, target: str, *, keep: Callable[[DataFrame], DataFrame] | None = None,
                 checkpoint: str | None = None) -> DataFrame:
    """Copy decision records from a JSON folder to the log, each exactly once."""
    rows = spark.readStream.schema(DECISION_SCHEMA).json(source)
    rows = keep(rows) if keep else rows
    return run_available(rows, target, fmt="json", checkpoint=checkpoint)


def point_in_time_stream(prints: DataFrame, as_of, reported: str = "reported_at") -> DataFrame:
    """Rows usable at `as_of`; the same filter as in a batch."""
    return prints.filter(F.col(reported) <= as_of)
