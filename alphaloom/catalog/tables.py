"""Queries over sources and sinks, relational steps and streams."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.lineage import checkpointed, scratch_path
from ..operators import relational as rel
from ..operators import splits as sp
from ..plans import options as op
from ..plans import strategies as st
from ..plans.tables import hourly_ticks, table, trade_bars
from ..sources import files as fs
from ..streaming import jobs
from .base import query
from .chance import CAND, RAW, UNIVERSE
from .running import DIAGNOSIS, FILLS, UNIFIED, bounds, macro_sources
from ..operators import calendar as cal
from ..plans.trials import fills, ledger_events
from .sqltext import BARS, BASKETS, HOURLY, RETS, SIGNALS, STRAT, book_sql, with_

BASE = with_(BARS, RETS, SIGNALS, STRAT)

# --- sources and sinks: each query writes what Spark derives from the tables into a new
# path in the shared folder and reads it back -------------------------------------------


@query("scan_price_csv", keys="asset ts", nums="close", sql=with_(BARS) + "SELECT asset, CAST(ts AS TIMESTAMP) AS ts, close FROM bars")
def _(spark, sf):
    path = scratch_path(spark, "prices")
    bars = trade_bars(spark, sf).df
    bars.select("asset", F.col("ts").alias("Date"), F.col("close").alias("Close")).write.csv(path, header=True)
    return fs.price_csv(spark, path, date="Date", close="Close", keys=("asset",))


@query("scan_thesis_results", keys="strategy_id ts", nums="position net", sql=with_(BARS, RETS, SIGNALS, BASKETS, book_sql("basket_pos")) + """
SELECT strategy_id, CAST(ts AS TIMESTAMP) AS ts, pos AS position, net FROM (
    SELECT strategy_id, ts, coalesce(sum(position), 0) AS pos FROM basket_pos GROUP BY 1, 2)
JOIN book USING (strategy_id, ts)""")
def _(spark, sf):
    rows = st.signal_rows(spark, sf)
    pos, net = checkpointed(st.basket_positions(rows)), checkpointed(st.basket_returns(rows).df)
    # the layout: one folder per thesis, one column per asset
    names = sorted(r["asset"] for r in pos.select("asset").distinct().collect())
    parts = []
    for (book,) in pos.select("strategy_id").distinct().orderBy("strategy_id").collect():
        folder = scratch_path(spark, "thesis")
        mine = F.col("strategy_id") == book
        pos.filter(mine).groupBy("ts").pivot("asset", names).agg(F.max("position")).toDF(
            "ts", *[n.replace("#", "_") for n in names]
        ).write.csv(f"{folder}/positions.csv", header=True)
        net.filter(mine).select("ts", "net").write.csv(f"{folder}/returns.csv", header=True)
        parts.append(fs.thesis_results(spark, folder).withColumn("strategy_id", F.lit(book)))
    return reduce(DataFrame.unionByName, parts)


@query("scan_universe_cache", keys="ticker tradeDate", nums="clsPx", sql=with_(BARS) + """
SELECT asset AS ticker, ts AS tradeDate, close AS clsPx FROM bars""")
def _(spark, sf):
    folder = scratch_path(spark, "cache")
    rows = op.option_panel(spark, sf).df.select("ticker", "tradeDate", "clsPx")
    fs.write_day_files(rows, folder, "tradeDate")
    # an empty holiday marker and a ticker's stale file with other types
    fs.write_marker(spark, folder, "1970-01-01")
    rows.select("ticker", F.col("clsPx").cast("string")).write.parquet(f"{folder}/Brand_1")
    return fs.universe_cache(spark, folder, ["ticker", "tradeDate", "clsPx"])


@query("sanitize_numeric", keys="o_orderpriority", ints="o_orderkey", nums="price priority_mix", sql="""
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS priority_mix FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = o.select(
        k.cast("string").alias("o_orderkey"), "o_orderpriority",
        F.when(k % 50 == 0, "1e18").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("priority_mix"),
    )
    return fs.sanitize_numeric(raw)


@query("normalize_dvol_csv", keys="ts asset", nums="open high low close", sql=with_(HOURLY) + "SELECT ts, asset, open, high, low, close FROM hourly")
def _(spark, sf):
    path = scratch_path(spark, "dvol")
    t = hourly_ticks(spark, sf).df
    t.select(
        F.unix_millis("ts").alias("Timestamp MS"), F.col("asset").alias("Asset"),
        F.col("open").alias("Open"), F.col("high").alias(" High"), F.col("low").alias("Low "), F.col("close").alias("CLOSE"),
    ).write.csv(path, header=True)
    return fs.normalize_ohlc(spark.read.csv(path, header=True))


def decision_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("strategy_id"),
        F.col("event_type").alias("symbol"), F.col("value").alias("intent_position"), (F.col("value") / 2).alias("realized_position"),
        F.lit(1.0).alias("intent_price"), F.lit(1.0).alias("realized_price"), F.lit("signal").alias("reason"),
        F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("metadata"),
    )


@query("read_jsonl_log", keys="strategy_id symbol event_id", nums="intent_position realized_position", sql="""
SELECT 'u' || user_id AS strategy_id, event_type AS symbol, CAST(event_id AS VARCHAR) AS event_id, value AS intent_position, value / 2 AS realized_position FROM events""")
def _(spark, sf):
    path = scratch_path(spark, "decisions")
    fs.append_jsonl(decision_rows(spark, sf), path)
    return fs.read_jsonl(spark, path, fs.DECISION_SCHEMA).withColumn("event_id", F.col("metadata")["event_id"])


def audit_rows(spark, sf):
    """Pipeline events of the ledger: a record completes a step, an override is applied, a deployment ends the run."""
    e = ledger_events(spark, sf)
    kind, only = F.col("kind"), lambda k, c: F.when(F.col("kind") == k, c)
    return e.select(
        F.col("created_at").alias("timestamp"), F.col("hypothesis_id").alias("thesis_id"),
        F.when(kind == "record", "step_complete").when(kind == "override", "override_applied").otherwise("pipeline_complete").alias("event_type"),
        only("record", (F.col("seq") % 9 + 1).cast("int")).alias("step"), only("record", F.when(F.col("accepted"), "pass").otherwise("fail")).alias("status"),
        only("record", F.create_map(F.lit("sharpe_ratio"), F.get_json_object("metrics_json", "$.sharpe_ratio"))).alias("metrics"),
        F.col("failure").alias("failure_key"), "reason", only("deploy", F.col("status")).alias("decision"), F.col("seq").cast("string").alias("note"),
    )


@query("read_audit_log", keys="thesis_id event_type status failure_key decision", ints="seq step", nums="sharpe", sql="""
SELECT o_orderkey AS seq, 'H' || o_custkey AS thesis_id, CASE WHEN k < 5 THEN 'step_complete' WHEN k < 7 THEN 'override_applied' ELSE 'pipeline_complete' END AS event_type,
  CASE WHEN k < 5 THEN o_orderkey % 9 + 1 END AS step, CASE WHEN k < 5 THEN CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END END AS status,
  CASE WHEN k < 5 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 401 AS DOUBLE) END AS sharpe, CASE WHEN k >= 5 AND k < 7 THEN o_orderpriority END AS failure_key,
  CASE WHEN k >= 7 THEN (['paper', 'live', 'retired', 'archived'])[CAST(o_custkey % 4 AS INTEGER) + 1] END AS decision
FROM (SELECT *, o_orderkey % 10 AS k FROM orders)""")
def _(spark, sf):
    path = scratch_path(spark, "audit")
    fs.append_jsonl(audit_rows(spark, sf), path)
    return fs.read_jsonl(spark, path).withColumns({"seq": F.col("note").cast("bigint"), "sharpe": F.col("metrics")["sharpe_ratio"].cast("double")})


@query("append_jsonl_log", keys="symbol", ints="n", sql="SELECT event_type AS symbol, 2 * count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "decisions")
    for _i in range(2):
        fs.append_jsonl(decision_rows(spark, sf), path)
    return fs.read_jsonl(spark, path, fs.DECISION_SCHEMA).groupBy("symbol").agg(F.count("*").alias("n"))


@query("write_signal_parquet", keys="ticker tradeDate", nums="skew sigma putP", sql=with_(BARS, RAW, UNIVERSE) + "SELECT ticker, tradeDate, skew, sigma, putP FROM universe")
def _(spark, sf):
    path = scratch_path(spark, "signal")
    fs.write_signal(op.signal_panel(spark, sf).df, path)
    return spark.read.parquet(path)


# --- relational steps ----------------------------------------------------------------------


@query("join_inner_align", keys="asset ts", nums="a b", sql=BASE + """
SELECT substr(a.strategy_id, 5) AS asset, ts, a.net AS a, b.net AS b FROM strat a JOIN strat b USING (ts)
WHERE a.strategy_id LIKE 'mom:%' AND b.strategy_id = 'rev:' || substr(a.strategy_id, 5)""")
def _(spark, sf):
    """Momentum against reversion of every asset."""
    rows = st.strategy_returns(st.signal_rows(spark, sf)).df
    one = lambda kind, n: rows.filter(F.col("strategy_id").startswith(kind)).select(
        F.substring("strategy_id", 5, 1_000_000).alias("asset"), "ts", F.col("net").alias(n)
    )
    return rel.align(one("mom:", "a"), one("rev:", "b"), ["asset", "ts"])


@query("join_left_merge", keys="ticker tradeDate", nums="iv30d dlt25Iv30d dlt75Iv30d clsPx ivPct1y", sql=with_(BARS, RAW) +
       "SELECT ticker, tradeDate, iv30d, dlt25Iv30d, dlt75Iv30d, clsPx, ivPct1y FROM raw")
def _(spark, sf):
    return op.merged_panel(spark, sf)


@query("join_semi_isin", keys="ticker tradeDate", sql=with_(BARS, CAND) + """
SELECT asset AS ticker, ts AS tradeDate FROM bars WHERE asset IN (SELECT ticker FROM export WHERE status = 'BLOCKED_BUDGET')""")
def _(spark, sf):
    trades = op.candidate_trades(spark, sf).filter("Status = 'BLOCKED_BUDGET'").select(F.col("Ticker").alias("ticker"))
    return rel.occurring(op.option_panel(spark, sf).df, trades, ["ticker"])


@query("join_anti_missing", keys="ticker", ints="trade_id", sql=with_(BARS, CAND) + """
SELECT ticker, trade_id FROM export e WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = e.ticker AND b.ts = e.entry)""")
def _(spark, sf):
    trades = op.candidate_trades(spark, sf).select(
        F.col("Ticker").alias("ticker"), F.col("Entry").alias("tradeDate"), "trade_id"
    )
    return rel.missing(trades, op.option_panel(spark, sf).df, ["ticker", "tradeDate"])


@query("join_asof_latest", keys="symbol ship_date effective_date", ints="o_orderkey", nums="o_totalprice", sql="""
SELECT symbol, ship_date, r.effective_date, r.o_orderkey, r.o_totalprice FROM
  (SELECT DISTINCT 'C' || (l_suppkey % 20) AS symbol, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem) t
ASOF LEFT JOIN (SELECT 'C' || (o_custkey % 20) AS symbol, CAST(o_orderdate AS DATE) AS effective_date, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) r
USING (symbol, ship_date) """.replace("USING (symbol, ship_date) ", "ON t.symbol = r.symbol AND t.ship_date >= r.effective_date").replace("SELECT symbol,", "SELECT t.symbol,", 1))
def _(spark, sf):
    targets = table(spark, sf, "lineitem").select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("ship_date")
    ).distinct()
    records = table(spark, sf, "orders").groupBy(
        F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("effective_date")
    ).agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    return rel.asof_latest(
        targets, records, at="ship_date", effective="effective_date", by=["symbol"], values=["o_orderkey", "o_totalprice"]
    )


@query("join_range_event_window", keys="asset ts", sql=with_(BARS) + """
SELECT asset, ts FROM bars b WHERE EXISTS (SELECT 1 FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) e WHERE b.ts BETWEEN e.d - 3 AND e.d + 3)""")
def _(spark, sf):
    events = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return rel.within_event_window(trade_bars(spark, sf).df, events, ts="ts", date="d")


@query("dedup_keep_first", ints="l_orderkey l_linenumber l_partkey", nums="l_extendedprice", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_extendedprice) = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return rel.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"])


@query("union_sources", keys="date event_type", sql="SELECT date, event_type FROM (" + UNIFIED + ")")
def _(spark, sf):
    b = bounds(spark, sf)
    return rel.union_sources(
        cal.opex(b), cal.triple_witching(b), cal.vix_expirations(b), cal.payrolls(b), cal.collar_rolls(b), *macro_sources(spark, sf)
    )


@query("topk_recent", ints="o_orderkey", nums="o_totalprice", sql="""
SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)""")
def _(spark, sf):
    return rel.latest(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 25, ascending_output=True)


@query("groupby_agg_named", keys="symbol", ints="n_fills", nums="total_quantity mean_price worst best", sql=with_(FILLS) + """
SELECT symbol, count(*) AS n_fills, sum(quantity) AS total_quantity, avg(fill_price) AS mean_price, min(fill_price) AS worst, max(fill_price) AS best FROM fills GROUP BY 1""")
def _(spark, sf):
    return fills(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("n_fills"), F.sum("quantity").alias("total_quantity"), F.avg("fill_price").alias("mean_price"),
        F.min("fill_price").alias("worst"), F.max("fill_price").alias("best"),
    )


@query("filter_predicates", keys="o_orderstatus", ints="o_orderkey", nums="o_totalprice", sql="""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice <= 400000 AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "orders").filter(
        (c("o_orderstatus") == "F") & c("o_totalprice").between(1000, 400000) & (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    )


# --- streams ------------------------------------------------------------------------------


def event_stream(spark, sf):
    """The event table as a file stream; timestamps become instants for the watermark."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


@query("stream_metrics_window", keys="window_start event_type", ints="n", nums="total min max", sql="""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, sum(value) AS total, min(value) AS min, max(value) AS max
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    """Also the last windows, which no later event closes."""
    out = jobs.window_metrics(event_stream(spark, sf), by=["event_type"])
    return jobs.run_to_the_end(out, scratch_path(spark, "windows"), ["window_start", "event_type"])


@query("stream_point_in_time", keys="event_type", ints="event_id", nums="value", sql="""
SELECT event_id, event_type, value FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15'""")
def _(spark, sf):
    prints = event_stream(spark, sf).withColumn("reported_at", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    as_of = F.lit("2024-01-15").cast("timestamp")
    return jobs.run_available(jobs.point_in_time_stream(prints, as_of), scratch_path(spark, "prints"))


@query("pit_filter", keys="event_type", ints="event_id", nums="value", sql="""
SELECT event_id, event_type, value FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15'""")
def _(spark, sf):
    prints = table(spark, sf, "events").withColumn("reported_at", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return fs.point_in_time(prints, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("stream_decision_log", keys="symbol", ints="n", nums="total", sql="""
SELECT event_type AS symbol, count(*) AS n, sum(value) AS total FROM events GROUP BY 1""")
def _(spark, sf):
    source = scratch_path(spark, "decisions-in")
    fs.append_jsonl(decision_rows(spark, sf), source)
    log = jobs.decision_log(spark, source, scratch_path(spark, "decisions-log"))
    return log.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("intent_position").alias("total"))


def returns_stream(spark, sf):
    """Strategy returns written once and read back as a stream."""
    path = scratch_path(spark, "returns")
    rows = st.strategy_returns(st.signal_rows(spark, sf)).df.filter("net IS NOT NULL").select(
        "strategy_id", F.col("ts").cast("timestamp").alias("ts"), "net"
    )
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stream_kill_switch", keys="strategy_id trip_reason", bools="tripped", nums="equity", sql=BASE + """
SELECT strategy_id, bool_or(dd) AS tripped, CASE WHEN bool_or(dd) THEN arg_min(reason, ts) FILTER (dd) END AS trip_reason, product(1 + net) AS equity FROM (
  SELECT *, reason IS NOT NULL AS dd FROM (SELECT strategy_id, ts, net, CASE WHEN equity / nullif(peak, 0) - 1 <= -0.95 THEN 'drawdown>95.00%' WHEN net <= -0.9 THEN 'daily_loss>90.00%' END AS reason
  FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS peak FROM (
    SELECT *, product(1 + net) OVER (PARTITION BY strategy_id ORDER BY ts) AS equity FROM strat WHERE net IS NOT NULL)))) GROUP BY 1""")
def _(spark, sf):
    out = jobs.kill_switch_stream(returns_stream(spark, sf), max_drawdown=0.95, max_loss=0.9)
    return jobs.run_available(out, scratch_path(spark, "trips"))


@query("stream_live_diagnose", keys="strategy_id status flags", ints="n_live_observations", nums="live_sharpe baseline_sharpe", sql=DIAGNOSIS)
def _(spark, sf):
    p = st.strategy_returns(st.signal_rows(spark, sf))
    rows = sp.counted(p.with_df(p.df.filter("net IS NOT NULL"))).select(
        "strategy_id", F.col("ts").cast("timestamp").alias("ts"), "net", "rn", "n"
    )
    early = F.col("rn") < F.floor(0.7 * F.col("n"))
    path = scratch_path(spark, "live-in")
    rows.filter(~early).drop("rn", "n").write.parquet(path)
    live = spark.readStream.schema("strategy_id string, ts timestamp, net double").parquet(path)
    base = p.with_df(checkpointed(rows.filter(early).drop("rn", "n")))
    store, report = scratch_path(spark, "live"), scratch_path(spark, "diagnosis")
    jobs.live_diagnose_stream(live, base, store, report, annualization=st.WEEKS).awaitTermination()
    return spark.read.parquet(report)
