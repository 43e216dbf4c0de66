"""Option-volatility panel and candidate trades derived from the star schema.

The tables carry no option data, so vol-like columns are computed from the bars'
range, open and volume; all windows run over real rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.lineage import checkpointed
from ..core.panel import Panel
from ..operators.relational import merge_vendor
from ..operators.signals import ConsensusOptions, universe_signal
from .tables import table, trade_bars

LOOKBACK = 52
# looser corners than the defaults: the derived series are noisier than option data
OPTS = ConsensusOptions(zones=(40.0, 60.0))


def vendor_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cores, dailies and vendor ranks keyed by (ticker, tradeDate)."""
    c = F.col
    bars = trade_bars(spark, folder).df.select(
        c("asset").alias("ticker"), c("ts").alias("tradeDate"), "open", "high", "low", "close", "volume"
    )
    keys = ["ticker", "tradeDate"]
    iv = 0.2 + 0.1 * (c("high") - c("low")) / c("close")
    cores = bars.select(
        *keys,
        iv.alias("iv30d"),
        (iv * (1 + 0.05 * (c("open") - c("close")) / c("close"))).alias("dlt25Iv30d"),
        (iv * (1 + 0.05 * (c("high") + c("low") - 2 * c("close")) / c("close"))).alias("dlt75Iv30d"),
    )
    dailies = bars.select(*keys, c("close").alias("clsPx"))
    vol = c("volume").cast("bigint")
    ranks = bars.filter(vol % 4 == 0).select(*keys, ((vol * 7) % 100).cast("double").alias("ivPct1y"))
    return cores, dailies, ranks


def option_panel(spark: SparkSession, folder: str) -> Panel:
    """Vendor columns merged per (ticker, tradeDate), made in one pass because all
    three sources here come from the same bars."""
    c = F.col
    bars = trade_bars(spark, folder).df
    iv = 0.2 + 0.1 * (c("high") - c("low")) / c("close")
    vol = c("volume").cast("bigint")
    df = bars.select(
        c("asset").alias("ticker"), c("ts").alias("tradeDate"),
        iv.alias("iv30d"),
        (iv * (1 + 0.05 * (c("open") - c("close")) / c("close"))).alias("dlt25Iv30d"),
        (iv * (1 + 0.05 * (c("high") + c("low") - 2 * c("close")) / c("close"))).alias("dlt75Iv30d"),
        c("close").alias("clsPx"),
        F.when(vol % 4 == 0, ((vol * 7) % 100).cast("double")).alias("ivPct1y"),
    )
    return Panel(df, keys=("ticker",), ts="tradeDate", grain="week")


def merged_panel(spark: SparkSession, folder: str) -> DataFrame:
    return merge_vendor(*vendor_tables(spark, folder), on=["ticker", "tradeDate"])


def signal_panel(spark: SparkSession, folder: str) -> Panel:
    """The universe signal; checkpointed, because every test on it reads it often."""
    raw = option_panel(spark, folder)
    return raw.with_df(checkpointed(universe_signal(raw, LOOKBACK)))


def candidate_trades(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate per order, in the export form: status, side, net % and a text of
    features."""
    o = table(spark, folder, "orders")
    c = F.col
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    k, cust = c("o_orderkey"), c("o_custkey")
    status = (
        F.when(c("o_orderstatus") == "F", "ACCEPTED")
        .when(c("o_orderstatus") == "O", "BLOCKED_IV")
        .when(k % 3 == 0, "BLOCKED_BUDGET")
        .when(k % 3 == 1, "BLOCKED_EARNINGS")
        .otherwise("BLOCKED_TREND")
    )
    side = lambda x: F.when(x == 0, "BULL").when(x == 1, "BEAR").otherwise("")
    flag = lambda x: F.when(x, "Y").otherwise("N")
    text = F.concat(
        F.lit("m1="), side(k % 3), F.lit("; m2="), side(cust % 3), F.lit(";stall="), flag(k % 2 == 0),
        F.lit("; divergence="), flag(cust % 5 < 2), F.lit(";iv="), (cents % 101).cast("string"),
        F.lit(";rr="), (cents % 97).cast("string"), F.lit("; put="), (cust % 100).cast("string"),
        F.lit(";call="), ((k * 7) % 100).cast("string"),
    )
    return o.select(
        k.alias("trade_id"),
        F.concat(F.lit("Brand#"), (cust % 30 + 1).cast("string")).alias("Ticker"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("Entry"),
        status.alias("Status"),
        F.when(k % 2 == 0, "BULL").otherwise("BEAR").alias("Side"),
        F.when(k % 2 == 0, "CONSENSUS SHORT").otherwise("CONSENSUS LONG").alias("Direction"),
        ((cents % 2001 - 990) / 100.0).alias("Net%"),
        text.alias("ExtraInputs"),
    )
