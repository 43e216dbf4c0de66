"""Fills, greeks and ledger events derived from the star schema."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import EVENT_SCHEMA
from .tables import table


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """One fill per line item; discount and tax move the price away from arrival."""
    c = F.col
    unit = lambda f: c("l_extendedprice") * f / c("l_quantity")
    return table(spark, folder, "lineitem").filter("l_quantity > 0").select(
        F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("symbol"),
        F.when(c("l_returnflag") == "R", -1).otherwise(1).alias("side"),
        c("l_quantity").alias("quantity"),
        c("l_shipdate").alias("timestamp"),
        unit(1 - c("l_discount")).alias("fill_price"),
        unit(1 - c("l_tax")).alias("arrival_price"),
        (c("l_extendedprice") / c("l_quantity")).alias("decision_price"),
    )


def _cents():
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def greek_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A greeks row per order: (hypothesis_id, ts, k, delta, gamma, vega, theta)."""
    x = _cents()
    return table(spark, folder, "orders").select(
        F.concat(F.lit("H"), F.col("o_custkey").cast("string")).alias("hypothesis_id"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("k"),
        ((x % 201 - 100) / 10.0).alias("delta"), ((x % 37 - 18) / 100.0).alias("gamma"),
        (x % 4001 - 2000).cast("double").alias("vega"), (-(x % 53) / 10.0).alias("theta"),
    )


def ledger_events(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger event per order: half of them records, the rest overrides and
    deployments; some stored return texts are broken."""
    k, cust, x = F.col("o_orderkey"), F.col("o_custkey"), _cents()
    acc = F.col("o_orderstatus") == "F"
    kind = F.when(k % 10 < 5, "record").when(k % 10 < 7, "override").otherwise("deploy")
    only = lambda name, c: F.when(kind == name, c)
    text = F.when(k % 17 == 0, "{bad").otherwise(
        F.concat(F.lit('{"index":["1995-01-02","1995-01-09"],"values":['), (x % 11).cast("string"), F.lit(","), (x % 7).cast("string"), F.lit("]}"))
    )
    stat = F.element_at(F.array(*[F.lit(s) for s in ("paper", "live", "retired", "archived")]), (cust % 4 + 1).cast("int"))
    df = table(spark, folder, "orders").select(
        k.alias("seq"),
        F.concat(F.lit("H"), cust.cast("string")).alias("hypothesis_id"),
        kind.alias("kind"),
        only("record", F.concat(F.lit("Hypothesis "), cust.cast("string"))).alias("hypothesis_text"),
        F.lit(None).cast("string").alias("rationale"),
        F.lit(None).cast("string").alias("code"),
        only("record", F.concat(F.lit('{"sharpe_ratio": '), (x % 401).cast("string"), F.lit("}"))).alias("metrics_json"),
        only("record", acc).alias("accepted"),
        only("record", F.when(~acc, F.concat(F.lit("gate_"), F.col("o_orderstatus")))).alias("rejection_reason"),
        only("record", text).alias("returns_json"),
        only("record", F.when(x % 2 == 0, "options").otherwise("equity")).alias("market_type"),
        only("deploy", (x % 4).cast("double") / 2).alias("size_multiplier"),
        only("deploy", stat).alias("status"),
        only("override", F.col("o_orderpriority")).alias("failure"),
        only("override", F.lit("manual")).alias("reason"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])
