"""Market event calendar between two dates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event labels, times and texts as downstream readers expect them.
OPEX = ("16:00", "monthly_opex", None, "Equity monthly options expire")
WITCHING = ("16:00", "triple_witching", None, "Stock options + index options + index futures expire")
VIX = ("09:00", "vix_expiration", None, "VIX futures and options settle (AM)")
NFP = ("08:30", "nfp", None, "Non-Farm Payrolls (BLS)")
COLLAR = ("15:30", "jpm_collar_roll", "SPX", "JHEQX quarterly collar roll (JPMorgan Hedged Equity Fund)")
HOLIDAY_TYPES = {"full_close": "market_holiday_full", "early_close_1pm": "market_holiday_half"}

EVENT_SCHEMA = "date date, time_et string, event_type string, ticker string, details string"


def months(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """First days of all months that touch [start, end]; one row of bounds in."""
    return bounds.select(
        start, end,
        F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"),
    )


def _friday(month: Column, nth: int) -> Column:
    """nth Friday of the month: next_day is strictly later, so start a day earlier."""
    return F.date_add(F.next_day(F.date_sub(month, 1), "FRI"), 7 * (nth - 1))


def _quarter_end(month: Column) -> Column:
    return F.month(month).isin(3, 6, 9, 12)


def _events(bounds: DataFrame, date: Column, label: tuple, keep: Column | None = None) -> DataFrame:
    time_et, kind, ticker, details = label
    m = months(bounds)
    if keep is not None:
        m = m.filter(keep)
    return m.withColumn("date", date).filter(F.col("date").between(F.col("start"), F.col("end"))).select(
        "date", F.lit(time_et).alias("time_et"), F.lit(kind).alias("event_type"),
        F.lit(ticker).cast("string").alias("ticker"), F.lit(details).alias("details"),
    )


def opex(bounds: DataFrame) -> DataFrame:
    """Third Fridays."""
    return _events(bounds, _friday(F.col("month"), 3), OPEX)


def triple_witching(bounds: DataFrame) -> DataFrame:
    """Third Fridays of quarter-end months."""
    return _events(bounds, _friday(F.col("month"), 3), WITCHING, _quarter_end(F.col("month")))


def vix_expirations(bounds: DataFrame) -> DataFrame:
    """The Wednesday before each third Friday."""
    return _events(bounds, F.date_sub(_friday(F.col("month"), 3), 2), VIX)


def payrolls(bounds: DataFrame) -> DataFrame:
    """First Fridays."""
    return _events(bounds, _friday(F.col("month"), 1), NFP)


def collar_rolls(bounds: DataFrame) -> DataFrame:
    """Last weekday of quarter-end months."""
    last = F.last_day("month")
    return _events(bounds, F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0))), COLLAR, _quarter_end(F.col("month")))


def between(df: DataFrame, bounds: DataFrame, date: str = "date") -> DataFrame:
    """Rows dated inside the one-row bounds."""
    b = bounds.select("start", "end").withColumn("_one", F.lit(1))
    return (
        df.withColumn("_one", F.lit(1)).join(b, "_one")
        .filter(F.col(date).between(F.col("start"), F.col("end"))).drop("_one", "start", "end")
    )


def load_macro(spark: SparkSession, path: str, event_type: str) -> DataFrame:
    """Release dates from CSV (date, time_et, event_type, ticker, details)."""
    df = spark.read.csv(path, header=True, schema=EVENT_SCHEMA)
    return df.withColumn("event_type", F.lit(event_type))


def load_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Market holidays from CSV (date, type, status), full and half days told apart."""
    return holidays(spark.read.csv(path, header=True, schema="date date, type string, status string"))


def holidays(df: DataFrame) -> DataFrame:
    kind = F.lit("market_holiday_full")
    for t, label in HOLIDAY_TYPES.items():
        kind = F.when(F.col("type") == t, label).otherwise(kind)
    none = F.lit(None).cast("string")
    return df.select("date", none.alias("time_et"), kind.alias("event_type"), none.alias("ticker"), F.col("status").alias("details"))


def unified(bounds: DataFrame, *extra: DataFrame, include_opex: bool = True, include_macros: bool = True,
            include_collar: bool = True) -> DataFrame:
    """Chosen sources in date order; `extra` adds loaded CSV events."""
    parts = []
    if include_opex:
        parts += [triple_witching(bounds), opex(bounds), vix_expirations(bounds)]
    if include_macros:
        parts.append(payrolls(bounds))
    if include_collar:
        parts.append(collar_rolls(bounds))
    parts += [between(e, bounds) for e in extra]
    if not parts:
        raise ValueError("no event source chosen")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("date", "event_type")
