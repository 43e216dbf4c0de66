"""Readers and writers of the research file layouts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.schema import struct

GARBAGE = 1e15

DECISION_SCHEMA = struct(
    "timestamp timestamp, strategy_id string, symbol string, intent_position double, "
    "realized_position double, intent_price double, realized_price double, reason string, "
    "metadata map<string,string>"
)
AUDIT_SCHEMA = struct(
    "timestamp timestamp, thesis_id string, event_type string, step int, step_name string, "
    "mode string, status string, metrics map<string,string>, note string, failure_key string, "
    "reason string, computed_value string, threshold string, decision string, "
    "stopped_at_step int, question string, options array<string>, response string"
)


def price_csv(spark: SparkSession, path: str, *, date: str = "date", close: str = "close", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts, close) from a headed CSV.  Order is left to the windows that need it."""
    df = spark.read.csv(path, header=True)
    return df.select(
        *keys,
        F.col(f"`{date}`").try_cast("timestamp").alias("ts"),
        F.col(f"`{close}`").try_cast("double").alias("close"),
    )


def series_csv(spark: SparkSession, path: str, *, value: str, index: str = "ts") -> DataFrame:
    """Index column plus one or more value columns, added up per row time.

    Several columns (one per asset) collapse to their net sum per bar.
    """
    df = spark.read.csv(path, header=True)
    first, rest = df.columns[0], df.columns[1:]
    wide = df.select(F.col(f"`{first}`").try_cast("timestamp").alias(index), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rest])
    return wide.unpivot(index, rest, "column", value).groupBy(index).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias(value)
    )


def thesis_results(spark: SparkSession, folder: str, asset_returns: bool = False) -> DataFrame:
    """Positions and returns of one thesis on their common bars."""
    out = series_csv(spark, f"{folder}/positions.csv", value="position").join(
        series_csv(spark, f"{folder}/returns.csv", value="net"), "ts"
    )
    if asset_returns:
        out = out.join(series_csv(spark, f"{folder}/asset_returns.csv", value="asset_ret"), "ts", "left")
    return out


def universe_cache(spark: SparkSession, folder: str, columns: list[str] | None = None,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Day files (YYYY-MM-DD.parquet) only; files of single tickers beside them, whatever
    their columns, are never opened.

    Empty day files are holiday markers and are skipped; so are files without columns.  The
    listing has one line per day of the calendar.  Without `schema` it is the largest day's.
    """
    days = (
        spark.read.format("binaryFile").option("pathGlobFilter", "????-??-??.parquet")
        .option("recursiveFileLookup", "true").load(folder).select("path", "length").filter("length > 0")
    )
    listed = [r["path"] for r in days.orderBy(F.desc("length"), "path").collect()]
    if schema is None:
        schema = spark.read.parquet(listed[0]).schema if listed else T.StructType()
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    df = spark.read.schema(schema).parquet(*listed) if listed else spark.createDataFrame([], schema)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_day_files(rows: DataFrame, folder: str, date: str) -> None:
    """One YYYY-MM-DD.parquet per day under `folder`, renamed from Spark's part files."""
    spark = rows.sparkSession
    rows.withColumn("_day", F.date_format(date, "yyyy-MM-dd")).repartition("_day").write.partitionBy("_day").parquet(f"{folder}/_days")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in fs.listStatus(path(f"{folder}/_days")):
        name = day.getPath().getName()
        if name.startswith("_day="):
            for part in fs.listStatus(day.getPath()):
                if part.getPath().getName().endswith(".parquet"):
                    fs.rename(part.getPath(), path(f"{folder}/{name[5:]}.parquet"))
    fs.delete(path(f"{folder}/_days"), True)


def write_marker(spark: SparkSession, folder: str, day: str) -> None:
    """An empty day file: the market was closed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{day}.parquet")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path).close()


def sanitize_numeric(df: DataFrame, keep: tuple[str, ...] = ("ticker", "tradeDate"), share: float = 0.5) -> DataFrame:
    """Cast columns that are mostly numbers to DOUBLE, garbage magnitudes to NULL.

    One pass counts how much of every column parses; one row reaches the driver.
    """
    cols = [c for c in df.columns if c not in keep]
    num = lambda c: F.col(f"`{c}`").try_cast("double")
    if not cols:
        return df
    n, *good = df.agg(F.count("*"), *[F.count(num(c)) for c in cols]).first()
    out = {c: num(c) for c, g in zip(cols, good) if n and g / n >= share}
    return df.withColumns({c: F.when(F.abs(v) <= GARBAGE, v) for c, v in out.items()})


def normalize_ohlc(df: DataFrame) -> DataFrame:
    """Lower-snake column names; epoch milliseconds become a timestamp."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if "timestamp_ms" in out.columns:
        out = out.withColumn("ts", F.timestamp_millis(F.col("timestamp_ms").cast("bigint"))).drop("timestamp_ms")
    elif "date" in out.columns:
        out = out.withColumn("ts", F.col("date").try_cast("timestamp")).drop("date")
    values = [c for c in ("open", "high", "low", "close") if c in out.columns]
    return out.withColumns({c: F.col(c).try_cast("double") for c in values})


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = AUDIT_SCHEMA) -> DataFrame:
    """Log lines in a fixed schema; blank lines are no records."""
    return spark.read.schema(schema).json(path)


def write_signal(df: DataFrame, path: str, *, key: str = "ticker", ts: str = "tradeDate", buckets: int = 0) -> None:
    """The universe signal, clustered by ticker and time so readers prune row groups.

    Rows are range-partitioned on (ticker, time), which also splits a ticker that
    fills more than one file.
    """
    out = df.repartitionByRange(*([buckets] if buckets else []), key, ts).sortWithinPartitions(key, ts)
    out.write.mode("overwrite").parquet(path)


def point_in_time(df: DataFrame, as_of, reported: str = "reported_at") -> DataFrame:
    """Only what had been reported by `as_of`."""
    return df.filter(F.col(reported) <= as_of)
