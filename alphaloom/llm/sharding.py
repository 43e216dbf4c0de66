"""Global shuffle of records into shards by two external passes (DataFrame functions only).

Pass 1 scatters every record to a uniformly random bucket by a seeded hash; the number of
buckets follows the total size, so a bucket fits the memory of a task whatever the keys.
Pass 2 sorts each bucket by its hashes, puts it through a Fisher-Yates shuffle (Spark's
`shuffle` is one) and writes it. A bucket is one Spark partition whose number seeds the
generator, so the same table, split alike, and seed give the same order again, also when
a task is repeated. Shards are equal ranges of the concatenated buckets.

Defined results: the hash takes all columns and the row's place in its scan partition, so
NULL or repeated keys and identical rows spread like any others. A record's size is its
text's UTF-8 bytes plus 1 (NULL text: 1). Input columns keep their names and order; the
added columns avoid them by a trailing underscore. Empty tables give no rows. Counts of
shards differ by one at most, slots count from 0 without gaps.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.core.lineage import scratch_path
from alphaloom.llm.common import fresh_name

BUCKET_BYTES = 16 << 20


def record_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _hash(df: DataFrame, seed: int) -> Column:
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *plain, F.monotonically_increasing_id())


def scatter(df: DataFrame, path: str, *, text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled buckets: (bucket, place, row) under `path`."""
    total = df.agg(F.sum(record_size(text)).alias("b")).first()["b"] or 0
    # never fewer buckets than the session's partitions, so that small tables keep all cores busy
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, least, -(-total // bucket_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(_hash(df, seed).alias("h"), row.alias("row"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(n)).cast("int")
    dealt = hashed.select(bucket.alias("bucket"), "h", "row").repartitionById(n, "bucket")
    (
        dealt.groupBy("bucket").agg(F.collect_list(F.struct("h", F.struct("row").alias("x"))).alias("rows"))
        .select("bucket", F.shuffle(F.array_sort("rows", lambda a, b: _by_hash(a, b)), F.lit(seed)).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("place", "r"))
        .select("bucket", "place", "r.x.row")
        .write.parquet(path)
    )


def _by_hash(a: Column, b: Column) -> Column:
    return F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)


def shuffled(df: DataFrame, n_shards: int, *, text: str = "text", seed: int = 0,
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows in their new order: the input's columns, shard and slot."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, "buckets")
    scatter(df, path, text=text, seed=seed, bucket_bytes=bucket_bytes)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one line per bucket of bucket_bytes, so this window stays small
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = counts.select(
        F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(every).alias("total"),
    )
    # written, so that the planner knows its size and only broadcasts it while it is small
    offsets = scratch_path(spark, "offsets")
    starts.write.parquet(offsets)
    starts = spark.read.parquet(offsets)
    shard, slot = fresh_name(df, "shard"), fresh_name(df, "slot")
    at = F.col("start") + F.col("place")
    big, base = F.col("total") % n_shards, F.floor(F.col("total") / n_shards)
    # the first `big` shards hold base + 1 rows, the others base
    inside = at < big * (base + 1)
    s = F.when(inside, F.floor(at / (base + 1))).otherwise(
        big + F.floor((at - big * (base + 1)) / F.greatest(base, F.lit(1)))
    ).cast("int")
    first = F.when(F.col(shard) <= big, F.col(shard) * (base + 1)).otherwise(big + F.col(shard) * base)
    return (
        rows.join(starts, F.col("bucket") == F.col("b"))
        .withColumn(shard, s)
        .withColumn(slot, (at - first).cast("bigint"))
        .select(*[F.col("row").getField(c).alias(c) for c in df.columns], shard, slot)
    )


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; every task writes its buckets' runs in slot order."""
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
