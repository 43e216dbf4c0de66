"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Test items are partitioned by their number of distinct shingles into powers of two. The
class of size 2^c keeps the minimum hashes below 2^(64 + 4 - c): 16 to 32 are expected in
the sketch of each of its items, all hashes for small items. A long document is probed by
all its hashes below the largest threshold in use (items of less than 32 shingles keep all their hashes, so
beside one of them that is every hash), so a short item can't drown in it, and every shared minimum makes a candidate: an item contained to 0.8 is missed with a chance
of about 0.2^16. Candidates are verified by exact containment of word shingles.

Containment is |item & document| / |item| over distinct shingles of five lower-cased
words; shorter texts are one shingle, which only equally short texts share.

Defined results: NULL and blank texts have no shingles and no matches. Rows with equal ids
give one pair with their highest containment; NULL ids match as an id of their own. Only
ids and texts are read, so other columns can't clash. Either table empty: no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.core.lineage import scratch_path
from alphaloom.llm.common import fresh_name, let, words

SHINGLE = 5
LOG_SKETCH = 4  # 2^4 minimum hashes are expected at least


def _shingles(w: Column, make) -> Column:
    """One value per five-word window; a shorter text is one window; no words give none."""
    n = F.size(w)
    whole = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make([F.get(w, i + k) for k in range(SHINGLE)]))
    short = F.array(make([F.get(w, F.lit(k)) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, whole).when(n > 0, short).otherwise(F.filter(short, lambda _: F.lit(False)))


def hashes(text: Column) -> Column:
    return let(words(F.lower(text)), lambda w: F.array_distinct(_shingles(w, lambda p: F.xxhash64(*p))))


def shingles(text: Column) -> Column:
    """Words hold no spaces, so joined words are equal only where the words are."""
    return let(words(F.lower(text)), lambda w: F.array_distinct(_shingles(w, lambda p: F.concat_ws(" ", *p))))


def _below(h: Column, bits: Column) -> Column:
    """Is the hash, taken as unsigned, below 2^(64 - bits)?"""
    return (bits == 0) | (F.call_function("shiftrightunsigned", h, (F.lit(64) - bits).cast("int")) == 0)


def leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", threshold: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): pairs with 100 * n_shared >= threshold * n_shingles."""
    spark = docs.sparkSession
    tests = items.select("item_id", F.col(text).alias("item")).distinct()
    sized = tests.select("item_id", "item", hashes(F.col("item")).alias("h"))
    bits = F.greatest(F.floor(F.log2(F.size("h"))).cast("int") - LOG_SKETCH, F.lit(0))
    sketch = (
        sized.where(F.size("h") > 0).select("item_id", bits.alias("bits"), F.explode("h").alias("h"))
        .where(_below(F.col("h"), F.col("bits")))
    )
    # written tables have a known size: the planner broadcasts them only while they are small
    path = scratch_path(spark, "sketch")
    sketch.write.parquet(path)
    sketch = spark.read.parquet(path)
    least = sketch.agg(F.min("bits")).first()[0] or 0
    # explode_outer, since the filter that explode implies would hash the texts twice
    probes = docs.select("doc_id", F.explode_outer(hashes(F.col(text))).alias("h")).where(_below(F.col("h"), F.lit(least)))
    path = scratch_path(spark, "candidates")
    probes.join(sketch.select("item_id", "h"), "h").select("doc_id", "item_id").distinct().write.parquet(path)
    near = spark.read.parquet(path).withColumnsRenamed({"doc_id": "d", "item_id": "i"})

    exact = tests.select("item_id", shingles(F.col("item")).alias("own"))
    pairs = (
        docs.select("doc_id", F.col(text).alias("text"))
        .join(near, F.col("doc_id").eqNullSafe(F.col("d")))
        .join(exact, F.col("i").eqNullSafe(F.col("item_id")))
        .select(
            "doc_id", "item_id", F.size("own").cast("bigint").alias("n_shingles"),
            F.size(F.array_intersect("own", shingles(F.col("text")))).cast("bigint").alias("n_shared"),
        )
        .where(F.col("n_shared") * 100 >= F.col("n_shingles") * threshold)
    )
    best = F.max_by(F.struct("n_shingles", "n_shared"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared"))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", threshold: int = 80) -> DataFrame:
    """The documents that contain no test item."""
    leaked = fresh_name(docs, "leaked")
    bad = leaks(docs, items, text=text, threshold=threshold).select(F.col("doc_id").alias(leaked)).distinct()
    path = scratch_path(docs.sparkSession, "leaked")
    bad.write.parquet(path)
    bad = docs.sparkSession.read.parquet(path)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")


def leaks_sql(docs: str = "documents", items: str = "benchmark", threshold: int = 80) -> str:
    """DuckDB SQL for the pairs, by exact counting."""

    def cut(table: str, key: str) -> str:
        return rf"""
  SELECT DISTINCT {key}, rid, s FROM (
    SELECT {key}, rid, unnest(CASE WHEN len(w) >= 5 THEN
             list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, row_number() OVER () AS rid,
                 regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM {table}))"""

    return f"""
WITH d AS ({cut(docs, 'doc_id')}
), i AS ({cut(items, 'item_id')}
), n AS (SELECT item_id, rid, count(*) AS n_shingles FROM i GROUP BY ALL),
hits AS (SELECT doc_id, d.rid AS dr, item_id, i.rid AS ir, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared FROM hits JOIN n USING (item_id)
WHERE n.rid = hits.ir AND n_shared * 100 >= n_shingles * {threshold}"""
