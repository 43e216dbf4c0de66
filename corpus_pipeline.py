"""Cleaning and tokenising pipeline over `documents`: five stages, each a query on its predecessor's rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet in the shared folder and hands the next stage what it reads back. All but the last
return the columns of documents, and other columns beside them, whatever their names.

NULL ids are an id of their own: such rows are judged like all others, and go as copies only of
a document with an id. Rows of one doc_id share the fate of their group in jaccard_join. NULL and blank
texts go in quality_rules. Long texts are treated whole in every stage. Empty tables give empty tables.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.core.lineage import scratch_path
from alphaloom.llm import bpe, decontaminate, jaccard, linededup, quality
from alphaloom.llm.common import fresh_name, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality.ledger(docs).where(quality.passes(quality.POLICIES["web-2"])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut out; documents left without a word go. n_chars follows the text."""
    rows = linededup.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, with all rows of that doc_id."""
    d, c = fresh_name(docs, "d"), fresh_name(docs, "c")
    joined = jaccard.linked(docs).select(F.col("doc_id").alias(d), F.col("component_id").alias(c))
    # those that go are few, so their ids stay broadcastable for longer than the others'
    path = scratch_path(spark, "copies")
    stays = F.max(F.col(d).eqNullSafe(F.col(c)))
    joined.groupBy(d).agg(stays.alias("stays")).where("NOT stays").select(d).write.parquet(path)
    copies = spark.read.parquet(path)
    return docs.join(copies, F.col("doc_id").eqNullSafe(F.col(d)), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts (little-endian unsigned 32-bit integers) and digests of ids and decoded bytes."""
    rows = bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Byte-level BPE can't be written in SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
