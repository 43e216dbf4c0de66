"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.core.lineage import written
from alphaloom.llm import (
    bpe, chat, decontaminate, jaccard, lexical, licenses, linededup, pii, quality, sharding, toxicity, trie, urlfilter,
)
from alphaloom.llm.common import table

N_SHARDS = 16


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    weights = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, weights)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.detected(docs, pii.fit(docs))
    base = F.filter("spans", lambda c: c["kind"].isin(*pii.BASE))
    return rows.select(
        "doc_id", *[F.col(f"counts.{k}").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"),
    )


def op4_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled(table(spark, sf_dir, "documents"), N_SHARDS, seed=20240501)
    return rows.select(
        "doc_id", sharding.record_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


#: A conversation whose texts hold control strings.
TRAP = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat.digests(chat.formatted(rows.unionByName(trap)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "n_lines", "n_removed", "n_chunks",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encoded(docs, path, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base, best = quality.POLICIES["base-1"], quality.POLICIES["web-2"]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(base)).alias("base_failed"), quality.passes(best).alias("kept"), "failures",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules of the URL filter: a host with its subdomains, and the start of the path.
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    weights = urlfilter.fit(urlfilter.labelled_by_rules(pages, URL_RULES))
    return urlfilter.judged(pages, URL_RULES, weights).select("page_id", "host", "path", "rule", "verdict", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(trie.turns(table(spark, sf_dir, "conversations")), "numbered")
    return trie.nodes(*trie.rebuilt(own)).drop("node", "parent_node", "turn_id")


OP6_SQL = f"""
SELECT doc_id, sha256(coalesce(new_text, '')) AS text_sha256, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_removed, 0) AS n_removed, n_chunks
FROM ({linededup.repeats_sql()})"""

OP9_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       failures & {quality.POLICIES['web-2'].mask} = 0 AS kept, failures
FROM ({quality.measured_sql()})"""

OP5_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')
), marked AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
    '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])',
    '\1\3\\\2\4', 'g') AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(escaped) + 24) AS BIGINT) AS formatted_chars, FALSE AS rewrites
FROM marked GROUP BY conv_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_shuffle_shards": op4_shuffle_shards,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_ledger": op9_quality_ledger,
    "op10_decontaminate": op10_decontaminate,
    "op11_url_filters": op11_url_filters,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op5_chat_format": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_quality_ledger": OP9_SQL,
    "op10_decontaminate": decontaminate.leaks_sql(),
    "op12_lexical_search": lexical.ranked_sql(),
    "op13_prefix_trie": trie.trie_sql(),
}
