"""Quality rules as a ledger of failure bits (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one
BIGINT of failure bits; a policy is a versioned bit mask, so applying another policy, or
asking what a policy would keep without one of its rules, never reads the texts again.

Defined results: a NULL or blank text has no words, all its measurements are 0 and it
fails `few_words`. Repeated rows are measured each for itself. Columns of the input are
carried along; input columns named like a ledger column are replaced by the ledger's.
An empty table gives an empty ledger and no ablation counts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import WORD, fresh_name, let, words


@dataclass(frozen=True)
class Rule:
    """`predicate` is SQL over the measurements; `bit` never changes its meaning."""
    bit: int
    name: str
    predicate: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "long_words", "word_chars > 14 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "shouting", "n_letters >= 20 AND 100 * n_upper > 50 * n_letters"),
    Rule(7, "exclamations", "100 * n_exclamations > 30 * n_words"),
)
POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_words")),
        Policy("web-1", ("few_words", "repeated_words", "symbols", "duplicate_lines")),
        Policy("web-2", tuple(r.name for r in RULES)),
    )
}
MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper",
    "n_exclamations",
)


def repeated_words(w: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more, the first included.

    Windows without a repeat end at the hash set; else sorting brings equal windows side by side."""
    last = F.size(w) - 3
    grams = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def covered(s: Column) -> Column:
        def gram(k: Column) -> Column:
            return F.get(s, k)["gram"]

        repeats = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.coalesce(gram(k) == gram(k - 1), F.lit(False)) | F.coalesce(gram(k) == gram(k + 1), F.lit(False)),
        )
        places = F.flatten(F.transform(repeats, lambda k: let(F.get(s, k)["at"], lambda p: F.array(p, p + 1, p + 2))))
        return F.size(F.array_distinct(places))

    counted = let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at")))), covered)
        ),
    )
    return F.when(last < 1, F.lit(0)).otherwise(counted)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns, the measurements and `failures`, one bit per rule."""
    t, m = F.coalesce(F.col(text), F.lit("")), fresh_name(docs, "measured")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def measure(w: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeated_words(w),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
            "n_exclamations": F.length(F.regexp_replace(t, r"[^!]+", "")),
        }
        return F.struct(*[values[c].cast("bigint").alias(c) for c in MEASUREMENTS])

    mine = {c.lower() for c in (*MEASUREMENTS, "failures")} - {text.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine]
    # bound variables, so that a filter on the bits that is pushed below measures once too
    full = docs.select(*kept, let(words(F.col(text)), measure).alias(m))
    failures = failure_bits(m)
    return full.select(*kept, *[F.col(f"{m}.{c}").alias(c) for c in MEASUREMENTS], failures.alias("failures"))


def failure_bits(measured: str) -> Column:
    """Every rule once, over a column that is a struct of measurements."""
    bits = " | ".join(f"CASE WHEN {r.predicate} THEN {1 << r.bit}L ELSE 0L END" for r in RULES)
    bits = re.sub(r"\b(n_[a-z_]+|word_chars)\b", r"m.\1", bits)
    return F.expr(f"get(transform(array(`{measured}`), m -> {bits}), 0)")


def passes(policy: Policy) -> Column:
    """TRUE where none of the policy's rules failed."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without): documents failing the rule, failing no
    other rule of the policy, kept by the policy, and kept if the rule were dropped.

    Rows collapse to one count per bit pattern first (at most 2^rules), so nothing is skewed."""
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    mask = F.lit(policy.mask).cast("bigint")
    rules = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
        for r in RULES if r.name in policy.rules
    ]
    failed = F.col("failures").bitwiseAND(mask)
    rest = F.col("failures").bitwiseAND(mask.bitwiseAND(F.bitwise_not(F.col("bit"))))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return (
        patterns.select("failures", "n", F.explode(F.array(*rules)).alias("r")).select("failures", "n", "r.*")
        .groupBy("rule")
        .agg(
            total(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total((F.col("failures").bitwiseAND(F.col("bit")) != 0) & (rest == 0)).alias("n_only"),
            total(failed == 0).alias("n_kept"),
            total(rest == 0).alias("n_kept_without"),
        )
    )


def measured_sql(source: str = "documents", extra: str = "") -> str:
    """DuckDB SQL for (doc_id, measurements, failures) of a table."""
    bits = " + ".join(f"CASE WHEN {r.predicate} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id{extra}, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM {source}
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), measured AS (
  SELECT base.rid, doc_id{extra}, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) AS n_lines,
         len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM base LEFT JOIN repeats USING (rid)
)
SELECT doc_id{extra}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in MEASUREMENTS)},
       CAST({bits} AS BIGINT) AS failures
FROM measured"""
