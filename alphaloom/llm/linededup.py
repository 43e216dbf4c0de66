"""Removal of repeated passages by content-defined line chunks (DataFrame functions only).

Chunk borders depend on the lines around them alone, so equal runs of lines get equal chunks
wherever they stand: a line of `LONG` characters or more is a chunk of its own, a paragraph's first line begins
one, and among shorter lines a hash of the line over a window of one line decides (one in
`DIVISOR`). Blank lines belong to the chunk before them and don't count in comparisons.

1. Chunk fingerprints are counted over the corpus. Only the texts of repeated ones are fetched and compared
   byte by byte, by grouping on the text itself: equal texts are one class, named by their first
   occurrence, by doc_id, then text digest, then place.
2. Repeated chunks are extended over their neighbours: two adjacent chunks whose pair of classes occurs
   elsewhere earlier are joined, and so on along the document. A chunk that isn't joined is a run by itself if
   its class occurs earlier.
3. A run of more than `RUN_WORDS` words is cut out: its first occurrence, pair by pair, stays.

The two joins of the texts by row are merge joins at every size, so that the plan and its
disk use stay in proportion to the input. Fingerprints travel without texts. A chunk that a third of all documents
share is one group whose first occurrence is a running minimum, so it is combined before the shuffle.

Defined results: repeated lines of up to RUN_WORDS words in a run stay. Rows equal in doc_id and text
share their fate, NULL doc_ids sort first. NULL texts stay NULL, other columns are carried; n_lines, n_removed (lines) and
n_chunks replace columns of those names, in any case. Empty tables give no rows. A document whose every
chunk stands elsewhere earlier ends with an empty text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.core.lineage import written
from alphaloom.llm.common import WORD, fresh_name, let

LONG = 40  # characters, without blanks around, of a line that is a chunk of its own
DIVISOR = 2  # one border in DIVISOR shorter lines
RUN_WORDS = 50  # a repeated run of more words is cut out
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunk_starts(lines: Column, sizes: Column) -> Column:
    """First lines of the chunks."""

    def border(i: Column) -> Column:
        own, before = F.get(sizes, i), F.get(sizes, i - 1)
        begins = (own >= LONG) | (before >= LONG) | (before == 0)
        return (i == 0) | ((own > 0) & F.when(begins, True).otherwise(line_hash(F.get(lines, i)) % DIVISOR == 0))

    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), border)


def chunks(text: Column) -> Column:
    """Array of arrays of lines."""

    def pieces(lines: Column, sizes: Column) -> Column:
        return let(chunk_starts(lines, sizes), lambda s: F.transform(
            s, lambda a, k: F.slice(lines, a + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - a)
        ))

    return let(F.split(text, "\n"), lambda lines: let(
        F.transform(lines, lambda x: F.length(F.trim(x, F.lit(BLANK)))), lambda sizes: pieces(lines, sizes)
    ))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _compared(lines: Column) -> Column:
    return F.rtrim(_joined(lines), F.lit(BLANK))


def _runs(seen: DataFrame) -> DataFrame:
    """(r2, runs): the stretches of chunks to cut out of each row, from the classes of its repeated chunks."""
    along = Window.partitionBy("rid").orderBy("place")
    after = seen.withColumns({"next": F.lead("place").over(along), "k2": F.lead("kept").over(along)})
    pairs = after.where("next = place + 1").select("rid", "place", "at", F.col("kept").alias("k1"), "k2")
    first = written(pairs.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "pairs")
    again = written(pairs.join(first, ["k1", "k2"]).where("at != first").select(F.col("rid").alias("r"), F.col("place").alias("p")), "again")
    rows = seen.join(again, (F.col("rid") == F.col("r")) & (F.col("place") == F.col("p")), "left")
    rows = rows.select("rid", "place", "words", F.col("p").isNotNull().alias("paired"), (F.col("at") != F.col("kept")).alias("repeated"))
    before = F.coalesce(F.lag("paired").over(along) & (F.lag("place").over(along) == F.col("place") - 1), F.lit(False))
    rows = rows.withColumn("joins", before)
    rows = rows.where(F.col("joins") | F.col("paired") | F.col("repeated"))
    rows = rows.withColumn("run", F.sum((~F.col("joins")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("rid", "run").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.sum("words").alias("words"))
    return runs.where(F.col("words") > RUN_WORDS).groupBy(F.col("rid").alias("r2")).agg(F.collect_list(F.struct("a", "z")).alias("runs"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with cut texts, and n_lines, n_removed (lines) and n_chunks (removed) beside it."""
    own = ("n_lines", "n_removed", "n_chunks")
    kept_columns = [c for c in docs.columns if c.lower() not in own]
    docs = docs.select(*[f"`{c}`" for c in kept_columns])
    rid, r2, gone = fresh_name(docs, "rid"), fresh_name(docs, "r2"), fresh_name(docs, "gone")
    t = F.col(f"`{text}`")
    digest = F.md5(F.coalesce(t, F.lit("")))
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)))
    narrow = docs.where(t.isNotNull()).select(key.alias("rid"), F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("o"), t.alias("text"))

    # explode_outer, since the filter that explode implies would cut the texts into chunks twice
    cut = F.transform(chunks(F.col("text")), lambda c, i: let(_compared(c), lambda t: F.struct(
        i.alias("place"), F.xxhash64(t).alias("print"), (t != "").alias("holds")
    )))
    marks = narrow.select("rid", F.explode_outer(cut).alias("c")).where("c.holds").select("rid", "c.place", "c.print")
    # written, so that the join reads plain shuffles and the planner can split a fingerprint with many rows
    repeated = written(marks.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "prints")
    suspects = written(
        marks.join(repeated, "print").groupBy("rid").agg(F.array_sort(F.collect_set("place")).alias("places")), "suspects"
    )
    wanted = let(chunks(F.col("text")), lambda c: F.transform("places", lambda p: F.struct(
        p.alias("place"), _compared(F.get(c, p)).alias("text")
    )))
    texts = written(
        narrow.join(suspects.hint("merge"), "rid").select("rid", "o", F.explode_outer(wanted).alias("c"))
        .select("rid", F.struct("o", "c.place").alias("at"), "c.place", F.regexp_count("c.text", F.lit(WORD)).alias("words"), "c.text"), "texts",
    )
    first = written(
        texts.groupBy("text").agg(F.min("at").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first"
    )
    seen = written(texts.join(first, "text").select("rid", "place", "words", "at", "kept").dropDuplicates(["rid", "place"]), "classes")
    removed = written(_runs(seen), "removed").withColumnsRenamed({"r2": r2, "runs": gone})
    done = docs.withColumn(rid, key).join(removed.hint("merge"), F.col(rid) == F.col(r2), "left")
    inside = lambda i: F.exists(F.col(gone), lambda r: (r["a"] <= i) & (i <= r["z"]))
    rest = lambda c: F.filter(c, lambda x, i: ~inside(i))
    left = F.when(F.col(gone).isNotNull(), let(chunks(t), rest))
    done = done.withColumn(r2, let(left, lambda c: F.struct(
        _joined(F.flatten(c)).alias("text"), F.size(F.flatten(c)).alias("lines"),
    )))
    n_lines = F.coalesce(F.size(F.split(t, "\n")), F.lit(0))
    n_chunks = F.aggregate(F.col(gone), F.lit(0), lambda n, r: n + r["z"] - r["a"] + 1)
    cut_out = F.col(gone).isNotNull()
    return done.select(
        *[F.when(cut_out, F.col(f"{r2}.text")).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in kept_columns],
        n_lines.cast("bigint").alias("n_lines"),
        F.when(cut_out, n_lines - F.col(f"{r2}.lines")).otherwise(0).cast("bigint").alias("n_removed"),
        F.coalesce(n_chunks, F.lit(0)).cast("bigint").alias("n_chunks"),
    )


def repeats_sql(source: str = "documents", columns: str = "doc_id") -> str:
    """DuckDB SQL for (columns, new_text, n_lines, n_removed, n_chunks)."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
SELECT {columns}, CASE WHEN n_chunks = 0 THEN text ELSE array_to_string(kept, chr(10)) END AS new_text,
       n_lines, n_lines - len(kept) AS n_removed, n_chunks
FROM (
  WITH base AS (
    SELECT {columns}, text, string_split(text, chr(10)) AS ln FROM {source}
  ), counted AS (
    SELECT *, list_transform(ln, lambda x: length(trim(x, {blank}))) AS wc FROM base
  ), started AS (
    SELECT *, list_filter(range(0, len(ln)), lambda i: i = 0 OR (wc[i + 1] > 0 AND (wc[i + 1] >= {LONG} OR wc[i] >= {LONG} OR wc[i] = 0
      OR CAST('0x' || substr(md5(ln[i + 1]), 1, 8) AS BIGINT) % {DIVISOR} = 0))) AS st FROM counted
  ), pieces AS (
    SELECT doc_id, k, list_slice(ln, st[k] + 1, coalesce(st[k + 1], len(ln))) AS c
    FROM (SELECT *, unnest(range(1, len(st) + 1)) AS k FROM started)
  ), classed AS (
    SELECT *, first_value(doc_id || ':' || k) OVER w AS class, row_number() OVER w > 1 AS repeated
    FROM (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT *, rtrim(array_to_string(c, chr(10)), {blank}) AS t FROM pieces) WHERE t <> '')
    WINDOW w AS (PARTITION BY t ORDER BY doc_id, k)
  ), followed AS (
    SELECT *, lead(k) OVER w = k + 1 AS adjacent, lead(class) OVER w AS class2 FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY k)
  ), paired AS (
    SELECT *, adjacent AND row_number() OVER (PARTITION BY class, class2, adjacent ORDER BY doc_id, k) > 1 AS pair FROM followed
  ), joined AS (
    SELECT *, coalesce(lag(pair) OVER w AND lag(k) OVER w = k - 1, false) AS joins FROM paired WINDOW w AS (PARTITION BY doc_id ORDER BY k)
  ), runs AS (
    SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM joined WHERE joins OR coalesce(pair, false) OR repeated
  ), gone AS (
    SELECT doc_id, k FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM runs) WHERE total > {RUN_WORDS}
  ), judged AS (
    SELECT p.doc_id, count(g.k) AS n_chunks, flatten(coalesce(list(c ORDER BY p.k) FILTER (g.k IS NULL), [])) AS kept
    FROM pieces p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.k = p.k GROUP BY p.doc_id
  )
  SELECT {', '.join('base.' + c.strip() for c in columns.split(','))}, text, len(ln) AS n_lines, kept, n_chunks
  FROM base JOIN judged USING (doc_id)
)"""
