"""Ranked lexical search by norm buckets: the longest impact vectors first, buckets pruned by
Cauchy-Schwarz, coordinate bounds inside, survivors rescored in integers.

Terms are maximal runs of ASCII letters and digits and all non-ASCII characters, A-Z
lower-cased. A document's vector holds, for each term of the queries, its impact
(1000000000 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; a query's vector holds the term
weights floor(1000 ln((2N+2)/(2df+1))). The score is their inner product, in 64-bit integers.

1. Queries are taken in blocks of about `block_pairs` (item, term) pairs, so what travels with a task is
   bounded. For each block every whole document becomes one vector over the block's terms (text
   is read piece by piece). Vectors are written, range-partitioned by length, longest first;
   rows of equal length are spread by their row number.
2. The longest `head` share of vectors is searched first. Its 50th best score of each item
   is a floor for all other buckets.
3. A bucket is a run of rows inside a task, with the length l of its longest vector. It is skipped
   for an item where |item| * l lies under the item's floor. Otherwise the item's heaviest coordinates
   become its focus, as few as leave |item's rest| * l under the floor: a row without any of
   them can't reach it. The rows on the focus terms' posting lists are bounded by their
   score so far plus |item's rest| * |row's rest|, and those that still reach the floor are
   rescored over all terms in integers. Floors rise with each bucket; bounds are rounded up.
4. Tasks hand on at most `top` rows per item, which are merged in two steps.

Nothing is dropped by a cap: a floor is always the score of a top-th best known document, and
rows that equal it stay, so ties by doc_id come out right.

Defined results: each row is a document, also repeated rows; of equal scores and doc_ids any order;
NULL doc_ids come after others of their score. Rows with equal item_id are one item with the terms of all its
texts. NULL and blank texts have no terms: no rank, and no part of N and L. Only doc_id,
item_id and the texts are read, so other columns can't clash. Either table empty: no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from alphaloom.core.lineage import written

#: Bytes of terms as they are, A-Z lower-cased, all other ASCII characters as spaces.
BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
PIECE = 1 << 20  # bytes of a text that are cut into terms at once
DOCS = 256  # documents counted at once
ROWS, ENTRIES = 4096, 1 << 19  # of a bucket
FIRST_ROWS = 64  # of a task's first bucket while there is no floor yet
SLACK = 1 + 1e-9  # bounds are doubles and rounded up


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists that fit in memory."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(BYTES)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE) if lo + PIECE < len(data) else len(data)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term): distinct terms of each item."""
    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                own: set[bytes] = set()
                for part in pieces(t):
                    own.update(part)
                if own:
                    at = pa.array(np.full(len(own), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(sorted(own), pa.binary())], names=["item_id", "term"])

    return items.select("item_id", text).mapInArrow(run, schema).distinct()


def vectors(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> DataFrame:
    """(doc_id, at, n, terms, tf) of documents with a term: row number, all terms, and the
    vocabulary's numbers and counts as packed 32-bit integers."""
    number = {t: i for i, t in enumerate(vocabulary)}
    size = len(vocabulary) + 1
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("terms", T.BinaryType()), T.StructField("tf", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCS):
                batch = whole.slice(lo, DOCS)
                n = np.zeros(batch.num_rows, np.int64)
                cells, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, t in enumerate(batch.column(2).to_pylist()):
                    for part in pieces(t):
                        n[i] += len(part)
                        found = np.fromiter(map(number.get, part, repeat(-1)), np.int64, len(part))
                        c, k = np.unique(found[found >= 0], return_counts=True)
                        cells.append(i * size + c)
                        counts.append(k)
                cell, back = np.unique(np.concatenate(cells), return_inverse=True)
                tf = np.bincount(back, np.concatenate(counts), len(cell)).astype(np.uint32)
                cut = np.searchsorted(cell // size, np.arange(batch.num_rows + 1))
                term = (cell % size).astype(np.uint32)
                keep = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(n[keep]),
                     pa.array([term[cut[i] : cut[i + 1]].tobytes() for i in keep], pa.binary()),
                     pa.array([tf[cut[i] : cut[i + 1]].tobytes() for i in keep], pa.binary())],
                    names=["doc_id", "at", "n", "terms", "tf"],
                )

    return docs.select("doc_id", F.monotonically_increasing_id().alias("at"), text).mapInArrow(run, schema)


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of all packed values."""
    rows = column.to_pylist()
    sizes = np.array([len(r) // 4 for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), sizes), np.frombuffer(b"".join(rows), np.uint32).astype(np.int64)


def impacts(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, at, norm, terms, impacts): counts become impacts, and the vector's length."""
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("at", T.LongType()), T.StructField("norm", T.DoubleType()),
        T.StructField("terms", T.BinaryType()), T.StructField("impacts", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            owner, tf = _unpack(b.column(4))
            m = 50 + 50 * n * n_docs // n_terms
            p = 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])
            norm = np.sqrt(np.bincount(owner, p.astype(float) ** 2, len(n)))
            cut = np.searchsorted(owner, np.arange(len(n) + 1))
            packed = p.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(norm), b.column(3),
                 pa.array([packed[cut[i] : cut[i + 1]].tobytes() for i in range(len(n))], pa.binary())],
                names=["doc_id", "at", "norm", "terms", "impacts"],
            )

    return rows.mapInArrow(run, schema)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: every task adds up its own rows, then the tasks meet by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_unpack(b.column(0))[1], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    counted = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in counted.collect():  # a block's vocabulary at most
        out[r["term"]] = r["n"]
    return out


class Query:
    """An item's coordinates, heaviest first, and the length of what follows each of them."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.lexsort((terms, -weights))
        self.terms, self.weights = terms[order], weights[order]
        self.rest = np.sqrt(np.r_[np.cumsum(self.weights[::-1].astype(float) ** 2)[::-1], 0.0]) * SLACK


class Bucket:
    """Rows of about one length: their entries by row, and as posting lists by term."""

    def __init__(self, ids: list, norm: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.ids, self.norm2, self.size = ids, norm * norm, size
        self.longest = float(norm.max()) * SLACK
        self.keys, self.impact = owner * size + term, impact
        order = np.argsort(term, kind="stable")
        self.rows, self.by_term = owner[order], impact[order].astype(float)
        self.cut = np.searchsorted(term[order], np.arange(size + 1))

    def reach(self, q: Query, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score `floor` or more, and their exact scores."""
        focus = int(np.argmax(q.rest * self.longest < floor)) if floor else len(q.terms)
        lists = [slice(self.cut[t], self.cut[t + 1]) for t in q.terms[:focus]]
        rows = np.concatenate([self.rows[s] for s in lists])
        part = np.concatenate([self.by_term[s] for s in lists])
        weight = np.repeat(q.weights[:focus], [s.stop - s.start for s in lists])
        found, back = np.unique(rows, return_inverse=True)
        score = np.bincount(back, part * weight, len(found))
        left = np.maximum(self.norm2[found] * SLACK - np.bincount(back, part * part, len(found)), 0)
        near = found[(score + q.rest[focus] * np.sqrt(left)) * SLACK + 1 >= floor]
        wanted = near[:, None] * self.size + q.terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        exact = np.where(self.keys[at] == wanted, self.impact[at], 0) @ q.weights
        return near, exact


def _buckets(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[Bucket]:
    """Cuts the task's rows into buckets; the first has `rows` rows, later ones grow to ROWS."""
    for b in batches:
        owner, term = _unpack(b.column(3))
        impact = _unpack(b.column(4))[1]
        norm, ids = b.column(2).to_numpy(), b.column(0).to_pylist()
        cut = np.searchsorted(owner, np.arange(len(ids) + 1))
        lo = 0
        while lo < len(ids):
            hi = min(lo + rows, len(ids))
            hi = max(lo + 1, min(hi, int(np.searchsorted(cut, cut[lo] + ENTRIES, "right")) - 1))
            s = slice(cut[lo], cut[hi])
            if s.stop > s.start:
                yield Bucket(ids[lo:hi], norm[lo:hi], owner[s] - lo, term[s], impact[s], size)
            lo, rows = hi, min(ROWS, rows * 2)


def search(rows: DataFrame, item_ids: list, queries: list[Query], size: int, floors: list[int], top: int, id_field: T.StructField) -> DataFrame:
    """(item_id, doc_id, score): of each task and item at most `top` rows, all at least the floor."""
    schema = T.StructType([id_field, rows.schema["doc_id"], T.StructField("score", T.LongType())])
    lengths = np.array([q.rest[0] for q in queries])
    start = np.array(floors, np.int64)
    fields = [
        pa.field("item_id", to_arrow_type(id_field.dataType)), pa.field("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)),
        pa.field("score", pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = start.copy()
        best: list[list[tuple]] = [[] for _ in queries]
        for bucket in _buckets(batches, size, ROWS if floor.any() else FIRST_ROWS):
            for q in np.flatnonzero(lengths * bucket.longest >= np.maximum(floor, 1)).tolist():
                near, exact = bucket.reach(queries[q], int(floor[q]))
                good = np.flatnonzero(exact >= max(int(floor[q]), 1))
                if len(good) == 0:
                    continue
                ids = [bucket.ids[i] for i in near[good].tolist()]
                best[q] += [(-s, i is None, 0 if i is None else i) for s, i in zip(exact[good].tolist(), ids, strict=True)]
                best[q] = sorted(best[q])[:top]
                if len(best[q]) == top:
                    floor[q] = max(floor[q], -best[q][-1][0])
        out = [(item_ids[q], None if none else i, -s) for q, found in enumerate(best) for s, none, i in found]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])

    return rows.mapInArrow(run, schema)


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, *, text: str = "text", top: int = 50, block_pairs: int = 1 << 15,
           head: float = 0.02) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, text), "items")
    blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    result = spark.createDataFrame([], T.StructType([
        items.schema["item_id"], docs.schema["doc_id"], T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType()),
    ]))
    for k in range(blocks):
        own: dict = {}
        for r in pairs.where(block == k).collect():  # about block_pairs rows
            own.setdefault(r["item_id"], []).append(bytes(r["term"]))
        vocabulary = sorted({t for terms in own.values() for t in terms})
        if vocabulary:
            result = result.unionByName(_ranked_block(docs, items.schema["item_id"], own, vocabulary, text, top, head))
    return result.select("item_id", "rank", "doc_id", "score")


def _ranked_block(docs: DataFrame, id_field: T.StructField, own: dict, vocabulary: list[bytes], text: str, top: int, head: float) -> DataFrame:
    counted = written(vectors(docs, vocabulary, text), "vectors")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = impacts(counted, n_docs, max(n_terms, 1))
    rows = written(
        rows.repartitionByRange(F.col("norm").desc(), "at").sortWithinPartitions(F.col("norm").desc(), "at"), "impacts"
    ).where("norm > 0")
    df = document_counts(rows, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    ids, queries = [], []
    for i, terms in own.items():
        at = np.array([number[t] for t in terms], np.int64)
        at = at[(df[at] > 0) & (weights[at] > 0)]  # others add nothing to any score
        if len(at):
            ids.append(i)
            queries.append(Query(at, weights[at]))
    cut = rows.agg(F.percentile_approx("norm", 1 - head)).first()[0]
    cut = 0.0 if cut is None else cut
    size = len(vocabulary)
    first = written(search(rows.where(F.col("norm") >= cut), ids, queries, size, [0] * len(ids), top, id_field), "head")
    known = _best(first, ["item_id"], top).where(F.col("rank") == top).select("item_id", "score")
    floors = {r["item_id"]: r["score"] for r in known.collect()}  # one row per item of the block
    rest = search(rows.where(F.col("norm") < cut), ids, queries, size, [floors.get(i, 0) for i in ids], top, id_field)
    # tasks first meet in 64 groups per item, so that no task reads what all tasks hand on
    some = _best(first.unionByName(rest).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["item_id", "part"], top)
    return _best(some.drop("rank", "part"), ["item_id"], top)


def ranked_sql(docs: str = "documents", items: str = "benchmark", top: int = 50) -> str:
    """DuckDB SQL for the same rows, by scoring every pair that shares a term."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all({low}, '{term}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM {docs})
), tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT rid, sum(tf) AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS nn, sum(n) AS ll FROM size),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({low}, '{term}')) AS term FROM {items}),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (rid), total GROUP BY item_id, rid, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= {top}"""
