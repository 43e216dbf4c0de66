"""Conversation prefix trie by burst tries.

A node is a distinct sequence of first d turns (role, text) of the conversations; those that
start with it are its members. Turns are named by digests, prefixes by two 64-bit sums
(exclusive or) of position-bound turn hashes, so a prefix is named without its history at hand.

1. Turns are numbered per conversation by the range-partitioned ranks of `core.ranks`, and prefixes named
   in segments of `SEGMENT` turns, so a conversation with a third of all rows spreads. Equal sequences
   become one suffix with a weight.
2. Each shard holds suffix containers under trie heads. The first container is the whole
   trie's. A container with more than `container` turns bursts by its next turn id, then by the next two,
   four, ... at once: its turns up to there become heads, its suffixes move to the containers below. All levels
   are sized in one grouping; a suffix goes down to the first level whose container isn't oversized. So
   every container is bounded, also under a long conversation or a first turn that all share.
3. Heads are grouped by name, with sums before the shuffle. Each remaining container is
   sorted and swept: the open path is kept on a stack, and a node is done when it is left.
4. Sums over the subtrees of heads come from pointer doubling: log2(depth) rounds, each written.
5. A node's ended conversations are range-partitioned and packed into strings of up to a batch of
   ids, which are hashed in order as a stream: no list of a node's ids is ever held.

Defined results: NULL roles and texts are empty texts; NULL turns come first, and rows of a conversation that are
equal in `turn` are ordered by the digest of role and text; repeated rows are turns of their own.
Rows with NULL conv_id belong to no conversation and are left out. Only the four columns are
read, so other columns can't clash. No conversation: no rows, not even the root.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.core.lineage import written
from alphaloom.core.ranks import positions
from alphaloom.llm.common import words

SEGMENT = 4096  # turns of a conversation whose prefixes are named in one window
REPEATS = 4096  # equal rows that are numbered at once
NODE = ["depth", "k1", "k2"]


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, n, turn_id, words): place from 1, number of the conversation's turns, digest of role
    and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = rows.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"),
        F.size(words(text)).cast("bigint").alias("words"),
    )
    at = positions(named, ["conv_id"], F.struct("turn", "turn_id", "words"))
    some = at.select(
        "conv_id", "_lt", "_eq", F.col("_n").alias("n"), "_v.turn_id", "_v.words",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_eq") - 1, F.lit(REPEATS).cast("bigint"))).alias("r"),
    )
    last = F.least(F.col("_eq"), F.col("r") + REPEATS)
    return some.select(
        "conv_id", F.explode(F.sequence(F.col("_lt") + F.col("r") + 1, F.col("_lt") + last)).alias("pos"), "n", "turn_id", "words"
    )


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of c - c % group in place of its own first h,
    h = crc32(c) % most: (turns, conversations). The remainder of a negative c is negative, as in SQL."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = own.where("pos = 1").select("conv_id", F.col("n"), base.alias("base"), h.alias("h"))
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("b"), F.col("n").alias("have"))
    borrowed = F.least(F.col("h"), F.coalesce("have", F.lit(0)))
    rest = (
        own.withColumns({"h": h, "base": base}).where("pos > h").join(bases, F.col("base") == F.col("b"), "left")
        .select("conv_id", (F.col("pos") - F.col("h") + borrowed).alias("pos"), "turn_id", "words")
    )
    heads = own.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(
        F.col("conv_id").alias("b"), "pos", "turn_id", "words"
    )
    first = convs.join(heads, F.col("base") == F.col("b")).where("pos <= h").select("conv_id", "pos", "turn_id", "words")
    return rest.unionByName(first), convs.select("conv_id")


def _named(rows: DataFrame) -> DataFrame:
    """Adds each prefix's name k1, k2 and its parent's p1, p2."""
    z = {"z1": F.xxhash64("turn_id", "pos"), "z2": F.xxhash64("pos", "turn_id", F.lit("second"))}
    rows = rows.withColumns(z | {"seg": F.floor((F.col("pos") - 1) / SEGMENT)})
    upto = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    long = rows.where(F.col("pos") > SEGMENT).select("conv_id").distinct()
    sums = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "seg").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = written(sums.select(
        F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.bit_xor("c1").over(earlier).alias("c1"), F.bit_xor("c2").over(earlier).alias("c2")
    ).where("s > 0"), "carry")
    local = rows.withColumns({"k1": F.bit_xor("z1").over(upto), "k2": F.bit_xor("z2").over(upto)})
    both = local.join(carry, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s")), "left")
    full = lambda k, c: F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0).cast("bigint")))
    both = both.withColumns({"k1": full("k1", "c1"), "k2": full("k2", "c2")})
    return both.select(
        "conv_id", "pos", "turn_id", "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"),
    )


def _plan(rows: DataFrame, ends: DataFrame, container: int) -> DataFrame:
    """(conv_id, n, burst, c1, c2): one suffix of each distinct sequence, its weight, how many of its turns are heads,
    and the container of the others."""
    one = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    # containers can begin at depth 0, 1, 3, 7, 15, ...
    marks = rows.where(F.col("pos").bitwiseAND(F.col("pos") + 1) == 0).select(
        F.col("conv_id").alias("m"), F.col("pos").alias("level"), F.col("k1").alias("l1"), F.col("k2").alias("l2")
    )
    zero = F.lit(0).cast("bigint")
    top = one.select("conv_id", "depth", "n", zero.alias("level"), zero.alias("l1"), zero.alias("l2"))
    below = one.join(marks, F.col("conv_id") == F.col("m")).select("conv_id", "depth", "n", "level", "l1", "l2")
    levels = written(top.unionByName(below), "levels")
    over = written(
        levels.groupBy("level", "l1", "l2").agg(F.sum(F.col("depth") - F.col("level")).alias("turns")).where(F.col("turns") > container)
        .select(F.col("level").alias("o"), F.col("l1").alias("o1"), F.col("l2").alias("o2")), "oversized",
    )
    same = (F.col("level") == F.col("o")) & (F.col("l1") == F.col("o1")) & (F.col("l2") == F.col("o2"))
    fits = F.when(F.col("o").isNull(), F.struct("level", "l1", "l2"))
    chosen = levels.join(over, same, "left").groupBy("conv_id").agg(F.first("n").alias("n"), F.first("depth").alias("depth"), F.min(fits).alias("f"))
    return chosen.select("conv_id", "n", F.coalesce("f.level", "depth").alias("burst"), F.col("f.l1").alias("c1"), F.col("f.l2").alias("c2"))


class _Node:
    __slots__ = ("key", "row", "words", "n", "least", "leaves", "saved", "children")

    def __init__(self, key: tuple, row: int, n_words: int):
        self.key, self.row, self.words = key, row, n_words
        self.n = self.leaves = self.saved = 0
        self.least: int | None = None
        self.children: list[_Node] = []

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def _sweep(suffixes: list[tuple]) -> tuple[_Node, list[tuple[_Node, int | None]]]:
    """Sorts the suffixes of a container, (names, conversation, weight, words, rows), and sweeps them
    into nodes, each with its parent's conversation (None: the container's head)."""
    head = _Node((), -1, 0)
    path, done = [head], []

    def leave(keep: int) -> None:
        while len(path) > keep:
            node, above = path.pop(), path[-1]
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            above.add(node.n, node.least)
            above.leaves += node.leaves
            above.saved += node.saved
            above.children.append(node)
            done.extend((child, node.least) for child in node.children)

    for names, conv, weight, n_words, rows in sorted(suffixes):
        same = 0
        while same < len(names) and same + 1 < len(path) and path[same + 1].key == names[same]:
            same += 1
        leave(same + 1)
        for k in range(same, len(names)):
            path.append(_Node(names[k], rows[k], n_words[k]))
        path[-1].add(weight, conv)
    leave(1)
    done.extend((child, None) for child in head.children)
    return head, done


FIELDS = ["depth", "k1", "k2", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "turn_id", "head"]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container, conversation and place become nodes, and a row of sums for each container's head."""
    schema = pa.schema([pa.field(f, pa.binary() if f == "turn_id" else pa.bool_() if f == "head" else pa.int64()) for f in FIELDS])
    here: tuple | None = None
    held: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        suffixes: list[tuple] = []
        conv = None
        for i, r in enumerate(held):
            if r[0] != conv:
                conv = r[0]
                suffixes.append(([], conv, r[7], [], []))
            names, _, _, n_words, rows = suffixes[-1]
            names.append((r[2], r[3]))
            n_words.append(r[6])
            rows.append(i)
        head, done = _sweep(suffixes)
        out.append((*here, None, None, None, None, head.n, len(head.children), head.leaves, head.saved, None, True))
        for node, parent in done:
            r = held[node.row]
            out.append((r[1], r[2], r[3], r[4], r[5], node.least, parent, node.n, len(node.children), node.leaves, node.saved, r[8], False))
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in FIELDS]
        made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return made

    for b in batches:
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        for burst, c1, c2, *row in rows:
            if (burst, c1, c2) != here:
                if held:
                    close()
                here = (burst, c1, c2)
            held.append(tuple(row))
        yield batch()
    if held:
        close()
    yield batch()


def _containers(rows: DataFrame) -> DataFrame:
    long, kind = T.LongType(), {"turn_id": T.BinaryType(), "head": T.BooleanType()}
    schema = T.StructType([T.StructField(f, kind.get(f, long)) for f in FIELDS])
    sent = rows.select("burst", "c1", "c2", "conv_id", "pos", "k1", "k2", "p1", "p2", "words", "n", "turn_id")
    return sent.repartition("burst", "c1", "c2").sortWithinPartitions("burst", "c1", "c2", "conv_id", "pos").mapInArrow(_swept, schema)


def _summed(heads: DataFrame, depth: int) -> DataFrame:
    """Adds to n_leaves and saved of each head what its descendants among the heads have: in round r a
    head's sums cover the descendants less than 2^r below it."""
    up = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    now = heads.withColumn("up", up)
    reach = 1
    while reach <= depth:
        given = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        given = given.select(*[F.col(f"up.{c}").alias(f"g_{c}") for c in NODE], "more_leaves", "more_saved")
        further = now.where("up IS NOT NULL").select(*[F.col(c).alias(f"u_{c}") for c in NODE], F.col("up").alias("upper"))
        same = lambda left, right: (F.col(f"{left}depth") == F.col(f"{right}depth")) & (F.col(f"{left}k1") == F.col(f"{right}k1")) & (F.col(f"{left}k2") == F.col(f"{right}k2"))
        added = now.join(given, same("", "g_"), "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
        })
        now = written(added.join(further, same("up.", "u_"), "left").select(*heads.columns, F.col("upper").alias("up")), "heads")
        reach *= 2
    return now.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): SHA-256 of each node's ended conversations, ascending and joined by commas."""
    key = T.StructType([T.StructField(c, T.LongType()) for c in NODE])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            stop = np.r_[new[1:], b.num_rows]
            ids = cols[3].tolist()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[new]) for c in cols), pa.array([",".join(map(str, ids[a:z])) for a, z in zip(new, stop, strict=True)], pa.string())],
                names=[*NODE, "conv_id", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[0][i] for r in out], pa.int64()) for i in range(3)]
            made = pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in out], pa.string())], names=[*NODE, "sha"])
            out.clear()
            return made

        for b in batches:
            for *node, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node == here:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        out.append((here, state.hexdigest()))
                    here, state = node, hashlib.sha256(ids.encode())
            yield batch()
        if state is not None:
            out.append((here, state.hexdigest()))
        yield batch()

    order = [*NODE, "conv_id"]
    some = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        packed, T.StructType([*key.fields, T.StructField("conv_id", T.LongType()), T.StructField("ids", T.StringType())])
    )
    return some.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, T.StructType([*key.fields, T.StructField("sha", T.StringType())]))


def nodes(rows: DataFrame, convs: DataFrame, *, container: int = 256) -> DataFrame:
    """The trie of turn sequences `rows` (conv_id, pos from 1, turn_id, words) of the conversations `convs`
    (conv_id), which may have no turn. One row per node: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, node and parent_node (names), turn_id."""
    rows = written(_named(rows), "turns")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "k1", "k2")).alias("l"))
    zero = F.lit(0).cast("bigint")
    last = last.select(F.col("conv_id").alias("c"), "l.*")
    ends = written(convs.distinct().join(last, F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", F.coalesce("pos", zero).alias("depth"), F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2")
    ), "ends")
    plan = written(_plan(rows, ends, container), "plan")
    placed = rows.join(plan.withColumnRenamed("conv_id", "c"), F.col("conv_id") == F.col("c"))
    swept = written(_containers(placed.where("pos > burst")), "swept")
    heads = placed.where("pos <= burst").groupBy(F.col("pos").alias("depth"), "k1", "k2").agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        F.first("words").alias("words"), F.first("turn_id").alias("turn_id"),
    )
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs",
        zero.alias("words"), F.lit(None).cast("binary").alias("turn_id"),
    )
    heads = written(heads.unionByName(root), "heads")
    children = heads.where("depth > 0").groupBy((F.col("depth") - 1).alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2")).agg(
        F.count(F.lit(1)).alias("n_heads")
    )
    below = swept.where("head").select(
        F.col("depth").alias("b"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n_children").alias("tops"),
        F.col("n_leaves").alias("leaves"), F.col("saved").alias("spared"),
    )
    full = (
        heads.join(children, (F.col("depth") == F.col("a")) & (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left")
        .join(below, (F.col("depth") == F.col("b")) & (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")), "left")
    )
    n_children = F.coalesce("n_heads", zero) + F.coalesce("tops", zero)
    full = full.select(
        *NODE, "p1", "p2", "conv_id", "n_convs", n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(F.coalesce("leaves", zero)).cast("bigint").alias("n_leaves"),
        (F.coalesce("spared", zero) + (F.col("n_convs") - 1) * F.col("words")).alias("saved"), "turn_id",
    )
    depth = heads.agg(F.max("depth")).first()[0] or 0
    full = _summed(written(full, "heads"), depth)
    every = full.withColumn("parent_conv_id", F.lit(None).cast("bigint")).unionByName(
        swept.where("NOT head").drop("head")
    )
    above = full.select(F.col("depth").alias("h"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("conv_id").alias("above"))
    sha = _digests(ends).select(F.col("depth").alias("s"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), "sha")
    # nodes inside a container know their parent's conversation; heads and the tops of containers look it up
    named = every.where("parent_conv_id IS NOT NULL").unionByName(
        every.where("parent_conv_id IS NULL").join(
            above, (F.col("depth") - 1 == F.col("h")) & (F.col("p1") == F.col("h1")) & (F.col("p2") == F.col("h2")), "left"
        ).withColumn("parent_conv_id", F.col("above")).select(*every.columns)
    ).join(sha, (F.col("depth") == F.col("s")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    name = lambda d, a, b: F.concat(d.cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(a), 16, "0")), F.lower(F.lpad(F.hex(b), 16, "0")))
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        name(F.col("depth"), F.col("k1"), F.col("k2")).alias("node"),
        F.when(F.col("depth") > 0, name(F.col("depth") - 1, F.col("p1"), F.col("p2"))).alias("parent_node"), F.lower(F.hex("turn_id")).alias("turn_id"),
    )


def prefix_trie(conversations: DataFrame, *, container: int = 256) -> DataFrame:
    """The trie of the conversations as they are."""
    own = written(turns(conversations), "numbered")
    return nodes(own, own.where("pos = 1").select("conv_id"), container=container)


def trie_sql(conversations: str = "conversations", group: int = 20, most: int = 4) -> str:
    """DuckDB SQL for the trie of the rebuilt conversations; a prefix is the text of its turns' digests."""
    return rf"""
WITH own AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM {conversations} WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {group} AS base, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % {most} AS h
  FROM own GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, t, words FROM convs c JOIN own o ON o.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, t, words FROM convs c JOIN own o USING (conv_id) WHERE pos > h
), prefixes AS (
  SELECT conv_id, t, words, row_number() OVER w AS depth, string_agg(t, '') OVER w AS name FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, '', 0, 0, '' FROM convs
), ended AS (
  SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, max_by(name, depth) AS name FROM prefixes GROUP BY conv_id) GROUP BY name
), node AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, left(name, greatest(0, len(name) - 32)) AS above
  FROM prefixes GROUP BY name, depth
), below AS (SELECT above, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY above),
tree AS (
  SELECT a.name, count(*) FILTER (b.name NOT IN (SELECT above FROM below)) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM node a JOIN (SELECT *, unnest(range(0, depth + 1)) AS d FROM node) b ON a.depth = b.d AND a.name = left(b.name, 32 * b.d) GROUP BY a.name
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node n JOIN node p ON p.name = n.above JOIN tree ON tree.name = n.name
LEFT JOIN below ON below.above = n.name LEFT JOIN ended ON ended.name = n.name"""
