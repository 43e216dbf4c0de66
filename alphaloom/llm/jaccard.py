"""N-gram Jaccard self-join by token-combination prefixes, exact from a threshold on.

Two sets of distinct word shingles link when 100 * |x & y| >= 80 * |x | y|.

1. A first pass counts shingles in a fixed number of hash buckets. The counts only order
   tokens, rare ones first, and name the frequent ones; any order gives right results.
2. With d = |x| - ceil(0.8 |x|), linked sets share k = e + 1 tokens within their first
   d + e + 1 tokens, e = max(1, ceil(d / 4)). Rare tokens of this extended prefix are index
   keys alone. If all shared ones are frequent, two of them that follow each other among the
   shared ones lie at most `REACH` frequent tokens apart in both prefixes (their gaps add up to
   (dx + dy) / e + 2 at most, on average over the e gaps), so pairs of frequent tokens that
   near each other are the keys for the frequent class.
3. Sets that meet under a rare key are compared by size and by parity maps of about one bit a
   token, whose differing bits never exceed the sets' difference; sets under a frequent key are only tied
   to the key's least set. Connected sets form a class; linked sets are always in one class.
4. Inside a class, cut into blocks by size and hash, exact intersections are counted by
   matrix products; each task returns a spanning forest of its links and link counts.

Equal sets are one node, so copies cost nothing. Sets are compared by 64-bit shingle hashes
and nodes named by 64-bit set hashes.

Defined results: words are lower-cased A-Z and cut at ASCII white space; fewer than five
words are one shingle; NULL and blank texts are empty, link with nothing and keep their own
id. Each row of repeated rows gets a row; NULL ids are ignored when the least id is sought.
Only doc_id and the text are read, so other columns can't clash. Empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.core.lineage import scratch_path
from alphaloom.llm.components import components
from alphaloom.llm.tokens import U, WordHashes, mix, windows

SHINGLE = 5
REACH = 11  # see _reach(); a test derives it
SKETCH_BITS = 20  # 2^20 counters, a bounded size
LEAST_MAP = 256  # bits of a parity map at least; longer ones have as many bits as tokens
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 21  # of one side of a verification task
ROWS = 512  # texts handled at once inside a task

WORDS = WordHashes()


def prefix_length(n):
    """(d, e, length of the extended prefix) of sets of n tokens."""
    d = n - (4 * n + 4) // 5
    e = np.maximum(1, -(-d // 4))
    return d, e, np.minimum(n, d + e + 1)


def token_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct, sorted by both."""
    flat, starts = WORDS.flat(texts)
    h, owner = windows(flat, starts, SHINGLE)
    sizes = np.diff(starts)
    for r in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        one = flat[starts[r] : starts[r + 1]]
        h = np.append(h, windows(one, np.array([0, len(one)]), len(one))[0] ^ U(len(one)))
        owner = np.append(owner, r)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], h[first]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """Occurrences of shingles per hash bucket; a task sends one vector, parts are added up."""
    parts = 64
    width = (1 << SKETCH_BITS) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                _, h = token_sets(whole.slice(at, ROWS).column(text).to_pylist())
                total += np.bincount(_bucket(h), minlength=1 << SKETCH_BITS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in total.reshape(parts, width)], pa.binary())],
            names=["part", "counts"],
        )

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.int64)
        for f in frames:
            for b in f["counts"]:
                total += np.frombuffer(b, np.uint32)
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})

    rows = docs.select(text).mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros((parts, width), np.int64)
    for r in rows.collect():  # 2^SKETCH_BITS numbers whatever the data
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def set_hash(owner: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per set, as a signed integer; the sum of mixed tokens doesn't depend on order."""
    total = np.zeros(rows, U)
    np.add.at(total, owner, mix(h ^ U(0xA5A5A5A5A5A5A5A5)))
    return mix(total + np.bincount(owner, minlength=rows).astype(U)).view(np.int64)


def parity_maps(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Per set a bit map in which each token flips the bit that its hash names; the number of
    bits is the power of two from the set's size on."""
    bits = np.maximum(LEAST_MAP, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    at = (ends - bits)[owner] + (h & (bits[owner] - 1).astype(U)).astype(np.int64)
    flips = np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0)
    words = np.packbits((flips & 1).astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 64]).astype(np.int32)), pa.array(words))


def _signatures(counts: np.ndarray, text: str):
    """Task code: doc_id, n, node, parity map, rare and frequent keys of each text."""
    limit = max(64, 4 * int(counts.sum() >> SKETCH_BITS))
    weights = np.minimum(counts, 2**31 - 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task; copies send no keys again
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = batch.num_rows
                owner, h = token_sets(batch.column(text).to_pylist())
                n = np.bincount(owner, minlength=rows)
                node = set_hash(owner, h, rows)
                fresh = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], dtype=bool)
                maps = parity_maps(owner, h, n)
                weight = weights[_bucket(h)]
                order = np.lexsort((h, weight, owner))
                place = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
                _, _, length = prefix_length(n)
                inside = (place < length[owner]) & (n[owner] > 1) & fresh[owner]
                h, weight, own = h[order][inside], weight[order][inside], owner[inside]
                often = weight > limit
                rare_owner, rare = own[~often], h[~often]
                keys, owners = [], []
                f, fo = h[often], own[often]
                for gap in range(1, REACH + 1):
                    if len(f) > gap:
                        same = fo[gap:] == fo[:-gap]
                        keys.append(mix(f[:-gap][same] * U(0x9E3779B97F4A7C15) + f[gap:][same]))
                        owners.append(fo[:-gap][same])
                pair = np.concatenate(keys) if keys else np.empty(0, U)
                pair_owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
                by = np.argsort(pair_owner, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                        pa.array(node, pa.int64(), mask=n == 0), maps, _lists(rare_owner, rare, rows), _lists(pair_owner[by], pair[by], rows),
                    ],
                    names=["doc_id", "n", "node", "map", "rare", "often"],
                )

    return run


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _tokens(text: str):
    """Task code: the shingle hashes of the wanted nodes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = batch.num_rows
                owner, h = token_sets(batch.column(text).to_pylist())
                right = set_hash(owner, h, rows) == batch.column("node").to_numpy()
                ends = np.cumsum(np.bincount(owner, minlength=rows))
                sets = [s.tobytes() for s in np.split(h, ends[:-1])]
                out = pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("class"), batch.column("n"), batch.column("copies"), pa.array(sets, pa.binary())],
                    names=["node", "class", "n", "copies", "tokens"],
                )
                yield out.filter(pa.array(right))

    return run


def links_between(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes (left x right). Tokens of one set only are left out; the others
    are counted by products of 0/1 matrices, in column chunks."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[token] > 1
    owner, token = owner[keep], token[keep]
    shared = np.zeros((len(left), len(right)), np.float32)
    if not len(token):
        return shared
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    position = np.full(len(sets), -1)
    position[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    width = 4096
    for start in range(0, int(token[-1]) + 1, width):
        a, b = np.searchsorted(token, (start, start + width))
        o, t = owner[a:b], token[a:b] - start
        x = np.zeros((len(left), width), np.float32)
        y = np.zeros((len(right), width), np.float32)
        i, j = position[o] >= 0, other[o] >= 0
        x[position[o[i]], t[i]] = 1
        y[other[o[j]], t[j]] = 1
        shared += x @ y.T
    return shared


def _verify(f: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links of one task: rows (a, b, 0) of a spanning forest and (a, NULL, linked documents)."""
    f = f.drop_duplicates(["node", "side"])
    both = f.groupby("node", sort=True).agg(
        n=("n", "first"), copies=("copies", "first"), bucket=("bucket", "first"), side=("side", "sum"), tokens=("tokens", "first")
    )
    node, n, copies, bucket, side = (both.index.to_numpy(), *(both[c].to_numpy() for c in ("n", "copies", "bucket", "side")))
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "linked": []})
    shared = links_between([np.frombuffer(t, U) for t in both["tokens"]], left, right)
    union = n[left][:, None] + n[right][None, :] - shared
    linked = 100 * shared.astype(np.float64) >= threshold * union
    # within a size bucket each pair is met twice, by either order; the smaller node is left
    linked &= (bucket[left][:, None] != bucket[right][None, :]) | (node[left][:, None] < node[right][None, :])
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    degree = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
    root = np.arange(len(node))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    tied = np.unique(np.concatenate([a, b]))
    top = np.array([find(x) for x in tied.tolist()], dtype=np.int64)
    return pd.DataFrame({"a": node[tied], "b": node[top] if len(top) else [], "linked": degree[tied].astype(np.int64)})


def _difference(x: Column, y: Column) -> Column:
    """Differing bits of two parity maps; a map of twice the length is folded to the other's."""

    def folded(m: Column, other: Column) -> Column:
        half = (F.size(m) / 2).cast("int")
        both = F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(m) > F.size(other), both).otherwise(m)

    bits = F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda total, b: total + b)


def linked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row; n_links counts other documents."""
    spark = docs.sparkSession
    threshold = 80

    def written(df: DataFrame, name: str) -> DataFrame:
        """A written table's size is known, so the planner broadcasts it only while it is small."""
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(
        narrow.mapInArrow(
            _signatures(sketch(narrow, "text"), "text"),
            "doc_id bigint, n bigint, node bigint, map array<bigint>, rare array<bigint>, often array<bigint>",
        ), "signatures",
    )
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"))).alias("one"),
    )
    # rare keys: at most the sketch's limit of sets under each, so pairs stay few
    # dealt by the key first, so that dropping copies and the join share one shuffle
    rare = signed.select("node", F.explode_outer("rare").alias("k")).where("k IS NOT NULL").repartition("k").distinct()
    pairs = (
        rare.alias("x").join(rare.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node")))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    )
    sizes_of = nodes.select("node", "n")
    alike = F.abs(F.col("x.n") - F.col("y.n")) * 9 <= F.col("x.n") + F.col("y.n")
    sized = (
        pairs.join(sizes_of.alias("x"), F.col("a") == F.col("x.node")).join(sizes_of.alias("y"), F.col("b") == F.col("y.node"))
        .where(alike).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("total"))
    )
    maps = signed.where("node IS NOT NULL").select("node", "map").dropDuplicates(["node"])
    near = (
        sized.join(maps.alias("x"), F.col("a") == F.col("x.node")).join(maps.alias("y"), F.col("b") == F.col("y.node"))
        .where(_difference(F.col("x.map"), F.col("y.map")) * 9 <= F.col("total")).select("a", "b")
    )
    often = written(signed.where(F.size("often") > 0).select("node", F.explode("often").alias("k")).distinct(), "often")
    least = often.groupBy("k").agg(F.min("node").alias("m")).withColumnRenamed("k", "k2")
    tied = often.join(least, F.col("k") == F.col("k2")).where("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct()
    classes = components(near.union(tied))

    wanted = written(
        classes.withColumnsRenamed({"node": "c", "root": "class"}).join(nodes, F.col("c") == F.col("node"))
        .select("node", "class", "n", "copies", "one"), "wanted",
    )
    # the ids alone are small enough to be broadcast for longer; then few texts are shuffled
    ids = written(wanted.select(F.col("one.id").alias("w")).distinct().sort("w"), "ids")
    sets = (
        narrow.join(ids, F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("one.id")))
        .select("text", "node", "class", "n", "copies")
        .mapInArrow(_tokens("text"), "node bigint, class bigint, n bigint, copies bigint, tokens binary")
    )
    sets = written(sets.withColumn("bucket", F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")), "sets")
    # linked sizes differ by a factor of 1.25 at most, so only neighbouring buckets meet
    sizes = wanted.groupBy("class", F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")
    )
    next_ = sizes.select("class", (F.col("bucket") - 1).alias("bucket"), F.col("rows").alias("rows2"), F.col("tokens").alias("tokens2"))

    def blocks(rows: Column, tokens: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK_ROWS, tokens / BLOCK_TOKENS)).cast("int")

    more = F.coalesce(F.col("rows2"), F.lit(0)), F.coalesce(F.col("tokens2"), F.lit(0))
    plan = written(
        sizes.join(next_, ["class", "bucket"], "left").select(
            "class", F.col("bucket").alias("unit"), blocks(F.col("rows"), F.col("tokens")).alias("nl"),
            blocks(F.col("rows") + more[0], F.col("tokens") + more[1]).alias("nr"),
        ), "plan",
    )
    left, right = F.pmod(F.xxhash64("node"), F.col("nl")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nr"))

    def tasks(side: int, unit: Column, i: Column, j: Column) -> DataFrame:
        return (
            sets.withColumn("unit", unit).join(plan, ["class", "unit"])
            .withColumns({"i": i, "j": j, "side": F.lit(side)})
        )

    every_r = F.explode(F.sequence(F.lit(0), F.col("nr") - 1))
    every_l = F.explode(F.sequence(F.lit(0), F.col("nl") - 1))
    one = (F.col("nl") == 1) & (F.col("nr") == 1)
    own = F.col("bucket")
    placed = (
        tasks(3, own, F.lit(0), F.lit(0)).where(one)
        .unionByName(tasks(1, own, left.cast("int"), F.lit(0)).where(~one).withColumn("j", every_r))
        .unionByName(tasks(2, own, F.lit(0), right.cast("int")).where(~one).withColumn("i", every_l))
        .unionByName(tasks(2, own - 1, F.lit(0), right.cast("int")).withColumn("i", every_l))
    )
    found = written(
        # dealt by all four, since the join on the first two would leave a large class in one task
        placed.repartition("class", "unit", "i", "j").groupBy("class", "unit", "i", "j").applyInPandas(
            lambda f: _verify(f, threshold), "a bigint, b bigint, linked bigint"
        ), "links",
    )
    roots = components(found.select("a", "b")).withColumnRenamed("node", "r")
    degrees = found.groupBy("a").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "d")
    grouped = nodes.join(roots, F.col("node") == F.col("r"), "left").join(degrees, F.col("node") == F.col("d"), "left").select(
        "node", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "g")
    named = written(grouped.join(smallest, F.col("root") == F.col("g")).select(
        F.col("node").alias("v"), "component", (F.col("linked") + F.col("copies") - 1).alias("n_links")), "named")
    return signed.select("doc_id", "n", "node").join(named, F.col("node") == F.col("v"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
