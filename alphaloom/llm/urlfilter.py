"""URL filters: rules by host and path, and for all other URLs a logistic regression on hashed
character n-grams of host and path.

A rule is a host and a path prefix, `example.com/en/`: it fits its host and all subdomains where
the URL's path starts with the rule's path, and the longest fitting rule decides (of rules of
one length the one with the longer host, then the lesser text). The model is trained from a
small labelled table of URLs, of which at most `Config.max_rows` distinct ones, lowest by hash,
are used, in one task; its weights (2^bits doubles, half a megabyte) travel with every scoring task.
URLs are judged row by row where they are read: nothing is shuffled, so a host with a third
of all pages costs nothing extra.

Defined results: the host lies between the first `://` and the next `/`, `?`, `#` or the end,
A-Z lower-cased; the path goes on to `?`, `#` or the end. NULL URLs and URLs without `://` have an
empty host and path; no rule fits them, and the intercept alone scores them. A URL without a path
fits no rule, as every rule's path begins with `/`. Repeated rows are judged each for itself,
other columns are carried, and `host`, `path`, `rule`, `score` and `verdict` replace columns of those
names. Of several labels of a URL the highest counts; NULL URLs and labels, and URLs of more than
`max_bytes` bytes, teach nothing. Without any label every score is 0.5 and every verdict of the
method is allow. Empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import let
from alphaloom.llm.tokens import U, mix, windows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 100_000  # rules travel with the tasks; a longer list is refused
CHUNK_ROWS, CHUNK_BYTES = 2048, 1 << 20  # URLs whose n-grams are held at once


@dataclass(frozen=True)
class Config:
    bits: int = 16
    sizes: tuple[int, ...] = (3, 4, 5)
    max_rows: int = 8192
    max_bytes: int = 4096
    epochs: int = 12
    batch: int = 256
    rate: float = 0.5
    l2: float = 1e-5


def host_and_path(url: str | Column) -> Column:
    """Struct of host and path, both empty for a URL without `://`."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return let(F.coalesce(rest, F.lit("")), lambda r: F.struct(
        F.translate(F.regexp_extract(r, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    ))


class Rules:
    """Looks up the longest rule that fits a host and a path."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        self.labels = 0
        n = 0
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            if not host or not slash or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
            self.by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append((slash + path, rule, verdict))
            self.labels = max(self.labels, host.count(".") + 1)
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
        for found in self.by_host.values():
            found.sort(key=lambda x: (-len(x[1]), x[1], x[2]))

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str] | None = None
        out: tuple[str | None, str | None] = (None, None)
        at = len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            for prefix, rule, verdict in self.by_host.get(host[at + 1 :], ()):
                if path.startswith(prefix):
                    rank = (-len(rule), at, rule)
                    if best is None or rank < best:
                        best, out = rank, (rule, verdict)
                    break
            if at < 0:
                break
        return out


def ngrams(hosts: list[str], paths: list[str], config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(URL number, feature, value): distinct n-grams of each URL, with values of unit length."""
    cells = []
    for field, texts in enumerate((hosts, paths)):
        framed = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
        flat = mix(np.frombuffer(b"".join(framed), np.uint8).astype(U) + U(256 * (field + 1)))
        starts = np.r_[0, np.cumsum([len(t) for t in framed])]
        for n in config.sizes:
            h, owner = windows(flat, starts, n)
            cells.append(owner << config.bits | (h & U((1 << config.bits) - 1)).astype(np.int64))
    distinct = np.unique(np.concatenate(cells))
    owner, feature = distinct >> config.bits, distinct & ((1 << config.bits) - 1)
    counts = np.bincount(owner, minlength=len(hosts))
    return owner, feature, 1 / np.sqrt(np.maximum(counts, 1))[owner]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def descend(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, config: Config) -> np.ndarray:
    """Weights by mini-batches with per-coordinate rates; the last one is the intercept. Both
    labels weigh the same in total."""
    size = 1 << config.bits
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    ones = y.sum()
    weigh = np.where(y == 1, len(y) / max(2 * ones, 1), len(y) / max(2 * (len(y) - ones), 1))
    cut = np.searchsorted(owner, np.arange(0, len(y) + config.batch, config.batch))
    for _ in range(config.epochs):
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            first = k * config.batch
            rows = min(config.batch, len(y) - first)
            own, f, v = owner[lo:hi] - first, feature[lo:hi], value[lo:hi]
            error = (_sigmoid(np.bincount(own, w[f] * v, rows) + w[-1]) - y[first : first + rows]) * weigh[first : first + rows]
            g = np.append(np.bincount(f, error[own] * v, size), error.sum()) / rows
            g[:-1] += config.l2 * w[:-1]
            seen += g * g
            w -= config.rate * g / np.sqrt(seen)
    return w


def fit(labelled: DataFrame, *, url: str = "url", label: str = "label", config: Config = Config()) -> np.ndarray:
    """Weights from a table of URLs and labels (1 block, 0 allow)."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull() & (F.octet_length(url) <= config.max_bytes))
    one = rows.groupBy(F.col(url).alias("url")).agg(F.max(label).cast("double").alias("y")).withColumn("at", F.xxhash64("url"))
    # a stated bound: config.max_rows URLs with the lowest hashes
    sample = one.orderBy("at", "url").limit(config.max_rows).select("at", host_and_path("url").alias("u"), "y")

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["at", "host", "path"])
        w = descend(*ngrams(f["host"].tolist(), f["path"].tolist(), config), f["y"].to_numpy(), config)
        keep = np.flatnonzero(w)
        return pd.DataFrame({"feature": keep, "weight": w[keep]})

    trained = sample.select("at", "u.host", "u.path", "y").groupBy().applyInPandas(train, "feature long, weight double").toPandas()
    w = np.zeros((1 << config.bits) + 1)
    w[trained["feature"].to_numpy(np.int64)] = trained["weight"].to_numpy(float)
    return w


def _chunks(hosts: list[str], paths: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if i > start and (i - start >= CHUNK_ROWS or size + len(h) + len(p) > CHUNK_BYTES):
            yield start, i
            start, size = i, 0
        size += len(h) + len(p)
    if hosts:
        yield start, len(hosts)


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]], weights: np.ndarray, *, url: str = "url",
           config: Config = Config()) -> DataFrame:
    """The input with host, path, rule, score (0 to 1, higher: block likelier) and verdict."""
    own = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in own]
    table = Rules(rules)
    schema = T.StructType([pages.schema[c] for c in kept] + [
        T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("verdict", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(kept))
            hosts, paths = parts.field("host").to_pylist(), parts.field("path").to_pylist()
            score = np.empty(len(hosts))
            for lo, hi in _chunks(hosts, paths):
                owner, feature, value = ngrams(hosts[lo:hi], paths[lo:hi], config)
                score[lo:hi] = _sigmoid(np.bincount(owner, weights[feature] * value, hi - lo) + weights[-1])
            found = [table.fit(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdict = [v or ("block" if s > 0.5 else "allow") for (_, v), s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array([r for r, _ in found], pa.string()), pa.array(score), pa.array(verdict, pa.string())],
                names=[*kept, *own],
            )

    return pages.select(*[f"`{c}`" for c in kept], host_and_path(F.col(f"`{url}`")).alias("parts")).mapInArrow(run, schema)


def labelled_by_rules(pages: DataFrame, rules: Iterable[tuple[str, str]], *, url: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule fits: what the rules say of them is a labelled table."""
    table = Rules(rules)
    schema = T.StructType([pages.schema[url], T.StructField("label", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            said = [table.fit(h, p)[1] for h, p in zip(parts.field("host").to_pylist(), parts.field("path").to_pylist(), strict=True)]
            known = pa.array([v is not None for v in said], pa.bool_())
            label = pa.array([v == "block" for v in said if v is not None], pa.bool_()).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), label], names=[url, "label"])

    return pages.select(url, host_and_path(url).alias("parts")).mapInArrow(run, schema)
