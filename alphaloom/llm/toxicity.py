"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, adjacent word pairs and word pairs
with one or two words between them. Training visits a bounded sample of labelled rows
(`Config.max_rows`, chosen by a hash of doc_id) in hash order inside one task; the
per-coordinate rates and the L1 term leave few weights, which travel with every scoring
task (at most 2^bits, usually a few hundred).

Defined results: NULL and empty texts have no features and score by the intercept. Of
several labels of a document the highest counts, of several texts of a labelled document
the smallest; labels without a text, texts without a label and NULL doc_ids teach nothing.
Repeated rows are scored each for itself; other columns are carried, `score` and
`predicted` replace columns of those names. Without any label every score is 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.tokens import U, WordHashes, mix


@dataclass(frozen=True)
class Config:
    bits: int = 20
    max_skip: int = 2
    max_rows: int = 16_000
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0


def _normal(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}*#$%&|<>")


WORDS = WordHashes(_normal)


def features(texts: list[str | None], config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every occurrence, unsorted and with repeats."""
    flat, starts = WORDS.flat(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    cut = U((1 << config.bits) - 1)
    owners, found = [owner], [mix(flat) & cut]
    for gap in range(1, config.max_skip + 2):
        if len(flat) > gap:
            same = owner[:-gap] == owner[gap:]
            pair = flat[:-gap] * U(0x9E3779B97F4A7C15) + flat[gap:] + U(gap)
            owners.append(owner[:-gap][same])
            found.append(mix(pair[same]) & cut)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, config: Config) -> np.ndarray:
    """Weights; the last one is the intercept, which isn't shrunk."""
    size = (1 << config.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        shrink = np.where(i == size - 1, 0.0, config.l1)
        raw = -(z[i] - np.sign(z[i]) * shrink) / ((config.beta + np.sqrt(n[i])) / config.alpha + config.l2)
        return np.where(np.abs(z[i]) <= shrink, 0.0, raw)

    for _ in range(config.epochs):
        for x, y in zip(rows, labels, strict=True):
            i = np.append(x, size - 1)
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / config.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic",
        config: Config = Config()) -> dict[int, float]:
    """The non-zero weights; -1 is the intercept. `labels` has doc_id and the label."""
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_rows)
    )
    # config.max_rows rows at most, so they are broadcast and the texts don't move
    texts = (
        docs.select("doc_id", F.col(text).alias("text")).where(F.col(text).isNotNull())
        .join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    )

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            owner, found = features(f["text"].tolist(), config)
            cells = np.unique(owner << config.bits | found)
            cut = np.searchsorted(cells >> config.bits, np.arange(1, len(f)))
            x = [c & ((1 << config.bits) - 1) for c in np.split(cells, cut)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "x": [v.astype(np.int32) for v in x]})

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["at", "doc_id"])
        w = ftrl([np.asarray(x, dtype=np.int64) for x in f["x"]], f["y"].to_numpy(), config)
        keep = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.where(keep == len(w) - 1, -1, keep), "weight": w[keep]})

    rows = texts.mapInPandas(prepare, T.StructType([
        docs.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.IntegerType())),
    ]))
    # a bounded sample: one task sees config.max_rows rows of feature numbers at most
    trained = rows.withColumn("at", F.xxhash64("doc_id")).groupBy().applyInPandas(train, "feature long, weight double")
    return {r["feature"]: r["weight"] for r in trained.collect()}


def scored(docs: DataFrame, weights: dict[int, float], *, text: str = "text", config: Config = Config()) -> DataFrame:
    """The input's columns, score (0 to 1) and predicted (1 from 0.5 on)."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])
    numbers = np.array([k for k in weights if k >= 0], dtype=np.int64)
    values = np.array([weights[int(k)] for k in numbers])
    intercept = weights.get(-1, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << config.bits)
        dense[numbers] = values
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                owner, found = features(batch.column(text).to_pylist(), config)
                hit = dense[found] != 0
                cells = np.unique(owner[hit] << config.bits | found[hit])
                sums = np.bincount(cells >> config.bits, dense[cells & ((1 << config.bits) - 1)], minlength=batch.num_rows)
                score = _sigmoid(sums + intercept)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*kept, "score", "predicted"],
                )

    need = kept if text in kept else [*kept, text]
    return docs.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)
