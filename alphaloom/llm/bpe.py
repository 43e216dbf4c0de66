"""Byte-level BPE encoding and decoding on padded numpy matrices.

Each Arrow batch is cut into pieces by the tokenizer's pattern; every distinct piece that
the task hasn't met is encoded once. Pieces of similar byte length form the rows of one
padded matrix of token ids. In each round every row finds its leftmost pair of least rank,
merges it, and the matrix is compacted by one column; rows without a pair left leave the
matrix. Ranks of pairs come from an open-addressed hash table of all pairs of tokens that
join to a token. The merged token's id is the pair's rank.

Defined results: a NULL or empty text has no tokens and decodes to no bytes. Repeated rows
are encoded alike. Extra columns are carried; `ids` and `decoded` replace input columns of
those names. Very long pieces are single rows of a matrix of their own length. Empty
tables give no rows.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)  # rank of a pair that doesn't merge
CACHE = 200_000  # distinct pieces remembered before a start anew
CHUNK = 512  # rows of an Arrow batch handled at once, which bounds the lists of pieces
CELLS = 4 << 20  # cells of one matrix at most, beyond a single row


class PairTable:
    """Hash table (left id, right id) -> rank in numpy arrays; linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[slot[left_over]] == np.uint64(2**64 - 1)
            tries = left_over[free]
            self.keys[slot[tries]] = keys[tries]  # of several, the last stays
            won = tries[self.keys[slot[tries]] == keys[tries]]
            self.ranks[slot[won]] = rank[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or an id is negative (padding)."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[ask].astype(np.uint64) << np.uint64(32) | right.ravel()[ask].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        while len(ask):
            there = self.keys[slot]
            hit = there == keys
            flat[ask[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            ask, keys, slot = ask[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(t): int(r) for t, r in rows}
        self.tokens = {r: t for t, r in self.ids.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (self.ids[t[:i]], self.ids[t[i:]], r)
            for t, r in self.ids.items() for i in range(1, len(t)) if t[:i] in self.ids and t[i:] in self.ids
        ]
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        while start < len(order):
            shortest = int(sizes[order[start]])
            most = max(shortest, min(shortest + shortest // 4, 1 << 12))
            end = int(np.searchsorted(sizes[order], most, side="right"))
            end = min(end, start + max(1, CELLS // most))
            self._matrix(pieces, order[start:end], int(sizes[order[end - 1]]), out)
            start = end
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        size = np.fromiter((len(pieces[r]) for r in rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], np.int32(-1))
        pad = np.full((len(rows), 1), NONE, np.int32)
        ranks = np.hstack([self.pairs(ids[:, :-1], ids[:, 1:]), pad])
        while len(rows):
            at = ranks.argmin(axis=1)
            all_rows = np.arange(len(rows))
            rank = ranks[all_rows, at]
            on = rank < NONE
            for r in np.flatnonzero(~on):
                out[rows[r]] = ids[r, : size[r]].copy()
            if not on.all():
                rows, ids, ranks, size, at, rank = rows[on], ids[on], ranks[on], size[on], at[on], rank[on]
                if not len(rows):
                    return
                width = int(size.max())
                ids, ranks = ids[:, :width], ranks[:, :width]
                all_rows = np.arange(len(rows))
            ids[all_rows, at] = rank
            if len(rows) == 1:  # one long row: shift in place
                a = int(at[0])
                ids[0, a + 1 : -1] = ids[0, a + 2 :].copy()
                ranks[0, a:-1] = ranks[0, a + 1 :].copy()
                ids, ranks = ids[:, :-1], ranks[:, :-1]
            else:
                keep = np.arange(width) != (at + 1)[:, None]
                ids = ids[keep].reshape(len(rows), width - 1)
                ranks = ranks[keep].reshape(len(rows), width - 1)
            size, width = size - 1, width - 1
            # the pairs before and after the new token
            before, here = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < width)
            ranks[all_rows, at] = NONE
            ranks[before, at[before] - 1] = self.pairs(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[here, at[here]] = self.pairs(ids[here, at[here]], ids[here, at[here] + 1])



class Encoder:
    """Encodes texts piece by piece and remembers the distinct pieces that it met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.seen = vocab, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:
            self.seen = {}
        cut = [self.vocab.pattern.findall(t) if t else [] for t in texts]
        new = [p for p in set(chain.from_iterable(cut)) if p not in self.seen]
        merged = self.vocab.merge([p.encode("utf-8", "surrogatepass") for p in new])
        # bytes, as joining them is quicker than joining small arrays
        self.seen.update(zip(new, (m.astype("<u4").tobytes() for m in merged), strict=True))
        find = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(find, c)), "<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, so that later tasks find the pieces of earlier ones."""
    return Encoder(Vocabulary(path, pattern))


def encoded(df: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """The input's columns, `ids` (little-endian unsigned 32-bit integers, binary) and
    `decoded` (the bytes of the decoded ids). `path` must be readable on every executor."""
    kept = [c for c in df.columns if c.lower() not in ("ids", "decoded")]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                ids = own.encode(batch.column(text).to_pylist())
                columns = [batch.column(c) for c in kept]
                columns += [pa.array([i.tobytes() for i in ids], pa.binary())]
                columns += [pa.array([own.decode(i) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "decoded"])

    need = kept if text in kept else [*kept, text]
    return df.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)
