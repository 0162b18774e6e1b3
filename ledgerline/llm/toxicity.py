"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which words, stems (a word's first bytes), neighbouring pairs and pairs with one word between
them it has, hashed to ``2 ** BUCKET_BITS`` coordinates. Every coordinate has its own learning rate, and the L1 term keeps most weights at
exactly zero, so the model is a short list of coordinates that is broadcast; its size is bounded by the buckets.

Training reads at most ``MAX_ROWS`` labelled documents of each class, those whose ids hash lowest. They are dealt by
hash to tasks of about ``SHARD_ROWS``; each runs FTRL over its rows from the common state, and the states are averaged
after every round. Where the bound cuts one class more than the other, scores follow the odds of the rows taught.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import one_text, staged, text_batches

BUCKET_BITS = 18
MAX_ROWS, SHARD_ROWS, ROUNDS = 24_000, 4_000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
STEMS, PIECE = (4, 5, 6), 1 << 20
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE, _PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as the longest piece met needs."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 16, 2 * len(cls.up))
            cls.up, cls.down = _powers(_BASE, n), _powers(_UNBASE, n)


def _pieces(data: bytes) -> list[bytes]:
    """``data`` cut at spaces into pieces of about ``PIECE`` bytes."""
    out, at = [], 0
    while len(data) - at > PIECE and (cut := data.find(b" ", at + PIECE)) >= 0:
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def word_hashes(data: bytes) -> np.ndarray:
    """A row for each word: the hash of the word and of its stems. Words are runs of bytes other than the space;
    differences of running sums give the polynomial hash of any stretch."""
    byte = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], byte != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    _Powers.reach(len(byte) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * _Powers.up[:len(byte)])))
    base, turn = sums[starts], _Powers.down[starts]
    stops = [ends, *(np.minimum(starts + k, ends) for k in STEMS)]
    return np.stack([((sums[stop] - base) * turn + _SKIP) * _PAIR + np.uint64(k) * _BASE for k, stop in enumerate(stops)], 1)


def coordinates(text: str | None) -> np.ndarray:
    """Coordinates of all features of a text, repeats included; none for null, empty and wordless texts."""
    data = (text or "").encode("utf-8", "replace").lower().translate(_WORD_BYTES)
    rows = np.concatenate([word_hashes(piece) for piece in _pieces(data)])
    h = rows[:, 0]
    pairs, skips = h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:]
    every = np.concatenate((rows.ravel(), pairs, skips))
    every = (every ^ (every >> np.uint64(32))) * _MIX
    return (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    return np.unique(coordinates(text))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step: zero unless the accumulated gradient exceeds the L1 term."""
    w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def ftrl_pass(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (features, label), updating the state in place; the last coordinate is the bias."""
    bias = len(z) - 1
    for x, label in rows:
        x = np.append(x, bias)
        zx, nx = z[x], n[x]
        w = weights_of(zx, nx)
        w[-1] = -zx[-1] / ((BETA + np.sqrt(nx[-1])) / ALPHA + L2)  # the bias is not shrunk to zero
        g = _sigmoid(w.sum()) - label
        z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
        n[x] = nx + g * g


def _shard_pass(state: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How far one pass over the rows of each shard, in order of their ids, moves the broadcast state (z, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple]] = {}
        for batch in batches:  # doc_id, label, x, shard; all shards together hold at most MAX_ROWS rows a class
            x = batch.column(2)
            ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
            for k, (doc_id, label, shard) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                shards.setdefault(shard, []).append((doc_id, label, flat[ends[k]:ends[k + 1]]))
        for own in shards.values():
            z0, n0 = (v.astype(np.float64) for v in state.value)
            z1, n1 = z0.copy(), n0.copy()
            ftrl_pass([(x, label) for _, label, x in sorted(own, key=lambda r: r[:2])], z1, n1)
            at = np.flatnonzero(n1 != n0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array((z1 - z0)[at]), pa.array((n1 - n0)[at])], ["i", "dz", "dn"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label: of the labels whose documents are there, for each class those with the ``MAX_ROWS`` lowest
    hashes of their ids. An id teaches by one text, the one that hashes lowest, however many rows have it."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("label"))
    known = staged(marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    clean, toxic = (known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for k in (0, 1))
    short = F.broadcast(clean.unionAll(toxic))  # at most MAX_ROWS short rows a class
    return one_text(docs.select("doc_id", "text").join(short, "doc_id"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, their non-zero weights, and the bias. Without labelled rows there are no weights and the
    bias is that of a score of practically 0: nothing is known to be toxic."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "x"])

    marked = training_rows(text_batches(docs), labels)
    kind = T.StructType([marked.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])
    rows = staged(marked.mapInArrow(featured, kind))
    shards = -(-rows.count() // SHARD_ROWS)
    if not shards:
        return np.empty(0, np.int32), np.empty(0, np.float32), -30.0
    shard = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).alias("shard")
    rows = rows.select("doc_id", "label", "x", shard).repartition(shards, "shard").persist(StorageLevel.DISK_ONLY)  # dealt once, read every round
    size = (1 << BUCKET_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    context = docs.sparkSession.sparkContext
    for _ in range(ROUNDS):
        state = context.broadcast((z.astype(np.float32), n.astype(np.float32)))

        moved = rows.mapInArrow(_shard_pass(state), "i int, dz double, dn double").groupBy("i").agg(
            (F.sum("dz")).alias("dz"), (F.sum("dn")).alias("dn"), F.count(F.lit(1)).alias("k")).toArrow()
        at = moved.column("i").to_numpy()
        share = moved.column("k").to_numpy()  # a coordinate that few shards saw is averaged over those
        z[at] += moved.column("dz").to_numpy() / share
        n[at] += moved.column("dn").to_numpy() / share
        state.unpersist()
    rows.unpersist()
    w = weights_of(z[:-1], n[:-1])
    at = np.flatnonzero(w)
    bias = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
    return at.astype(np.int32), w[at].astype(np.float32), float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text; wordless texts get that of the bias.
    All rows and columns stay; a column already called ``out`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = held.value
        dense = np.zeros(1 << BUCKET_BITS)
        dense[at] = w
        for batch in texts:
            scores = []
            for x in batch:
                own = coordinates(x.as_py())
                own = np.unique(own[dense[own] != 0])  # few weights are not zero
                scores.append(_sigmoid(dense[own].sum() + bias))
            yield pa.array(scores, pa.float64())

    return text_batches(docs).withColumn(out, scored("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where score >= 0.5), learned from ``labels`` (doc_id, toxic).

    Labels that are null or neither 0 nor 1 and labels without id teach nothing; of repeated labels the highest counts.
    Ids, languages, sources and labels are never features. Repeated rows get the same score.
    """
    scored = score(docs, fit(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; other rows and all columns stay as they are."""
    model = fit(docs, labels)
    return score(docs, model, "_llm_score").where("_llm_score < 0.5").drop("_llm_score")
