"""Quality by Bradley-Terry ranking: scores from preference pairs, then a threshold at a quantile of the scores.

A document labelled good is preferred to one labelled bad. The chance of a preference is the logistic function of the
difference of two scores, and a score is linear in features of the text, so the loss of a pair is logistic in the
difference of two feature rows. Newton steps minimise it. The threshold is the quantile of the training
scores at the share of bad documents; the result is the logistic function of the distance from it.

Every labelled id that has a document teaches by one text: the commoner kind in ``PAIRS`` pairs each, the rarer kind in turn.
Pairs stay in Spark; a Newton step sends their summed derivatives to the driver. The quantile is that of all training scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, text_batches

PAIRS, RIDGE, STEPS = 4, 1e-2, 12
SHARE_ROWS, BINS, DIGITS = 10_000, 4096, 9
PIECE = 1 << 20
_MULTIPLIER = np.uint64(0x100000001B3)
Model = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def _kinds() -> np.ndarray:
    """For each byte: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 . and , 6 other ASCII, 7 beyond ASCII."""
    kind = np.full(256, 6)
    kind[[9, 11, 12, 13, 32]], kind[10], kind[[44, 46]], kind[128:] = 0, 1, 5, 7
    for first, last, k in (("a", "z", 2), ("A", "Z", 3), ("0", "9", 4)):
        kind[ord(first):ord(last) + 1] = k
    return kind


_KIND = _kinds()
NAMES = ("lower", "upper", "digit", "stop", "other", "beyond", "space", "log_bytes", "word_length", "distinct_words",
         "most_common", "twice_running", "distinct_lines", "line_length", "ends_other", "ends_stop", "starts_upper",
         "mixed_case", "top_byte", "entropy", "short_words", "long_words")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def features(text: str | None) -> np.ndarray:
    """Shares and rates of the whole text; all zero for null and empty texts."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(NAMES))
    if not data:
        return out
    byte = np.frombuffer(data, np.uint8)
    count = np.bincount(byte, minlength=256)
    n = len(byte)
    share = np.bincount(_KIND, count, 8) / n
    out[:7] = share[2], share[3], share[4], share[5], share[6], share[7], share[0]
    out[7] = np.log1p(n)
    p = count[count > 0] / n
    out[18], out[19] = p.max(), -(p * np.log(p)).sum()
    kind = _KIND[byte]
    inside = np.concatenate(([False], kind > 1, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return out
    length = ends - starts
    place = np.arange(n, dtype=np.uint64)
    mixed = (byte.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    owner = np.zeros(n, np.int64)
    owner[starts] = 1
    owner = np.maximum(np.cumsum(owner) - 1, 0)
    spin = (place - starts.astype(np.uint64)[owner]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED27)
    letters = (mixed ^ (mixed >> np.uint64(7))) * (spin | np.uint64(1)) * inside[1:-1]
    words = _sums(letters, starts)  # the letters up to the next word; spaces between add nothing
    _, times = np.unique(words, return_counts=True)
    out[8], out[9], out[10] = length.mean(), len(times) / len(words), times.max() / len(words)
    out[11] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0
    lines = np.concatenate((starts[:1], starts[1:][np.add.reduceat(kind == 1, starts)[:-1] > 0])) if len(starts) > 1 else starts
    per_line = _sums(letters, lines)
    out[12], out[13] = len(np.unique(per_line)) / len(per_line), np.log1p(len(words) / len(per_line))
    last, first = kind[ends - 1], kind[starts]
    upper = _sums((kind == 3).astype(np.int64), starts)
    out[14], out[15], out[16] = (last == 6).mean(), (last == 5).mean(), (first == 3).mean()
    out[17] = (upper > 1).mean()
    out[20], out[21] = (length <= 2).mean(), (length >= 12).mean()
    return out


def widened(x: np.ndarray) -> np.ndarray:
    """Features with their squares, so that both too little and too much of one can count against a text."""
    return np.concatenate((x, x * x), axis=-1)


def _slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the rows of ``d`` at ``w``: their number, the gradient and the second derivatives, in one row of numbers."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return np.concatenate(([len(d)], -d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()))


def _minimum(wide: int, slopes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Newton steps on the mean logistic loss with a small ridge; ``slopes`` sums over all pairs."""
    w = np.zeros(wide)
    for _ in range(STEPS):
        sums = slopes(w)
        gradient = RIDGE * w + sums[1:wide + 1] / sums[0]
        curve = sums[wide + 1:].reshape(wide, wide) / sums[0] + RIDGE * np.eye(wide)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def newton(d: np.ndarray) -> np.ndarray:
    """Weights that minimise the logistic loss of the rows of ``d`` (preferred minus other) with a small ridge."""
    return _minimum(d.shape[1], lambda w: _slopes(d, w))


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _summed(pairs: DataFrame, w: np.ndarray) -> np.ndarray:
    """The sums of :func:`_slopes` over all pairs: one row of numbers a task, added up by their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for batch in batches:
            total += _slopes(_rows_of(batch.column(0), len(w)), w)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = pairs.select("d").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "part"))
    rows = parts.groupBy("place").agg(F.sum("part").alias("sum")).collect()  # a row for each entry of the sums
    return np.array([r["sum"] for r in sorted(rows)])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, place and features ``x`` of every labelled id that has a document. Places count the ids of a label from 0
    in the order of their hash. Features are taken where the texts are read, so that no text is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([features(x.as_py()) for x in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "first", "second")), rows], ["doc_id", "first", "second", "x"])

    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    texts = text_batches(docs).where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("first"), F.xxhash64(F.lit(1), "text").alias("second"), "text")
    known = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, first long, second long, x array<double>")
    order = F.when(F.col("x").isNotNull(), F.struct("first", "second"))  # of the texts of an id the one that hashes lowest
    taught = known.unionByName(marked, allowMissingColumns=True).groupBy("doc_id").agg(
        F.struct(F.min("label").alias("label"), F.min_by("x", order).alias("x")).alias("_one")).where(
        F.col("_one.label").isNotNull() & F.col("_one.x").isNotNull())
    rows = staged(taught.select("doc_id", "_one.label", "_one.x", F.xxhash64("doc_id").alias("_hash")))
    shares = 1 + rows.count() // SHARE_ROWS
    dealt = rows.withColumn("_share", F.pmod("_hash", F.lit(shares)))
    order = Window.partitionBy("label", "_share").orderBy("_hash", "doc_id")
    sizes = dealt.groupBy("label", "_share").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("label").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("label", "_share", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return dealt.withColumn("_turn", F.row_number().over(order) - 1).join(F.broadcast(starts), ["label", "_share"]).select(
        "label", (F.col("_start") + F.col("_turn")).alias("place"), "x")


def preference_pairs(rows: DataFrame, counts: dict[int, int], scale: np.ndarray) -> DataFrame:
    """``d``, the scaled features of a good document minus those of a bad one: every document of the commoner kind in
    ``PAIRS`` pairs, those of the rarer kind in turn, so that each teaches."""
    common = int(counts[1] >= counts[0])
    turn = F.pmod(F.col("place") * PAIRS + F.col("_k"), F.lit(counts[1 - common]))
    many = rows.where(F.col("label") == common).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(PAIRS)]))).select(
        turn.alias("_turn"), F.col("x").alias("_many"))
    few = rows.where(F.col("label") == 1 - common).select(F.col("place").alias("_turn"), F.col("x").alias("_few"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad = (widened(_rows_of(batch.column(c), len(NAMES))) for c in ("good", "bad"))
            d = ((good - bad) / scale).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(d), pa.list_(pa.float32()))], ["d"])

    sides = ("_many", "_few") if common else ("_few", "_many")
    both = many.join(few.hint("merge"), "_turn").select(F.col(sides[0]).alias("good"), F.col(sides[1]).alias("bad"))
    return both.mapInArrow(run, "d array<float>")


def ranked(scores: DataFrame, rank: int) -> tuple[float, float]:
    """The values of column ``s`` at places ``rank`` and ``rank + 1`` (from 0) of their order, exact. The range that holds
    the first is cut into bins until it is one value; a pass returns a row a bin."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    below = 0
    while low < high:
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = scores.where(F.col("s").between(low, high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("rows"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for b in sorted(bins):
            if below + b["rows"] > rank:
                break
            below += b["rows"]
        low, high = b["low"], b["high"]
    upto, after = scores.agg(F.count(F.when(F.col("s") <= low, 1)), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low, low if upto > rank + 1 or after is None else after


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Mean and scale of the features, weights, and threshold. Without both kinds of labels all scores are 0.5."""
    wide = len(NAMES) * 2
    rows = staged(training_rows(docs, labels))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return np.zeros(wide), np.ones(wide), np.zeros(wide), 0.0
    cells = [F.col("x")[i] for i in range(len(NAMES))]
    moments = rows.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in [*cells, *[c * c for c in cells]]]).first()
    mean, scale = (np.round(part, DIGITS) for part in (np.array(moments[:wide]), np.array(moments[wide:]) + 1e-9))
    pairs = staged(preference_pairs(rows, counts, scale))
    w = np.round(_minimum(wide, lambda w: _summed(pairs, w)), DIGITS)  # the order of tasks must not matter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = (widened(_rows_of(batch.column(0), len(NAMES))) - mean) / scale @ w
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64())], ["s"])

    total = counts[0] + counts[1]
    at = counts[0] / total * (total - 1)
    first, second = ranked(staged(rows.select("x").mapInArrow(run, "s double")), int(at))
    return mean, scale, w, float(np.round(first + (second - first) * (at - int(at)), DIGITS))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1, 0.5 at the threshold) of every whole text, null and empty ones too.
    All rows and columns stay; a column already called ``out`` is replaced."""
    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mean, scale, w, threshold = model
        for batch in texts:
            scores = []
            for x in batch:
                s = (widened(features(x.as_py())) - mean) / scale @ w - threshold
                scores.append(float(1 / (1 + np.exp(-np.clip(s, -30, 30)))))
            yield pa.array(scores, pa.float64())

    return text_batches(docs).withColumn(out, scored("text"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where score >= 0.5), learned from ``labels`` (doc_id, quality).

    Labels that are null or neither 0 nor 1 and labels without id teach nothing; of repeated labels the lowest counts.
    Ids, languages, sources and labels are never features. Repeated rows get the same score.
    """
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
