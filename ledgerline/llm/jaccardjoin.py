"""N-gram Jaccard self-join by filters under several global token orders, and the components of its links.

Two sets whose Jaccard similarity is ``t`` or more share a token among the first ``n - ceil(t * n) + 1`` of each, in
whatever order all tokens are put. The first order is by rarity: tokens are counted over all documents in a table of
``2 ** SKETCH_BITS`` buckets, rare buckets first. Its prefixes meet by token, under bounds of length and place. The
other orders are permutations by hash: a candidate must share prefix tokens under each of them too, and what all
filters leave is verified on the whole sets.

Equal sets are one set from the start. Pairs of dense groups are not listed: every member of a token's list first
meets the list's member with the fewest rarer tokens, the verified links are contracted to components, and then only
members of different components of a list meet. That loses no link between different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged
from ledgerline.llm.components import components

SHINGLE, PERCENT, SKETCH_BITS = 3, 90, 20
PIECE, DOCS, SHORT_ROWS = 1 << 20, 256, 1 << 21
_BLANK = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_BASE, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(33)
#: Odd factors: multiplying by one permutes all tokens, and puts them in another order.
FACTORS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as the longest piece met needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 1 << 16, 2 * len(cls.up))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, base)))) for base in (_BASE, inverse))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _M1
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash for each run of bytes other than the space, from differences of running polynomial sums."""
    byte = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], byte != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    _Powers.reach(len(byte) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * _Powers.up[:len(byte)])))
    return _mixed((sums[ends] - sums[starts]) * _Powers.down[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE and (cut := data.find(b" ", at + PIECE)) >= 0:
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``k`` words; of all its words where it has fewer.
    Words are what white space (ASCII) leaves, A-Z lower-cased. A text without words has none."""
    data = (text or "").encode("utf-8", "replace").lower().translate(_BLANK)
    words = np.concatenate([_word_hashes(piece) for piece in _pieces(data)])
    if not len(words):
        return words
    n, k = max(len(words) - k + 1, 1), min(k, len(words))
    joined = np.full(n, np.uint64(k))
    for i in range(k):
        joined = joined * _STEP + words[i:i + n]
    return np.unique(_mixed(joined))


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """In how many documents the tokens of each bucket stand, over all documents. A task sends one row a bucket, and
    one row a bucket comes to the driver: as many as there are buckets at most, whatever the corpus."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * DOCS):
                own = [shingles(x.as_py(), k) for x in batch.column(0).slice(at, 4 * DOCS)]
                counts += np.bincount(_buckets(np.concatenate(own)), minlength=len(counts))
        at = np.flatnonzero(counts)
        for a in range(0, len(at), 1 << 16):
            part = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each set."""
    keys = np.frombuffer(b"".join([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]), "<i8").reshape(-1, 2)
    return [pa.array(keys[:, i].copy()) for i in (0, 1)]


def _lists(values: Sequence[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).view(kind)))


def token_sets(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits that tell sets apart), prefix (the rarest tokens, as many as the bound asks for), p1 and
    p2 (the prefixes under the other orders, 32 bits a token) and row, a number of its own, for each input row; written
    to the shared folder. Whole sets are not kept: they would take more room than the texts."""
    rank = docs.sparkSession.sparkContext.broadcast(np.unique(bucket_counts(docs, k), return_inverse=True)[1].astype(np.int32))
    names = ["doc_id", "n", "k1", "k2", "prefix", "p1", "p2"]

    def prefixes(tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(tokens)
        if n * (100 - percent) < percent:  # too small to be near another set
            return (tokens[:0],) * (1 + len(FACTORS))
        length = n - -(-n * percent // 100) + 1
        rarest = tokens[np.lexsort((tokens, rank.value[_buckets(tokens)]))[:length]]
        return rarest, *(np.partition(tokens * factor, length - 1)[:length] for factor in FACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                own = [shingles(x.as_py(), k) for x in part.column(1)]
                first, *others = zip(*map(prefixes, own), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in own], pa.int64()), *_keys(own), _lists(first),
                     *(_lists([(p >> np.uint64(32)).astype(np.uint32) for p in other], np.int32) for other in others)], names)

    kind = T.StructType([
        docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:4]),
        T.StructField("prefix", T.ArrayType(T.LongType(), False)), *(T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in names[5:])])
    return staged(docs.select("doc_id", "text").mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))


def whole_sets(docs: DataFrame, heads: DataFrame, rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """row, n, tokens of the sets whose row is in ``rows``, read again from the texts. ``heads`` tells for each row its key and
    the id of the document to read (row, k1, k2, least); documents that share both are combined before the shuffle."""
    names = ["doc_id", "n", "k1", "k2", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                own = [shingles(x.as_py(), k) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in own], pa.int64()), *_keys(own), _lists(own)], names)

    kind = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:4]),
                         T.StructField("tokens", T.ArrayType(T.LongType(), False))])
    wanted = staged(heads.join(rows, "row").select("row", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "least"))
    if wanted.count() <= SHORT_ROWS:  # four numbers each
        wanted = F.broadcast(wanted)
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("least"))
    read = docs.select("doc_id", "text").mapInArrow(run, kind).join(wanted, same)
    return staged(read.groupBy("row").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))


def _ceil(numerator: Column, denominator: int) -> Column:
    return F.floor((numerator + (denominator - 1)) / F.lit(denominator)).cast("long")


def could_link(a: str, b: str, percent: int) -> Column:
    """Bounds of length and place for a token shared at ``pos`` of two sets: what follows it in the shorter rest, it
    included, must be able to reach the overlap that the sizes ask for."""
    n, m, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (a, b))
    return (F.greatest(n, m) * percent <= F.least(n, m) * 100) & (F.least(n - i, m - j) >= _ceil((n + m) * percent, 100 + percent))


def _largest(percent: int) -> Column:
    """The size of the largest set that a token at ``pos`` of a set of ``n`` leaves within reach."""
    return F.floor((F.col("n") - F.col("pos")) * (100 + percent) / F.lit(percent)).cast("long") - F.col("n")


def _within_reach(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of ``lists`` that another row of their list could be near to, by the extremes of the list; where a list
    has two rows, which is the most common case, by these two."""
    n = F.col("n")
    seen = lists.groupBy(F.col("token").alias("_token")).agg(
        F.count(F.lit(1)).alias("c"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.sum(n).alias("both"), F.min(n - F.col("pos")).alias("rest")
    ).where((F.col("c") > 2) | (F.col("c") == 2) & (F.col("hi") * percent <= F.col("lo") * 100)
            & (F.col("rest") >= _ceil(F.col("both") * percent, 100 + percent)))
    near = (F.col("token") == F.col("_token")) & (F.col("largest") >= F.col("lo")) & (n * percent <= F.col("hi") * 100)
    return staged(lists.join(seen.select("_token", "lo", "hi"), near, "left_semi"))


def prefix_lists(sets: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """token, row, n, pos, largest: the rarity prefixes of the sets whose rows are in ``heads``, where a token stands in
    several that could be near each other."""
    able = sets.where(F.size("prefix") > 0).select("row", "n", "prefix").join(heads.select("row"), "row", "left_semi")
    rows = able.select("row", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    lists = rows.join(shared, "token", "left_semi").withColumn("largest", _largest(percent))
    return _within_reach(_within_reach(staged(lists), percent), percent)


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: each row with the row of its list that has the fewest rarer tokens, where they could link."""
    hubs = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "row")).alias("h")).select(
        F.col("token").alias("_token"), F.col("h.row").alias("row"), F.col("h.n").alias("n"), F.col("h.pos").alias("pos"))
    met = lists.alias("x").join(hubs.alias("y"), F.col("x.token") == F.col("y._token")).where(
        (F.col("x.row") != F.col("y.row")) & could_link("x", "y", percent))
    return _pairs(met)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def open_pairs(lists: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """a, b: rows of one list that belong to different components of ``reached`` (vertex, root) and could link.

    Components of a list meet first, a row each and by classes of length, so lists of one component cost nothing and
    the members of a large one are not compared with each other.
    """
    width = float(np.log(100 / (percent - 1)))  # a little over the ratio of sizes that can link
    known = lists.join(reached, lists["row"] == reached["vertex"], "left").select(
        "token", "row", "n", "pos", "largest", F.coalesce("root", "row").alias("c"), F.floor(F.log(F.col("n")) / width).cast("int").alias("size"))
    mixed = known.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    known = staged(known.join(mixed, "token", "left_semi"))
    groups = known.groupBy("token", "size", "c").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("largest").alias("top"))
    near = groups.select("token", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("size").alias("own"),
                         F.col("c").alias("d"), *(F.col(x).alias(f"_{x}") for x in ("lo", "hi", "top")))
    able = (F.col("lo") <= F.col("_top")) & (F.col("_lo") <= F.col("top")) & (F.col("lo") * percent <= F.col("_hi") * 100) & (
        F.col("_lo") * percent <= F.col("hi") * 100)
    meet = near.join(groups, ["token", "size"]).where("c <> d AND (own < size OR d < c)").where(able).select(
        F.col("token").alias("_token"), F.col("own").alias("_own"), F.col("d").alias("_d"), F.col("size").alias("_size"), F.col("c").alias("_c"))
    one = meet.join(known.alias("x"), (F.col("_token") == F.col("x.token")) & (F.col("_own") == F.col("x.size")) & (F.col("_d") == F.col("x.c")))
    both = one.join(known.alias("y"), (F.col("_token") == F.col("y.token")) & (F.col("_size") == F.col("y.size")) & (F.col("_c") == F.col("y.c")))
    return _pairs(both.where(could_link("x", "y", percent)))


def sharing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share a prefix token under every further order. Only the prefixes of their rows are read."""
    orders = [f"p{i + 1}" for i in range(len(FACTORS))]
    pairs = staged(pairs)
    rows = _only(sets.select("row", *orders), pairs)
    x, y = rows.alias("x"), rows.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.row")).join(y, F.col("b") == F.col("y.row"))
    for order in orders:
        met = met.where(F.arrays_overlap(f"x.{order}", f"y.{order}"))
    return staged(met.select("a", "b"))


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``rows`` that stand in ``pairs``."""
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    if wanted.count() <= SHORT_ROWS:  # a number each
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "row", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, heads: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """a, b: the pairs that share prefix tokens under every further order and whose sets are near enough."""
    kept = sharing(pairs, sets)
    whole = whole_sets(docs, heads, kept.select(F.explode(F.array("a", "b")).alias("row")).distinct(), k)
    x, y = whole.alias("x"), whole.alias("y")
    common = F.size(F.array_intersect("x.tokens", "y.tokens"))
    near = common * 100 >= (F.col("x.n") + F.col("y.n") - common) * percent
    return staged(kept.join(x, F.col("a") == F.col("x.row")).join(y, F.col("b") == F.col("y.row")).where(near).select("a", "b"))


def set_links(docs: DataFrame, sets: DataFrame, heads: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """a, b: links between rows of ``heads`` (one for each distinct set) that span every component."""
    lists = prefix_lists(sets, heads, percent)
    stars = verified(star_pairs(lists, percent), docs, sets, heads, percent, k)
    rest = verified(open_pairs(lists, components(stars), percent), docs, sets, heads, percent, k)
    return stars.unionAll(rest)


def distinct_sets(sets: DataFrame) -> DataFrame:
    """row, k1, k2, least: for each distinct set that is not empty one of its rows and its smallest id."""
    return staged(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")))


def near_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each input row; component_id is the smallest doc_id that links reach.

    Two rows link when 100 times the shingles they share is at least ``percent`` times the shingles of either. Null and
    empty texts and texts of white space have no shingles and link with nothing: their component is their own id.
    Repeated rows and equal sets link (a set is as near to itself as can be), each row is returned. A row without id
    takes the component of its links; a component without any id has a null id. Columns other than doc_id and text are
    not read. An empty table has no rows.
    """
    sets = token_sets(docs, percent, k)
    heads = distinct_sets(sets)
    reached = components(set_links(docs, sets, heads, percent, k))
    rooted = staged(heads.join(reached, F.col("row") == F.col("vertex"), "left").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "least", F.coalesce("root", "row").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("_k1", "_k2", "component_id")
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") > 0)
    return sets.select("doc_id", "n", "k1", "k2").join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
