"""Exact top-k inner products by MaxScore over sharded postings.

A vector component is a term: dimension d with a positive or a negative value. A query's postings are those whose sign
makes the product positive; all other products only lower a score, so the positive ones bound it. In a shard
the postings of a term are its rows and values, and the largest of them times the query's weight bounds the term. Terms
are ordered by that bound; those whose bounds together cannot reach the k-th best score so far are not essential. Rows
are found by traversing essential postings only; then the other terms are probed for the rows still competitive, the
strongest first, dropping rows as their bound falls short. Shards are searched apart and their best rows merged.

Queries are dealt in blocks and rows in shards of bounded size, and each block meets each shard in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ROWS, BLOCK_ROWS, PROBES = 8192, 4096, 8


class Shard:
    """Rows of one shard sorted by id, and for every signed dimension its postings."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.postings = {}
        for d, column in enumerate(self.columns):
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                if len(rows):
                    self.postings[d, sign] = rows, column[rows], int(np.abs(column[rows]).max())

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows; ties to the smaller id; rows with the query's id do not count."""
        terms = [(abs(int(query[d])) * self.postings[d, s][2], d, s) for d in np.flatnonzero(query)
                 if (s := 1 if query[d] > 0 else -1, d) and (d, s) in self.postings]
        terms.sort(reverse=True)
        own = self.ids == query_id
        least = -np.inf
        if self.vectors.dtype == object:  # bounds in floating point would not be exact
            return self._best(np.flatnonzero(~own), query, k)
        first = self._start(query, terms, own, k)
        if len(first) == k:
            least = first.min()
        bounds = np.array([t[0] for t in terms], dtype=float)
        rest = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0.0]))  # what the terms from here on can add
        essential = int(np.count_nonzero(rest[:-1] >= least)) if least > 0 else len(terms)
        if least <= 0:  # a row in no posting scores at most 0 and may still be among the best
            alive = np.flatnonzero(~own)
            upper = np.full(len(alive), rest[0])
        else:
            seen = np.zeros(len(self.ids), dtype=self.vectors.dtype)
            for _, d, s in terms[:essential]:
                rows, values, _ = self.postings[d, s]
                seen[rows] += query[d] * values
            alive = np.flatnonzero((seen > 0) & ~own & (seen + rest[essential] >= least))
            upper = seen[alive] + rest[essential]
            for at in range(essential, len(terms), PROBES):
                if len(alive) <= 4 * k:
                    break
                batch = [t[1] for t in terms[at:at + PROBES]]
                products = self.columns[batch][:, alive] * query[batch][:, None]
                upper = upper - (rest[at] - rest[min(at + PROBES, len(terms))]) + np.maximum(products, 0).sum(0)
                keep = upper >= least
                alive, upper = alive[keep], upper[keep]
        return self._best(alive, query, k)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    def _start(self, query: np.ndarray, terms: list, own: np.ndarray, k: int) -> np.ndarray:
        """Scores of k rows that stand high in the strongest postings, for a first threshold."""
        rows = []
        for _, d, s in terms[:4]:
            at, values, _ = self.postings[d, s]
            top = min(4 * k, len(at))
            rows.append(at[np.argpartition(-np.abs(values), top - 1)[:top]])
        rows = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
        rows = rows[~own[rows]]
        return np.sort(self.vectors[rows] @ query)[::-1][:k]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs, shorter vectors filled with zeros; Python integers where a sum could leave the range of a long."""
    rows = column.combine_chunks()
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: components as floor(256 * x); rows with a null id, a null vector or a component that is null or not
    finite take no part."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & x.isNotNull() & ~odd).select(
        "vec_id", F.transform("x", lambda e: F.floor(e * 256).cast("long")).alias("v"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows (vec_id, v) of every query (vec_id, v) by integer inner product.

    Ties go to the smaller id; rows with the query's own id are no candidates; repeated rows are a candidate
    each, and a repeated query is one query (of several vectors with one id the first by value). Where vectors differ in length
    the missing components are zero. Scores beyond the range of a long are cut to it. With no rows there is no result.
    """
    one = Window.partitionBy("vec_id").orderBy("v")
    asked = queries.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("vec_id", "v")
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asked, asked_width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards, blocks, width = -(-n_rows // SHARD_ROWS) or 1, -(-n_asked // BLOCK_ROWS) or 1, max(width or 0, asked_width or 0)
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    every_block, every_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, shards))
    left = rows.select("vec_id", "v", shard).select("vec_id", "v", "shard", every_block.alias("block"))
    right = asked.select("vec_id", "v", block).select("vec_id", "v", "block", every_shard.alias("shard"))

    def search(found: pa.Table, queries: pa.Table) -> pa.Table:
        vectors, asked = _matrix(found.column("v"), width), _matrix(queries.column("v"), width)
        most = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).max(initial=0)) * width
        if most >= 2**52:
            vectors, asked = vectors.astype(object), asked.astype(object)
        own = Shard(found.column("vec_id").to_numpy(), vectors)
        out = [(q, *own.search(int(q), v, k)) for q, v in zip(queries.column("vec_id").to_numpy(), asked, strict=True)]
        limit = 2**63 - 1
        return pa.table({
            "query_id": pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in out]) if out else [], pa.int64()),
            "score": pa.array([max(-limit - 1, min(limit, int(s))) for _, _, all_s in out for s in all_s], pa.int64())})

    best = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
