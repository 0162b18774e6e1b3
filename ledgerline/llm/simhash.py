"""SimHash near-duplicates: 64-bit fingerprints, a binary trie self-join, and the components of the links.

Fingerprints are cut into ``b`` runs of bits. Two that differ in at most ``d`` bits agree on some ``b - d`` whole
runs, so for every choice of ``b - d`` runs the fingerprints are dealt by those bits: each deal is one subtree of a
trie that reads the chosen bits first, and node pairs off the diagonal at that depth need no visit. ``b`` follows the
number of distinct fingerprints so that subtrees of unrelated ones stay small; any ``b`` finds the same links.
A subtree above ``NODE_ROWS`` is dealt into parts by hash, and every pair of parts is joined by itself.

Inside a task, pairs of trie nodes are walked down together, all subtrees side by side: the differing bits so far are
carried along, and a pair is dropped when they exceed the budget, or when both nodes lie wholly in one component
already (found before from neighbours in sorted order). So dense groups cost neither pairs nor rows: a task returns a
forest of links. Links are between distinct fingerprints only; components are found on those, not on documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, text_batches
from ledgerline.llm.components import components

SEED, BITS = 42, 64
NODE_ROWS = 8192
FRONTIER, SHINGLE_CHUNK = 1 << 20, 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed long: bit k is 1 where over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLE_CHUNK):
        hashes = [_hash(joined[a:b]) for a, b in zip(starts[at:at + SHINGLE_CHUNK], ends[at:at + SHINGLE_CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            ones += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, fp (signed long): a row for each input row; null and empty texts have fingerprint 0."""
    fed = text_batches(docs).select("doc_id", *keep, F.col("text").alias("_llm_text"))
    fields = fed.schema.fields[:-1]
    names = [*(f.name for f in fields), "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint_of(x.as_py(), shingle) for x in batch.columns[-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names)

    return fed.mapInArrow(run, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def run_masks(n_prints: int, distance: int) -> list[int]:
    """Masks (signed longs) of the bits on which each deal agrees; few enough runs to keep the deals few, enough for
    subtrees of unrelated fingerprints to hold about a thousand of them."""
    runs = distance + 1
    while runs < 12 and n_prints / 2 ** (BITS * (runs - distance) / runs) > 1024:
        runs += 1
    edges = [round(i * BITS / runs) for i in range(runs + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in itertools.combinations(bits, runs - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each one's component after adding the links a-b to ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _trie_links(prints: np.ndarray, label: np.ndarray, pairs: list[tuple[int, int, int, int]], distance: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``prints`` (unsigned; sorted inside each range) between the ranges of each pair (a0, a1, b0, b1),
    without those inside one component of ``label``. Walks node pairs level by level, at most FRONTIER at a time."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    work = [(np.array(pairs, np.int64).reshape(-1, 4), np.zeros(len(pairs), np.int64), 0)]
    change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))  # equal at both ends: one component between
    while work:
        nodes, differ, depth = work.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            work += [(nodes[:half], differ[:half], depth), (nodes[half:], differ[half:], depth)]
            continue
        a0, a1, b0, b1 = nodes.T
        keep = (a1 > a0) & (b1 > b0) & (differ <= distance)
        a0, a1, b0, b1, differ = (v[keep] for v in (a0, a1, b0, b1, differ))
        one = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])
        a0, a1, b0, b1, differ = (v[~one] for v in (a0, a1, b0, b1, differ))
        small = ((a1 - a0) * (b1 - b0) <= 64) | (depth == BITS)
        if small.any():  # leaves: compare what is below both nodes
            sa, sb, na, nb = a0[small], b0[small], (a1 - a0)[small], (b1 - b0)[small]
            count = na * nb
            owner = np.repeat(np.arange(len(count)), count)
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            x, y = sa[owner] + within // nb[owner], sb[owner] + within % nb[owner]
            hit = (x != y) & (label[x] != label[y])
            x, y = x[hit], y[hit]
            hit = _near(prints[x], prints[y], distance)
            found_a.append(x[hit])
            found_b.append(y[hit])
            a0, a1, b0, b1, differ = (v[~small] for v in (a0, a1, b0, b1, differ))
        if len(a0):
            bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
            ones = np.concatenate(([0], np.cumsum((prints & bit) != 0)))
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # sorted: those with the bit come last
            mirror = (a0 == b0) & (a1 == b1)
            child = [np.stack(v, 1) for v in ((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm))]
            child[3] = child[3][~mirror]
            work.append((np.concatenate(child), np.concatenate([differ, differ, differ + 1, (differ + 1)[~mirror]]), depth + 1))
    return np.concatenate(found_a), np.concatenate(found_b)


def node_forest(node: np.ndarray, part: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that span the components of every node; ``part`` tells the two sides of a
    node pair apart (0 and 1; a node joined with itself has 0 only). Rows of a node must stand together."""
    prints = prints.astype(np.uint64)
    order = np.lexsort((prints, part, node))
    node, part, prints = node[order], part[order], prints[order]
    label = np.arange(len(prints))
    for turn in range(0, BITS, 16):  # neighbours in four sorted orders show most of a dense group
        turned = (prints << np.uint64(turn)) | (prints >> np.uint64(BITS - turn)) if turn else prints
        by = np.lexsort((turned, node))
        a, b = by[:-1], by[1:]
        hit = (node[a] == node[b]) & _near(prints[a], prints[b], distance)
        label = _roots(len(prints), a[hit], b[hit], label)
    edge = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (part[1:] != part[:-1]), [True])))
    ranges = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    pairs = []
    for k, (lo, hi) in enumerate(ranges):
        if part[lo] == 0:
            other = ranges[k + 1] if k + 1 < len(ranges) and node[ranges[k + 1][0]] == node[lo] else None
            pairs.append((lo, hi, *(other or (lo, hi))))
    a, b = _trie_links(prints, label, pairs, distance)
    label = _roots(len(prints), a, b, label)
    link = np.flatnonzero(label != np.arange(len(prints)))
    signed = prints.view(np.int64)
    x, y = signed[link], signed[label[link]]
    return x[x != y], y[x != y]


def print_links(prints: DataFrame, distance: int) -> DataFrame:
    """a, b: links between distinct fingerprints (``fp``) of at most ``distance`` bits that span every component."""
    masks = run_masks(prints.count(), distance)
    dealt = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select(
        "fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"))
    sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a node hash shared by two deals joins more, never less
    parts = F.ceil(F.col("n") / NODE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    sided = dealt.join(sizes.select("node", parts.alias("parts")), "node").withColumn("own", own)
    pairs = sided.select("fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        (F.col("own") > F.col("other")).cast("int").alias("part"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)]
            a, b = node_forest(*cols, distance)
            held.clear()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # a node is at most 2 * NODE_ROWS rows; solve whenever one has ended
            if held and sum(b.num_rows for b in held) >= 4 * NODE_ROWS:
                tail = held[-1].column(0)[-1].as_py()
                changed = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False) != tail)
                if len(changed):
                    held.append(batch.slice(0, int(changed[0])))
                    batch = batch.slice(int(changed[0]))
                    yield from solved()
            held.append(batch)
        if held:
            yield from solved()

    return pairs.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def fingerprint_components(prints: DataFrame, distance: int) -> DataFrame:
    """_fp, root: every distinct fingerprint of ``prints`` with one fingerprint that stands for its component."""
    distinct = prints.select(F.col("fp").alias("_fp")).distinct()
    reached = components(print_links(staged(prints.select("fp").distinct()), distance))  # linked fingerprints only
    return distinct.join(reached, distinct["_fp"] == reached["vertex"], "left").select(
        "_fp", F.coalesce("root", "_fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each input row; component_id is the smallest doc_id that links reach.

    Null and empty texts share fingerprint 0, which links like any other. Repeated rows each get a row. A row without
    id takes the component of its text; a component whose ids are all null has a null id. Other columns are not read.
    """
    prints = staged(fingerprints(docs, shingle))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "_of")
    rooted = fingerprint_components(prints, distance).join(least, F.col("_fp") == F.col("_of"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component, all its columns as they were: the row of the smallest id, rows without
    id last; of several rows with that id the one whose id and text hash lowest; one row if those repeat."""
    first, second = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")
    prints = staged(fingerprints(docs, shingle, keep=(first.alias("k1"), second.alias("k2"))))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    least = prints.groupBy("fp").agg(F.min(rank).alias("least")).withColumnRenamed("fp", "_of")
    rooted = fingerprint_components(prints, distance).join(least, F.col("_fp") == F.col("_of"))
    best = rooted.groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.k1").alias("_llm_k1"), F.col("least.k2").alias("_llm_k2"))
    one = Window.partitionBy("_llm_k1", "_llm_k2").orderBy("_llm_k1")
    return (
        docs.withColumns({"_llm_k1": first, "_llm_k2": second}).join(best, ["_llm_k1", "_llm_k2"])
        .withColumn("_llm_copy", F.row_number().over(one)).where("_llm_copy = 1").select(*docs.columns)
    )
