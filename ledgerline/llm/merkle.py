"""Merkle manifest of a dataset: a tree of digests for each part, a root over the parts, and a proof for every row.

A tree is stored as aligned subtrees ("blocks") of ``2 ** BLOCK_LEVELS`` leaves. Inside a block the digests stand in
van Emde Boas order: the tree is split at half its height, the upper half stands first, then each lower subtree, all
of them split again in the same way. :func:`address` computes the place of a node; building a block and finding
siblings use nothing else. The roots of the blocks are the leaves of the next level of blocks, and so on to one block.

A parent is the SHA-256 of its children's hexadecimal digests; a child without a sibling is hashed alone. Leaves get
their places from a range sort: the place inside the sorted task plus the sizes of the tasks before it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged

BLOCK_LEVELS, SIZE = 10, 32
LEFT, RIGHT, ALONE = b"\x00", b"\x01", b"\x02"  # where a sibling stands
EMPTY = bytes(SIZE)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the nodes ``index`` at ``depth`` (0: the root) of a tree of ``levels`` levels."""
    index, base = np.asarray(index, np.int64), 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, depth = levels - upper, depth - upper
        base = base + (1 << upper) - 1 + (index >> depth) * ((1 << lower) - 1)
        index, levels = index & ((1 << depth) - 1), lower
    return base + np.zeros_like(index)


def digest(*children: bytes) -> bytes:
    """SHA-256 over the hexadecimal digests of the children."""
    return hashlib.sha256(b"".join(child.hex().encode() for child in children)).digest()


def height(total: int, block_levels: int) -> int:
    """Levels of edges in a block of a tree of ``total`` nodes: full blocks, or what a single block needs."""
    return min(block_levels, max(total - 1, 0).bit_length())


def widths(n: int, h: int) -> list[int]:
    """How many nodes stand at each depth, from the root to the ``n`` leaves."""
    return [-(-n // (1 << (h - d))) for d in range(h + 1)]


def build(leaves: list[bytes], h: int) -> list[bytes]:
    """All digests of a block of height ``h`` in van Emde Boas order; places without a node are zero bytes."""
    nodes = [EMPTY] * ((1 << (h + 1)) - 1)
    for at, leaf in zip(address(h + 1, h, np.arange(len(leaves))).tolist(), leaves, strict=True):
        nodes[at] = leaf
    width = widths(len(leaves), h)
    for d in range(h - 1, -1, -1):
        below = address(h + 1, d + 1, np.arange(width[d + 1])).tolist()
        for i, at in enumerate(address(h + 1, d, np.arange(width[d])).tolist()):
            nodes[at] = digest(*(nodes[x] for x in below[2 * i:2 * i + 2]))
    return nodes


def paths(nodes: bytes, n: int, h: int) -> list[bytes]:
    """For each leaf of a block the way to its root: a byte that tells where the sibling stands and its digest, a level each."""
    width = widths(n, h)
    steps = []
    for d in range(h, 0, -1):
        index = np.arange(n) >> (h - d)
        sibling = index ^ 1
        there = sibling < width[d]
        at = address(h + 1, d, np.where(there, sibling, 0))
        steps.append([
            (RIGHT if s > i else LEFT) + nodes[a * SIZE:(a + 1) * SIZE] if k else ALONE + EMPTY
            for i, s, k, a in zip(index.tolist(), sibling.tolist(), there.tolist(), at.tolist(), strict=True)])
    return [b"".join(own) for own in zip(*steps, strict=True)] if steps else [b""] * n


def way(path: bytes) -> list[tuple[bytes, bytes]]:
    """(where the sibling stands, its digest in hexadecimal) for each level of a path; nothing for a missing one."""
    out = []
    for k in range(0, len(path), SIZE + 1):
        side = path[k:k + 1]
        out.append((side, b"" if side == ALONE else path[k + 1:k + 1 + SIZE].hex().encode()))
    return out


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root, in hexadecimal, that a leaf (in hexadecimal) and the way of its siblings lead to."""
    for side, sibling in steps:
        leaf = hashlib.sha256(sibling + leaf if side == LEFT else leaf + sibling).hexdigest().encode()
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: their length in bytes, a colon and the value; a dash for null."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)).cast("binary"), 256))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """part (lang), doc_id, leaf, and other: the leaf with one character more counted, where ``tampered`` and the
    count are not null, else null."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1

    def own(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    return docs.select(F.col("lang").alias("part"), "doc_id", own(F.col("n_chars")).alias("leaf"),
                       F.when(tampered & F.col("n_chars").isNotNull(), own(more)).alias("other"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place (from 0) in ascending order of ``order``, nulls first. Equal rows are told
    apart by where they were read, so a value that very many rows share still spreads over tasks. What is collected
    is one number a task."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    kept = staged(tied.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
                  .withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = sorted(kept.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(itertools.accumulate((n for _, n in sizes), initial=0))
    first = rows.sparkSession.createDataFrame(
        [(k, start) for (k, _), start in zip(sizes, starts, strict=False)], "_task long, _start long")
    return kept.join(F.broadcast(first), task == F.col("_task")).withColumn(
        "pos", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_start", "_at")


BLOCK = "tree long, block long, total long, n int, height int, nodes binary, root binary"


def blocks(nodes: DataFrame, block_levels: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block of ``nodes`` (tree, pos, total: the nodes of its tree, digest). The columns ``carried``
    become arrays in the order of the leaves. A block is a group of at most ``2 ** block_levels`` rows."""
    fed = nodes.select("tree", F.shiftright("pos", block_levels).alias("block"), "pos", "total", "digest", *carried)
    extra = [T.StructField(c, T.ArrayType(fed.schema[c].dataType)) for c in carried]
    kind = T.StructType([*T._parse_datatype_string(BLOCK).fields, *extra])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by("pos")
        tree, block, total = (own.column(c)[0].as_py() for c in ("tree", "block", "total"))
        h = height(total, block_levels)
        made = build(own.column("digest").to_pylist(), h)
        root = made[address(h + 1, 0, np.zeros(1, np.int64))[0]]
        values = [tree, block, total, own.num_rows, h, b"".join(made), root]
        columns = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
        for c in carried:
            held = own.column(c).combine_chunks()
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held))
        return pa.Table.from_arrays(columns, [f.name for f in kind.fields])

    return fed.groupBy("tree", "block").applyInArrow(run, kind)


def forest(nodes: DataFrame, block_levels: int = BLOCK_LEVELS, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The tables of blocks of all trees, level by level; a tree ends at the level where it has a single block."""
    levels = [staged(blocks(nodes, block_levels, carried))]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = levels[-1].where("block > 0 OR total > n").select(
            "tree", F.col("block").alias("pos"), F.expr(f"shiftright(total + {(1 << block_levels) - 1}, {block_levels})").alias("total"),
            F.col("root").alias("digest"))
        levels.append(staged(blocks(above, block_levels)))
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """tree, root: of the single block in which each tree ends."""
    tops = [level.where("block = 0 AND total = n").select("tree", "root") for level in levels]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionAll(top)
    return found


def block_paths(levels: list[DataFrame], tops: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """tree, block, path: the way from the root of every block of the lowest level upwards, ending with the ``path``
    of its tree in ``tops`` (tree, path)."""
    known = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].where("block = 0 AND total = n").select("tree", "block").join(tops, "tree")
        known = own if known is None else own.unionAll(known)
        if k:
            known = staged(node_paths(levels[k], known, block_levels).withColumnRenamed("pos", "block"))
    return known


def node_paths(level: DataFrame, known: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """tree, pos, path: the way from every leaf of the blocks of ``level``, whose own ways (tree, block, path) are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, block, n, h, nodes, path = (c[row].as_py() for c in batch.columns)
                first = block << block_levels
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                     pa.array([p + path for p in paths(nodes, n, h)], pa.binary())], ["tree", "pos", "path"])

    fed = level.join(known, ["tree", "block"]).select("tree", "block", "n", "height", "nodes", "path")
    return fed.mapInArrow(run, "tree long, pos long, path binary")


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a manifest, a block each: what every leaf proves."""
    for batch in batches:
        for row in range(batch.num_rows):
            n, h, nodes, path, subroot, root, leaves = (batch.column(c)[row].as_py() for c in (
                "n", "height", "nodes", "path", "subroot", "root", "leaves"))
            above, root = way(path), root.hex()
            leaf, proof, folded = [], [], []
            places = address(h + 1, h, np.arange(n)).tolist()
            for at, own, other in zip(places, paths(nodes, n, h), leaves, strict=True):
                steps = way(own) + above
                leaf.append(nodes[at * SIZE:(at + 1) * SIZE].hex())
                proof.append(hashlib.sha256(b"".join([s for _, s in steps])).hexdigest())
                folded.append(fold((other["other"] or nodes[at * SIZE:(at + 1) * SIZE]).hex().encode(), steps).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["doc_id"] for x in leaves], batch.schema.field("leaves").type.value_type.field("doc_id").type),
                 pa.array(leaf), pa.array([subroot.hex()] * n), pa.array([root] * n), pa.array(proof), pa.array(folded),
                 pa.array([f == root for f in folded])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, tampered: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The lowest level of blocks of all parts: tree (rank of the part), block, total, n, height, nodes (van Emde Boas
    order), root (of the block), leaves (doc_id and the tampered digest of each), path (from the block's root up to
    the root of all), subroot, and ``top``, the root of all."""
    leaves = staged(document_leaves(docs, tampered))
    placed = staged(numbered(leaves, "part", "doc_id", "leaf"))
    parts = placed.groupBy("part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("total"))
    ranked = staged(numbered(parts, "part").select(F.col("part").alias("_part"), F.col("pos").alias("tree"), "first", "total"))
    nodes = placed.join(ranked, F.col("part").eqNullSafe(F.col("_part"))).select(
        "tree", (F.col("pos") - F.col("first")).alias("pos"), "total", F.col("leaf").alias("digest"), F.struct("doc_id", "other").alias("leaves"))
    levels = forest(nodes, block_levels, ("leaves",))
    roots = staged(tree_roots(levels))
    # The roots of the parts are the leaves of one more tree, made and walked in the same way.
    upper = forest(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(roots.count()).alias("total"),
                                F.col("root").alias("digest")), block_levels)
    whole = tree_roots(upper).select(F.col("root").alias("top"))
    start = whole.select(F.lit(0).cast("long").alias("tree"), F.lit(b"").alias("path"))
    tops = node_paths(upper[0], block_paths(upper, start, block_levels), block_levels).select(F.col("pos").alias("tree"), "path")
    known = block_paths(levels, tops, block_levels).join(roots.select("tree", F.col("root").alias("subroot")), "tree")
    return levels[0].join(known, ["tree", "block"]).crossJoin(F.broadcast(whole))


def proofs(docs: DataFrame, tampered: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each input row.

    Parts are the values of lang, null being a part of its own before all others, "" another. Leaves ascend by doc_id,
    rows without id first, rows that share an id by digest; repeated rows are leaves each. Null fields count as a
    dash, so null and empty texts differ. Where ``tampered`` is null or n_chars is null nothing is tampered with. An
    empty table has no rows. Columns other than doc_id, source, lang, n_chars and text are not read.
    """
    rows = manifest(docs, tampered, block_levels).select(
        "n", "height", "nodes", "path", "subroot", F.col("top").alias("root"), "leaves")
    text = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return rows.mapInArrow(_proofs, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *text,
                                                  T.StructField("verified", T.BooleanType())]))
