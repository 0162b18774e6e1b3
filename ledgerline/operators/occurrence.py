"""Occurrence numbers inside a key, in file order, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 1_000_000


def occurrence_number(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str = "occurrence",
    block: Column | None = None,
) -> DataFrame:
    """Add the zero-based position of each row among the rows of its key.

    A plain row number would sort a hot key in one task. Instead ``block`` (any coarse
    value that never falls along ``order_by``; by default a million consecutive values
    of a numeric first order column) splits every key into runs: rows are numbered inside
    (key, block) and shifted by the counts of the key's earlier blocks. Keys that fit
    one block need no shift, so the helper table is small. Blank equals blank.
    """
    if block is None:
        block = F.floor(F.col(order_by[0]) / BLOCK_ROWS)
    blocked = df.withColumn("_block", block)
    within = Window.partitionBy(*keys, "_block").orderBy(*order_by)
    numbered = blocked.withColumn("_within", F.row_number().over(within) - 1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
        .withColumn("_shift", F.sum("_rows").over(earlier)).where(F.col("_shift") > 0)
        .select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_block").alias("_sb"), "_shift")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    condition = reduce(Column.__and__, same, F.col("_block").eqNullSafe(F.col("_sb")))
    joined = numbered.join(shifts, condition, "left")
    value = F.col("_within") + F.coalesce(F.col("_shift"), F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], value.cast("bigint").alias(name))
