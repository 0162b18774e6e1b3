"""Nearest-in-time lookup without pairing up the members of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest(
    probes: DataFrame,
    references: DataFrame,
    by: Sequence[str],
    at: str,
    rank: Sequence[str],
    carry: Sequence[str] = (),
    with_totals: bool = False,
) -> DataFrame:
    """Every probe with the references next to it, before and after, in its group.

    ``probes`` and ``references`` share the group columns ``by`` and the timestamp
    ``at``; probe columns are kept. ``rank`` lists reference columns that decide
    between references of one instant (larger wins), ``carry`` further columns to bring
    along. The result adds the structs ``before`` and ``after``; each holds ``at``,
    ``rank`` and ``carry`` or is NULL. ``with_totals`` also adds ``found``, the number of
    references in the group, and ``any``, one of them.

    One shuffle of probes plus references and two sorted passes (totals are an aggregate of their own): the cost is
    linear in the rows, never the product of a group's sides.
    """
    payload = [*rank, *carry]
    extra = [c for c in probes.columns if c not in by and c != at]
    both = probes.select(*by, at, F.struct(*extra).alias("_probe")).unionByName(
        references.select(*by, at, F.struct(*payload).alias("_reference")), allowMissingColumns=True
    )
    since = F.col(at) - F.lit("1970-01-01").cast("timestamp_ntz")
    is_reference = F.col("_reference").isNotNull()

    def key(sign: int) -> Column:
        """Largest for the reference closest to the probe in a pass's direction."""
        value = F.struct(
            (since if sign > 0 else -since).alias("_order"), F.col(at).alias("at"),
            *[F.col("_reference")[p].alias(p) for p in payload],
        )
        return F.when(is_reference & F.col(at).isNotNull(), value)

    passed = (Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*by).orderBy(F.col(at).asc(), is_reference.desc()).rowsBetween(*passed)
    back = Window.partitionBy(*by).orderBy(F.col(at).desc(), is_reference.desc()).rowsBetween(*passed)
    seen = both.withColumn("_before", F.max(key(1)).over(ahead)).withColumn("_after", F.max(key(-1)).over(back))
    has_time = F.col(at).isNotNull()
    found = seen.where(F.col("_probe").isNotNull()).select(
        *by, at, *[F.col("_probe")[c].alias(c) for c in extra],
        F.when(has_time, F.col("_before").dropFields("_order")).alias("before"),
        F.when(has_time, F.col("_after").dropFields("_order")).alias("after"),
    )
    if not with_totals:
        return found
    # Aggregated before the shuffle and picked up in a many-to-one join: no group is held in one task.
    totals = references.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(
        F.count("*").alias("_found"), F.max(F.struct(*payload)).alias("any"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return found.join(totals, same, "left").select(*found.columns, F.coalesce("_found", F.lit(0)).alias("found"), "any")
