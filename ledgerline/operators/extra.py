"""Billing rows that no record looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.constants import DEFAULT_TOLERANCE_MINUTES
from ledgerline.functions.times import minutes_apart
from ledgerline.operators.lookup import LOOKUP_KEYS, indexed, search_records, time_cell
from ledgerline.operators.nearest import nearest

ANY_REGISTER = "*"


def touched_by_remark(records: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Special rows with a record close in time that does not contradict their register.

    Only the nearest record of the same register, of no register, or (for a row without
    register) of any, has to be looked at; both sides are folded to their distinct times
    before the sorted pass.
    """
    scope = ["flight", "move", "_cell"]
    rows = others.where(
        F.col("r_special") & F.col("r_at").isNotNull() & F.col("flight").isNotNull() & F.col("move").isNotNull()
    ).select("flight", "move", "r_row", "r_register", F.col("r_at").alias("at"),
             time_cell(F.col("r_at"), tolerance).alias("_cell"))
    near = F.explode(F.array(*[time_cell(F.col("l_at"), tolerance) + step for step in (-1, 0, 1)]))
    beside = records.select("flight", "move", "l_register", F.col("l_at").alias("at"), near.alias("_cell")).join(
        rows.select(*scope).distinct(), scope, "left_semi"
    )
    slots = F.array(F.lit(ANY_REGISTER), F.coalesce("l_register", F.lit("")))
    times = beside.select(*scope, "at", F.explode(slots).alias("_slot")).distinct().withColumn("_seen", F.lit(True))
    mine = F.col("r_register")
    asked = F.when(mine.isNull(), F.array(F.lit(ANY_REGISTER))).otherwise(F.array(mine, F.lit("")))
    moments = rows.select(*scope, "at", F.explode(asked).alias("_slot")).distinct()
    beside = nearest(moments, times, [*scope, "_slot"], "at", ["_seen"])
    away = F.least(*[minutes_apart(F.col(side)["at"], F.col("at")) for side in ("before", "after")])
    met = beside.where(away <= tolerance).select(*scope, "at", "_slot")
    return rows.withColumn("_slot", F.explode(asked)).join(met, [*scope, "at", "_slot"], "left_semi").select("r_row")


def looked_at(records: DataFrame, others: DataFrame, tolerance: float = DEFAULT_TOLERANCE_MINUTES) -> DataFrame:
    """Distinct rows of the other side that are a candidate of some record."""
    asked = search_records(records).select(*LOOKUP_KEYS).distinct()
    by_date = indexed(others).join(asked, LOOKUP_KEYS, "left_semi").select("r_row")
    return by_date.unionByName(touched_by_remark(records, others, tolerance)).distinct()


def extra_rows(
    prepared: DataFrame, records: DataFrame, others: DataFrame,
    tolerance: float = DEFAULT_TOLERANCE_MINUTES,
) -> DataFrame:
    rows = looked_at(records, others, tolerance)
    return prepared.join(rows, prepared["SOURCE ROW"] == rows["r_row"], "left_anti")
