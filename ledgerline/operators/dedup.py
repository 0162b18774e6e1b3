"""One best record per flight instance, and why the others lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    COMPLETENESS_FIELDS, DUPLICATE, DUPLICATE_AUDIT_COLUMNS, RESULT_COLUMNS,
)
from ledgerline.functions.text import field
from ledgerline.functions.times import message_number, priority_timestamp
from ledgerline.operators.instances import assign_flight_instance_keys

RANKING = ["HAS_MOVEMENT_TIME", "COMPLETENESS_SCORE", "_priority_timestamp", "_message_number"]


def completeness_score(fields: Sequence[str] = COMPLETENESS_FIELDS) -> Column:
    """How many of the fields are filled."""
    score = F.lit(0)
    for name in fields:
        score = score + field(name).isNotNull().cast("int")
    return score


def ranking_columns(fields: Sequence[str] = COMPLETENESS_FIELDS) -> dict[str, Column]:
    return {
        "COMPLETENESS_SCORE": completeness_score(fields),
        "HAS_MOVEMENT_TIME": F.col("DAT_MOVEMENT_DATETIME").isNotNull(),
        "_priority_timestamp": priority_timestamp(F.col("TIMESTAMP")),
        "_message_number": message_number(F.col("MESSAGE NUM")),
    }


def best_per_instance(eligible: DataFrame, key: str = "FLIGHT_INSTANCE_KEY") -> DataFrame:
    """Winner of every instance as one struct, combined on the map side.

    A NULL version or message sorts below every value, which is where a missing one
    belongs; the source row makes the order total.
    """
    order = F.struct(*RANKING, "SOURCE ROW", "SOURCE DATA")
    return eligible.groupBy(key).agg(F.max(order).alias("_winner"))


def loser_reason(winner: Column) -> Column:
    """First ranking criterion on which a record falls behind its winner."""
    def older(name: str) -> Column:
        mine, best = F.col(name), winner[name]
        return best.isNotNull() & (mine.isNull() | (mine < best))

    return (
        F.when(winner["HAS_MOVEMENT_TIME"] & ~F.col("HAS_MOVEMENT_TIME"),
               "MOVEMENT TIME EMPTY; BETTER RECORD SELECTED")
        .when(F.col("COMPLETENESS_SCORE") < winner["COMPLETENESS_SCORE"], "LOWER COMPLETENESS SCORE")
        .when(older("_priority_timestamp"), "OLDER TIMESTAMP")
        .when(older("_message_number"), "LOWER MESSAGE NUMBER")
        .otherwise("LOWER PRIORITY DUPLICATE; STABLE TIE-BREAK")
    )


def select_best(df: DataFrame) -> DataFrame:
    """Flag the selected record per instance and give the losers their reason.

    Winners come from a partial aggregation; the join back is many-to-one, so a hot
    instance is a skewed row side that adaptive execution may split freely.
    """
    ranked = df.withColumns(ranking_columns())
    used = F.coalesce(F.col("USED_FOR_RECOVERY"), F.lit(False))
    winners = best_per_instance(ranked.where(F.col("_complete_key") & ~used))
    joined = ranked.join(winners, "FLIGHT_INSTANCE_KEY", "left")
    winner = F.col("_winner")
    is_winner = (winner["SOURCE ROW"] == F.col("SOURCE ROW")) & (winner["SOURCE DATA"] == F.col("SOURCE DATA"))
    selected = ~used & (~F.col("_complete_key") | F.coalesce(is_winner, F.lit(False)))
    reason = (
        F.when(used, "USED FOR ADJACENT DATE MIDNIGHT RECOVERY")
        .when(winner.isNull(), "NON-SELECTED FLIGHT INSTANCE")
        .otherwise(loser_reason(winner))
    )
    return joined.withColumns({
        "SELECTED_RECORD_FLAG": selected,
        "SELECTED DAT RECORD": selected,
        "DUPLICATE_REASON": F.when(~selected, reason),
    }).drop("_winner")


def deduplicate_dat(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected records and duplicates of key-prepared movements."""
    resolved = select_best(assign_flight_instance_keys(df))
    duplicates = resolved.where(~F.col("SELECTED_RECORD_FLAG")).withColumns({
        "STATUS": F.lit(DUPLICATE), "MATCH_REASON": F.col("DUPLICATE_REASON"),
    })
    return resolved.where("SELECTED_RECORD_FLAG").drop("DUPLICATE_REASON"), duplicates


def duplicate_output(duplicates: DataFrame) -> DataFrame:
    """Duplicate table with its audit columns."""
    return duplicates.select(
        *RESULT_COLUMNS, "SOURCE DATA", "SOURCE ROW", "STATUS", "MATCH_REASON", *DUPLICATE_AUDIT_COLUMNS
    )
