"""Match keys of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import MATCH_KEY_COLUMNS
from ledgerline.functions.text import duplicate_group_key, field
from ledgerline.functions.times import format_date

MOVEMENT_KEY_COLUMNS = ["FLIGHT NUMBER", "AERODROME", "TO FROM", "D/A/L/O"]
SPECIAL_KEY_COLUMNS = ["FLIGHT NUMBER", "D/A/L/O"]


def all_present(columns: list[Column]) -> Column:
    complete = F.lit(True)
    for c in columns:
        complete = complete & c.isNotNull()
    return complete


def prepare_keys(df: DataFrame) -> DataFrame:
    """Completeness flags, movement date and the readable group key.

    The key columns themselves are the keys; blank parts are NULL, so incomplete keys
    never meet in an equi-join and need no synthetic ids.
    """
    moved = format_date(F.col("MOVEMENT_DATETIME"))
    return df.withColumns({
        "_movement_date": moved,
        "_complete_key": all_present([field(c) for c in MATCH_KEY_COLUMNS]),
        "_complete_movement_key": all_present([moved, *[field(c) for c in MOVEMENT_KEY_COLUMNS]]),
        "_complete_special_key": all_present([field(c) for c in SPECIAL_KEY_COLUMNS]),
        "DUPLICATE_GROUP_KEY": duplicate_group_key(*[field(c) for c in MATCH_KEY_COLUMNS]),
    })
