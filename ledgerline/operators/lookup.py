"""Candidate lookup: which rows of the other side may describe a movement.

``candidate_pairs`` lists every candidate of every record, because the audit trail
reports each one that was not selected; its size is the size of that report.
Everything else (best candidate, extra rows) is answered without listing pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    DEFAULT_TOLERANCE_MINUTES, MODE_ACTUAL, MODE_ORIGINAL, MODE_RECOVERED, MODE_WINDOW,
)
from ledgerline.functions.dates import iso_day
from ledgerline.functions.text import field
from ledgerline.functions.times import format_date, format_datetime, message_number, minutes_apart, priority_timestamp

ROUTE_KEYS = {"flight": "FLIGHT NUMBER", "adep": "AERODROME", "ades": "TO FROM", "move": "D/A/L/O"}
LOOKUP_KEYS = [*ROUTE_KEYS, "by", "date"]
SPECIAL_KEYS = ["flight", "move", "_cell"]
BY_MOVEMENT, BY_FLIGHT_DATE = "MOVEMENT DATE", "DATE OF FLIGHT"
# fixed values: date used, mode, index and preference rank of the date lookups, in search order
LOOKUPS = (
    ("ACTUAL MOVEMENT DATE", MODE_ACTUAL, BY_MOVEMENT, 0),
    ("DATE OF FLIGHT", MODE_ORIGINAL, BY_FLIGHT_DATE, 2),
    ("ACTUAL MOVEMENT DATE -1 DAY", MODE_WINDOW, BY_MOVEMENT, 3),
    ("ACTUAL MOVEMENT DATE +1 DAY", MODE_WINDOW, BY_MOVEMENT, 3),
    ("RECOVERED_DAT_DATE", MODE_RECOVERED, BY_FLIGHT_DATE, 1),
)
SPECIAL = len(LOOKUPS)  # the lookup by remark, flight and time
BLOCK_ROWS = 512  # about so many billing rows stand in one block
SPECIAL_DATE_USED, SPECIAL_RANK = "ACTUAL MOVEMENT DATE ±1 DAY", 3  # fixed values


def record_side(unique: DataFrame) -> DataFrame:
    """What the lookup needs of a selected record that has a movement time."""
    return unique.where(F.col("DAT_MOVEMENT_DATETIME").isNotNull()).select(
        F.col("SOURCE DATA").alias("l_data"), F.col("SOURCE ROW").alias("l_row"),
        *[field(c).alias(k) for k, c in ROUTE_KEYS.items()],
        F.col("AC REGISTER").alias("l_register"), F.col("DAT_MOVEMENT_DATETIME").alias("l_at"),
        F.col("DATE OF FLIGHT").alias("l_flight_date"),
        F.col("ACTUAL MOVEMENT DATE").alias("l_moved_on"),
        F.col("DAT_RECOVERY_USED").alias("l_recovered"),
        F.when(F.col("DAT_RECOVERY_USED"), F.col("RECOVERED_DAT_DATE")).alias("l_recovered_on"),
    )


def other_side(prepared: DataFrame) -> DataFrame:
    """What the lookup needs of a billing row."""
    return prepared.select(
        F.col("SOURCE ROW").alias("r_row"),
        *[field(c).alias(k) for k, c in ROUTE_KEYS.items()],
        F.col("AC REGISTER").alias("r_register"), F.col("STREAM_MOVEMENT_DATETIME").alias("r_at"),
        F.col("DATE OF FLIGHT").alias("r_flight_date"),
        F.col("STREAM STATUS FLIGHT").alias("r_status"), F.col("STREAM REMARK").alias("r_remark"),
        F.coalesce("STREAM SPECIAL REMARK FLAG", F.lit(False)).alias("r_special"),
        F.col("SPECIAL REMARK KEYWORD FOUND").alias("r_keyword"),
        priority_timestamp(F.col("TIMESTAMP")).alias("r_version"),
        message_number(F.col("MESSAGE NUM")).alias("r_message"),
    )


def search_specs() -> Column:
    """Ordered lookups of a record: one struct per (index, date), duplicates removed."""
    moved = iso_day(F.col("l_moved_on"))
    dates = (
        F.col("l_moved_on"), F.col("l_flight_date"), F.date_sub(moved, 1).cast("string"),
        F.date_add(moved, 1).cast("string"), F.col("l_recovered_on"),
    )
    specs = []
    for number, ((_, _, index, _), date) in enumerate(zip(LOOKUPS, dates)):
        repeated = F.lit(False)
        for (_, _, earlier_index, _), earlier in zip(LOOKUPS[:number], dates[:number]):
            if earlier_index == index:
                repeated = repeated | earlier.eqNullSafe(date)
        specs.append(F.when(date.isNotNull() & ~repeated, F.struct(
            F.lit(index).alias("by"), date.alias("date"), F.lit(number).alias("lookup"),
        )))
    return F.array_compact(F.array(*specs))


def search_records(records: DataFrame) -> DataFrame:
    """One row per record and lookup; records with an incomplete route search nothing."""
    complete = records
    for key in ROUTE_KEYS:
        complete = complete.where(F.col(key).isNotNull())
    return complete.withColumn("_spec", F.explode(search_specs())).select(
        "*", "_spec.by", "_spec.date", "_spec.lookup"
    ).drop("_spec")


def indexed(others: DataFrame) -> DataFrame:
    """Billing rows under both of their dates: movement date and flight date."""
    entries = F.array(
        F.struct(F.lit(BY_MOVEMENT).alias("by"), format_date(F.col("r_at")).alias("date")),
        F.struct(F.lit(BY_FLIGHT_DATE).alias("by"), F.col("r_flight_date").alias("date")),
    )
    rows = others.withColumn("_entry", F.explode(entries)).select("*", "_entry.by", "_entry.date").drop("_entry")
    for key in LOOKUP_KEYS:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def lookup_pairs(records: DataFrame, others: DataFrame) -> DataFrame:
    """Date lookups as one equi-join; the date is part of the key."""
    return search_records(records).join(indexed(others), LOOKUP_KEYS).drop("by", "date")


def time_cell(at: Column, tolerance: float) -> Column:
    """Number of a cell just wider than the tolerance: close times lie at most one apart."""
    minutes = F.unix_date(at.cast("date")) * 1440 + F.hour(at) * 60 + F.minute(at)
    return F.floor(minutes / (int(tolerance) + 1))


def register_compatible() -> Column:
    return F.coalesce(F.col("l_register") == F.col("r_register"), F.lit(True))


def special_pairs(
    records: DataFrame, others: DataFrame, tolerance: float = DEFAULT_TOLERANCE_MINUTES
) -> DataFrame:
    """Route-relaxed band join on flagged rows, close in time, register not contradictory.

    Time is cut into tolerance-wide cells: a record probes its own cell and both
    neighbours, so the band is part of the equi-key instead of a residual filter.
    """
    left, right = _special_sides(records, others, tolerance)
    return left.join(right, SPECIAL_KEYS).where(_in_band(tolerance)).select("*", F.lit(SPECIAL).alias("lookup")).drop("_cell")


def _special_sides(records: DataFrame, others: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the band join under ``SPECIAL_KEYS``."""
    near = F.explode(F.array(*[time_cell(F.col("l_at"), tolerance) + step for step in (-1, 0, 1)]))
    left = records.where(F.col("flight").isNotNull() & F.col("move").isNotNull()).withColumn("_cell", near)
    right = others.where(F.col("r_special") & F.col("r_at").isNotNull()).withColumn(
        "_cell", time_cell(F.col("r_at"), tolerance)
    ).withColumnsRenamed({"adep": "r_adep", "ades": "r_ades"})
    return left, right


def _in_band(tolerance: float) -> Column:
    close = minutes_apart(F.col("r_at"), F.col("l_at")) <= tolerance
    days = F.abs(F.datediff(F.col("r_at").cast("date"), F.col("l_at").cast("date"))) <= 1
    return register_compatible() & close & days


def same_route() -> Column:
    return F.coalesce((F.col("r_adep") == F.col("adep")) & (F.col("r_ades") == F.col("ades")), F.lit(False))


def shown_times(others: DataFrame) -> DataFrame:
    """Billing rows with their time as text (``r_moved``), written once a row and not once a pair."""
    return others.withColumn("r_moved", format_datetime(F.col("r_at")))


def candidate_pairs(
    records: DataFrame, others: DataFrame, tolerance: float = DEFAULT_TOLERANCE_MINUTES
) -> DataFrame:
    """Every (record, billing row, lookup) that the rules look at; ``r_moved`` is the time of the row as text."""
    others = shown_times(others)
    by_date = lookup_pairs(records, others).withColumns({"r_adep": F.col("adep"), "r_ades": F.col("ades")})
    return by_date.unionByName(special_pairs(records, others, tolerance))


def blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a key as arrays (``_rows``) of about ``BLOCK_ROWS`` each; a hot key has many of them, in many tasks."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    parts = large.select(*keys, F.ceil(F.col("_n") / BLOCK_ROWS).alias("_parts"))
    dealt = rows.join(parts, list(keys), "left").withColumn(
        "_part", F.pmod(F.xxhash64("r_row"), F.coalesce("_parts", F.lit(1).cast("bigint"))))
    row = F.struct(*[c for c in rows.columns if c not in keys])
    return dealt.groupBy(*keys, "_part").agg(F.collect_list(row).alias("_rows")).drop("_part")


def candidate_blocks(
    records: DataFrame, others: DataFrame, tolerance: float = DEFAULT_TOLERANCE_MINUTES
) -> DataFrame:
    """What :func:`candidate_pairs` lists, before it is listed: a row per record, lookup and block of billing rows.

    A table in an order of its records is sorted like this, with one row for some hundred pairs, and listed by
    :func:`listed_blocks` after.
    """
    carried = [
        "r_row", "r_register", "r_at", "r_moved", "r_flight_date", "r_status", "r_remark", "r_special", "r_keyword",
        "r_adep", "r_ades",
    ]
    others = shown_times(others)
    none = F.lit(None).cast("string")
    routed = indexed(others).withColumns({"r_adep": none, "r_ades": none}).select(*LOOKUP_KEYS, *carried)
    by_date = search_records(records).join(blocks(routed, LOOKUP_KEYS), LOOKUP_KEYS).drop("by", "date")
    left, right = _special_sides(records, others, tolerance)
    flagged = right.where(F.col("flight").isNotNull() & F.col("move").isNotNull()).select(*SPECIAL_KEYS, *carried)
    by_remark = left.join(blocks(flagged, SPECIAL_KEYS), SPECIAL_KEYS).drop("_cell").withColumn("lookup", F.lit(SPECIAL))
    return by_date.unionByName(by_remark)


def listed_blocks(packed: DataFrame, tolerance: float = DEFAULT_TOLERANCE_MINUTES) -> DataFrame:
    """The pairs of the blocks in the order of ``packed``, each under its preferred lookup; a row without a block stays
    one row, without a candidate."""
    rows = packed.select("*", F.explode_outer("_rows").alias("_row")).select(
        *[field(c) for c in packed.columns if c != "_rows"], "_row.*")
    wanted = ~_found_elsewhere() & ((F.col("lookup") != SPECIAL) | _in_band(tolerance))
    return rows.where(F.col("lookup").isNull() | F.coalesce(wanted, F.lit(False)))


def preferred_lookup(pairs: DataFrame) -> DataFrame:
    """Each (record, billing row) once, under the lookup that ranks best.

    Lookups overlap in a known way, so no grouping is needed: a row of the record's own
    movement date counts there and not under its flight date, a row with one of the
    record's flight dates counts there and not in the date window, and a special row of
    the same route was found by date already.
    """
    return pairs.where(~_found_elsewhere())


def _found_elsewhere() -> Column:
    lookup = F.col("lookup")
    own_day = F.col("l_moved_on").eqNullSafe(F.substring("r_moved", 1, 10))
    own_flight_date = F.coalesce(
        F.col("r_flight_date").isin(F.col("l_flight_date"), F.col("l_recovered_on")), F.lit(False)
    ) | F.col("r_flight_date").eqNullSafe(F.col("l_flight_date"))
    return (
        F.when(lookup.isin(1, 4), own_day).when(lookup.isin(2, 3), own_flight_date)
        .when(lookup == SPECIAL, same_route()).otherwise(F.lit(False))
    )
