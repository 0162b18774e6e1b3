"""Adjacent-date recovery: movement times a midnight roll-over put on the next day.

A target is a movement without its time; a source is a movement of the same identity
(flight, origin, destination, direction) one flight date later whose time lies between
23:00 and 06:00. Targets choose in (date, row) order, every source serves once.

How the choice is distributed
-----------------------------
A target at date D has no time and its sources, at D+1, have one, so the groups
(identity, D) never influence each other. Inside a group all targets want the earliest
source that is not before their own earliest time (ties: newest version, highest message
number, highest row). Handing each source, in that order, to the waiting target with the
lowest row therefore gives the same pairs as letting the targets choose one by one: no
target can trade up, because every earlier source went to a lower row. That form is one
sorted pass that keeps only the waiting targets in memory.

A group above ``BLOCK_ROWS`` events is served block by block in that order, all such groups side by side; a block
is one task's work. Of the targets that wait when a block begins, a queue (those of one register, or those without)
can lose at most as many as the block has sources that may serve it, and always its lowest rows: only these are
carried into the block, so the cut is exact, no side is copied and no task sees more than a block and its carry.
Blocks follow each other, so smaller ones than ``BLOCK_ROWS`` are widened until the largest group has ``STEPS`` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.constants import IDENTITY_COLUMNS, RECOVERED_REASON, RECOVERY_SOURCE_REASON
from ledgerline.functions import times
from ledgerline.functions.dates import iso_day
from ledgerline.functions.text import field
from ledgerline.plans.staging import TABLE, Run
from ledgerline.sources.rows import POSITION_BITS, running_starts

FILLED_COLUMNS = [
    "AC REGISTER", "ATD", "ATA", "ARRIVAL GATE", "DEPARTURE GATE", "DEPARTURE RUNWAY",
    "ARRIVAL RUNWAY", "ATD_DATETIME", "ATA_DATETIME", "RAW ATD", "RAW ATA",
]
BAND_START_HOUR, BAND_END_HOUR = 23, 6  # fixed values: 23:00 of D to 06:00 of D+1
BLOCK_ROWS = 250_000
STEPS = 8  # blocks of the largest group, where blocks of at most BLOCK_ROWS allow it
ROW_ID = ["SOURCE DATA", "SOURCE ROW"]
PAIR_SCHEMA = "target_data string, target_row bigint, source_data string, source_row bigint"


def flight_date(name: str = "DATE OF FLIGHT") -> Column:
    return iso_day(field(name))


def own_time() -> Column:
    return times.movement_datetime(F.col("D/A/L/O"), F.col("ATD_DATETIME"), F.col("ATA_DATETIME"))


def _band(day: Column) -> tuple[Column, Column]:
    return times.at_minute(day, F.lit(BAND_START_HOUR * 60)), times.at_minute(
        F.date_add(day, 1), F.lit(BAND_END_HOUR * 60)
    )


def recovery_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and sources, one narrow row each, keyed by (identity, target date)."""
    based = df.where(F.col("D/A/L/O").isin("A", "D")).select(
        *IDENTITY_COLUMNS, *ROW_ID, "AC REGISTER", "TIMESTAMP", "MESSAGE NUM", "EOBT_DATETIME",
        "USED_FOR_RECOVERY", flight_date().alias("_date"), own_time().alias("_own"),
    ).where(F.col("_date").isNotNull())

    def events(rows: DataFrame, day: Column, at: Column, is_target: bool) -> DataFrame:
        version = times.priority_timestamp(F.col("TIMESTAMP"))
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")  # a missing version counts as this
        return rows.select(
            F.concat_ws("|", *[F.coalesce(field(c), F.lit("")) for c in IDENTITY_COLUMNS], day).alias("group"),
            F.lit(is_target).alias("is_target"),
            at.alias("at"),
            F.col("AC REGISTER").alias("register"),
            (F.lit(None).cast("timestamp_ntz") if is_target else F.coalesce(version, epoch)).alias("version"),
            (F.lit(None).cast("double") if is_target
             else times.message_number(F.col("MESSAGE NUM"))).alias("message"),
            F.col("SOURCE DATA").alias("data"),
            F.col("SOURCE ROW").alias("row"),
        )

    start, end = _band(F.col("_date"))
    earliest = F.greatest(F.coalesce(F.col("EOBT_DATETIME"), start), start)
    targets = events(
        based.where(F.col("_own").isNull()).where(earliest <= end), F.col("_date"), earliest, True
    )
    eve = F.date_sub(F.col("_date"), 1)
    first, last = _band(eve)
    sources = events(
        based.where(F.col("_own").between(first, last) & ~F.col("USED_FOR_RECOVERY")),
        eve, F.col("_own"), False,
    )
    return targets, sources


def _serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pass: every source goes to the waiting target with the lowest row."""
    group, anyone, named = None, [], {}
    for batch in batches:
        pairs = []
        for key, is_target, register, data, row in zip(
            batch["group"], batch["is_target"], batch["register"], batch["data"], batch["row"]
        ):
            if key != group:
                group, anyone, named = key, [], {}
            if is_target:
                heapq.heappush(named.setdefault(register, []) if register else anyone, (row, data))
                continue
            queues = [q for q in (anyone, named.get(register) if register else None) if q]
            if queues:
                target_row, target_data = heapq.heappop(min(queues, key=lambda q: q[0]))
                pairs.append((target_data, target_row, data, row))
        yield pd.DataFrame(pairs, columns=["target_data", "target_row", "source_data", "source_row"])


def _order() -> list[Column]:
    return [
        F.col("group").asc(), F.col("at").asc_nulls_first(), F.col("is_target").desc(), F.col("version").desc_nulls_last(),
        F.col("message").desc_nulls_last(), F.col("row").desc(), F.col("data").desc(),
    ]


def _serve_groups(events: DataFrame) -> DataFrame:
    ordered = events.repartition("group").sortWithinPartitions(*_order())
    return ordered.select("group", "is_target", "register", "data", "row").mapInPandas(_serve, PAIR_SCHEMA)


def in_blocks(events: DataFrame, block_rows: int, mode: str | Run = TABLE) -> DataFrame:
    """``events`` with ``block``: their place in the order of their group, in blocks of ``block_rows``.

    The events are sorted over all tasks, each tells its task and its place there, and the sizes of the tasks before
    are added; a group that most events share spreads over as many tasks as it fills.
    """
    placed = Run.of(mode).stage(
        events.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("_id", F.monotonically_increasing_id()),
        "recovery-order")
    task = F.shiftrightunsigned("_id", POSITION_BITS)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    position = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    numbered = placed.withColumn("_of", task).join(
        F.broadcast(running_starts(sizes)), F.col("_of") == F.col("_task")).withColumn("_position", position)  # one row a task
    firsts = numbered.groupBy(F.col("group").alias("_group")).agg(F.min("_position").alias("_first"))
    return numbered.join(firsts, F.col("group") == F.col("_group")).select(
        *events.columns, F.floor((F.col("_position") - F.col("_first")) / block_rows).cast("int").alias("block"))


def carried(waiting: DataFrame, sources: DataFrame, salts: int) -> DataFrame:
    """The waiting targets that ``sources`` could serve: the lowest rows of each queue, as many as it has takers.
    The choice is made in ``salts`` parts of a queue first."""
    queue = F.coalesce("register", F.lit(""))
    takers = sources.select(F.col("group").alias("_group"), F.explode(F.array_distinct(F.array(F.lit(""), queue))).alias("_queue")).groupBy(
        "_group", "_queue").agg(F.count("*").alias("_takers"))
    rows = waiting.join(takers, (F.col("group") == F.col("_group")) & (queue == F.col("_queue")))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("data", "row"), F.lit(salts)))
    for parts in (["_group", "_queue", "_salt"], ["_group", "_queue"]):
        lowest = Window.partitionBy(*parts).orderBy("row", "data")
        rows = rows.withColumn("_turn", F.row_number().over(lowest)).where(F.col("_turn") <= F.col("_takers"))
    return rows.select(*waiting.columns)


def step_rows(block_rows: int, largest: int) -> int:
    """Rows of a block where the largest group has ``largest``: at least ``block_rows``, and no more than ``BLOCK_ROWS`` for fewer steps."""
    return max(block_rows, min(BLOCK_ROWS, -(-largest // STEPS)))


def _paired_in_blocks(events: DataFrame, block_rows: int, run: Run) -> DataFrame:
    """The pairs of groups of any size, a block of every group in each step."""
    placed = run.stage(in_blocks(events, block_rows, run), "recovery-blocks")
    pairs = None
    for block in range((placed.agg(F.max("block")).first()[0] or 0) + 1):
        now = placed.where(F.col("block") == block).drop("block")
        feed = now
        if block:
            waiting = placed.where(F.col("is_target") & (F.col("block") < block)).drop("block")
            served = pairs.select(F.col("target_data").alias("data"), F.col("target_row").alias("row"))
            before = carried(waiting.join(served, ["data", "row"], "left_anti"), now.where(~F.col("is_target")), block)
            feed = now.unionByName(before.withColumn("at", F.lit(None).cast("timestamp_ntz")))  # they wait from the start
        step = run.stage(_serve_groups(feed), "recovery-step")
        pairs = step if pairs is None else pairs.unionByName(step)
    return pairs


def recovery_pairs(df: DataFrame, mode: str | Run = TABLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One-to-one pairs (target, source) of the recovery rule.

    Only sources of groups that have a target are kept; the narrow event table is staged. A group above ``block_rows``
    events is served in blocks of at least that many (:func:`step_rows`).
    """
    run = Run.of(mode)
    targets, sources = recovery_events(df)
    asked = sources.join(targets.select("group").distinct(), "group", "left_semi")
    events = run.stage(targets.unionByName(asked), "recovery-events")
    sizes = events.groupBy(F.col("group").alias("_large")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block_rows)
    largest = sizes.agg(F.max("_rows")).first()[0]
    if largest is None:
        return _serve_groups(events)
    large, block_rows = sizes.select("_large"), step_rows(block_rows, largest)
    hot = F.col("group") == F.col("_large")
    return _serve_groups(events.join(large, hot, "left_anti")).unionByName(
        _paired_in_blocks(events.join(large, hot, "left_semi"), block_rows, run))


def recover_adjacent_date_movements(
    df: DataFrame, mode: str | Run = TABLE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill recovered movements and mark the rows that served them."""
    run = Run.of(mode)
    pairs = run.stage(recovery_pairs(df, run, block_rows), "recovery-pairs")
    payload = df.select(
        F.col("SOURCE DATA").alias("source_data"), F.col("SOURCE ROW").alias("source_row"),
        F.struct("DATE OF FLIGHT", "SOURCE ROW", *FILLED_COLUMNS).alias("_fill"),
    )
    fills = pairs.join(payload, ["source_data", "source_row"]).select(
        F.col("target_data").alias("SOURCE DATA"), F.col("target_row").alias("SOURCE ROW"), "_fill",
    )
    used = pairs.select(
        F.col("source_data").alias("SOURCE DATA"), F.col("source_row").alias("SOURCE ROW"),
    )
    effects = fills.withColumn("_served", F.lit(False)).unionByName(
        used.withColumn("_served", F.lit(True)), allowMissingColumns=True
    )
    joined = df.join(effects, ROW_ID, "left")
    return apply_recovery(joined).select(*[field(c) for c in df.columns])


def apply_recovery(joined: DataFrame) -> DataFrame:
    """Recovered columns of rows that carry ``_fill`` (a source) or ``_served``."""
    fill, served = F.col("_fill"), F.coalesce(F.col("_served"), F.lit(False))
    hit = fill.isNotNull()
    filled = joined.withColumns({
        name: F.when(hit, F.coalesce(field(name), fill[name])).otherwise(field(name))
        for name in FILLED_COLUMNS
    })
    moved = filled.withColumn("_moved", own_time())
    at = F.col("_moved")

    def recovered(name: str, value: Column) -> tuple[str, Column]:
        return name, F.when(hit, value).otherwise(field(name))

    changes = dict([
        recovered("MOVEMENT_DATETIME", at),
        recovered("DAT_MOVEMENT_DATETIME", at),
        recovered("MOVEMENT_TIME_DISPLAY", times.format_time(at)),
        recovered("DAT_MOVEMENT_TIME_DISPLAY", times.format_time(at)),
        recovered("ACTUAL MOVEMENT DATE", times.format_date(at)),
        recovered("MOVEMENT_DATE_DIFFERS_FROM_FLIGHT_DATE", F.lit(True)),
        recovered("DAT_RECOVERY_USED", F.lit(True)),
        recovered("DAT_RECOVERY_SOURCE_DATE", fill["DATE OF FLIGHT"]),
        recovered("DAT_RECOVERY_SOURCE_ROW", fill["SOURCE ROW"]),
        recovered("ORIGINAL_DAT_DATE", F.col("DATE OF FLIGHT")),
        recovered("RECOVERED_DAT_DATE", fill["DATE OF FLIGHT"]),
    ])
    changes["DAT_RECOVERY_REASON"] = (
        F.when(hit, F.lit(RECOVERED_REASON)).when(served, F.lit(RECOVERY_SOURCE_REASON))
        .otherwise(F.col("DAT_RECOVERY_REASON"))
    )
    changes["USED_FOR_RECOVERY"] = F.col("USED_FOR_RECOVERY") | served
    return moved.withColumns(changes)
