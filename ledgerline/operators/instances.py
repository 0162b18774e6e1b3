"""Flight instances: which records describe the same physical movement.

Hot keys never meet in one task. Registers, instances and open probes are aggregated
before their shuffle, so what a group brings into a sorted pass is its distinct slots,
registers and off-block times, not its rows. Rows then pick their resolution up in one
equi-join against that small table; rows that need none carry a salt of their own
instead of piling up under the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.constants import MATCH_KEY_COLUMNS
from ledgerline.functions.text import duplicate_group_key, field
from ledgerline.functions.times import format_date, seconds_between, time_bucket
from ledgerline.operators.nearest import nearest

KEYS = [f"_k{i}" for i in range(len(MATCH_KEY_COLUMNS))]
SLOT = [*KEYS, "actual_date", "bucket"]
ANY_REGISTER = "*"  # register codes hold letters and digits only
SPREAD = 4096


def group_keys() -> list[Column]:
    """The five match keys with blank equal to blank."""
    return [F.coalesce(field(c), F.lit("")).alias(k) for c, k in zip(MATCH_KEY_COLUMNS, KEYS)]


def _active(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("USED_FOR_RECOVERY"), F.lit(False)))


def _timed(df: DataFrame) -> DataFrame:
    moved = F.col("DAT_MOVEMENT_DATETIME")
    return _active(df).where(moved.isNotNull()).select(
        *group_keys(), format_date(moved).alias("actual_date"), time_bucket(moved).alias("bucket"),
        F.col("AC REGISTER").alias("register"), moved.alias("moved"), F.col("SOURCE ROW").alias("row"),
    )


def _folded(df: DataFrame) -> DataFrame:
    """Timed rows folded to (slot, register): a hot slot shrinks before its shuffle."""
    return _timed(df).groupBy(*SLOT, "register").agg(F.min("moved").alias("moved"), F.min("row").alias("row"))


def _slotted(df: DataFrame) -> DataFrame:
    """Folded rows with the one register of their slot; later steps keep this partitioning."""
    slot = Window.partitionBy(*SLOT)
    lowest, highest = F.min("register").over(slot), F.max("register").over(slot)
    return _folded(df).withColumn("slot_register", F.when(lowest == highest, lowest))


def slot_registers(df: DataFrame) -> DataFrame:
    """The one register of a (key, date, bucket) slot; NULL unless it is the only one."""
    return _slotted(df).select(*SLOT, "slot_register").distinct()


def movement_instances(df: DataFrame) -> DataFrame:
    """Distinct (date, bucket, register) movements per key, earliest time, first row.

    Blank registers take the slot's only register.
    """
    settled = _slotted(df).withColumn("register", F.coalesce("register", "slot_register", F.lit("")))
    return settled.groupBy(*SLOT, "register").agg(F.min("moved").alias("moved"), F.min("row").alias("row"))


def attach_timeless(df: DataFrame, instances: DataFrame) -> DataFrame:
    """Instance of each distinct (key, register, off-block time) without a movement time.

    Same-register instances come first; a sole instance is taken as it is, otherwise the
    one nearest to the off-block time (ties: first seen). ``found`` tells how many
    instances were eligible, ``instance`` is NULL where none could be singled out.
    """
    open_rows = _active(df).where(F.col("DAT_MOVEMENT_DATETIME").isNull()).select(
        *group_keys(), F.coalesce("AC REGISTER", F.lit("")).alias("register"),
        F.col("EOBT_DATETIME").alias("at"),
    ).distinct()
    slots = F.explode(F.array(F.lit(ANY_REGISTER), F.col("register")))
    probes = open_rows.withColumn("slot", slots).where(F.col("slot") != "")
    references = instances.withColumn("slot", slots).where(F.col("slot") != "").withColumn(
        "first_seen", -F.col("row")
    )
    scope = [*KEYS, "slot"]
    instance = ["actual_date", "bucket", "register"]
    counted = nearest(
        probes, references.select(*scope, F.col("moved").alias("at"), "first_seen", *instance),
        by=scope, at="at", rank=["first_seen"], carry=instance, with_totals=True,
    )

    def pick(side: str) -> Column:
        return F.struct(*[F.col(side)[c].alias(c) for c in instance])

    def distance(side: str) -> Column:
        away = F.abs(seconds_between(F.col(side)["at"], F.col("at")))
        return F.when(F.col(side).isNotNull(), F.struct(
            away, -F.col(side)["first_seen"],
            pick(side).alias("pick"),
        ))

    closest = F.least(distance("before"), distance("after"))["pick"]
    chosen = F.when(F.col("found") == 1, pick("any")).when(F.col("found") > 1, closest)
    choice = F.when(F.col("found") > 0, F.struct(
        (F.col("slot") != ANY_REGISTER).alias("same_register"), F.col("found"), chosen.alias("instance"),
    ))
    return counted.groupBy(*KEYS, "register", "at").agg(F.max(choice).alias("_choice")).select(
        *KEYS, "register", "at", F.coalesce(F.col("_choice.found"), F.lit(0)).alias("found"),
        F.col("_choice.instance").alias("instance"),
    )


def _resolutions(df: DataFrame) -> DataFrame:
    """One table for both kinds of open rows: ``_a``/``_b`` hold slot or register/time."""
    registers = slot_registers(df).where(F.col("slot_register").isNotNull()).select(
        *KEYS, F.lit(0).alias("_salt"), F.col("actual_date").alias("_a"), F.col("bucket").alias("_b"),
        "slot_register", F.lit(None).cast("bigint").alias("found"),
        F.lit(None).cast("struct<actual_date:string,bucket:string,register:string>").alias("instance"),
    )
    attached = attach_timeless(df, movement_instances(df)).where(F.col("found") > 0).select(
        *KEYS, F.lit(-1).alias("_salt"), F.col("register").alias("_a"),
        F.coalesce(F.col("at").cast("string"), F.lit("")).alias("_b"),
        F.lit(None).cast("string").alias("slot_register"), "found", "instance",
    )
    return registers.unionByName(attached)


def assign_flight_instance_keys(df: DataFrame) -> DataFrame:
    """Add MOVEMENT_TIME_BUCKET and FLIGHT_INSTANCE_KEY (also as DUPLICATE_GROUP_KEY)."""
    moved, register = F.col("DAT_MOVEMENT_DATETIME"), F.col("AC REGISTER")
    used = F.coalesce(F.col("USED_FOR_RECOVERY"), F.lit(False))
    timed, untimed = ~used & moved.isNotNull(), ~used & moved.isNull()
    asks_slot = timed & register.isNull()
    own_salt = (F.pmod(F.xxhash64("SOURCE DATA", "SOURCE ROW"), F.lit(SPREAD)) + 1).cast("int")
    keyed = df.withColumns({
        **dict(zip(KEYS, group_keys())),
        "_salt": F.when(asks_slot, F.lit(0)).when(untimed, F.lit(-1)).otherwise(own_salt),
        "_a": F.when(asks_slot, format_date(moved)).when(untimed, F.coalesce(register, F.lit(""))).otherwise(""),
        "_b": F.when(asks_slot, time_bucket(moved))
        .when(untimed, F.coalesce(F.col("EOBT_DATETIME").cast("string"), F.lit(""))).otherwise(""),
    })
    joined = keyed.join(_resolutions(df), [*KEYS, "_salt", "_a", "_b"], "left")
    instance = F.col("instance")
    ambiguous = untimed & instance.isNull() & (F.coalesce(F.col("found"), F.lit(0)) > 0)
    origin = [F.col("SOURCE DATA"), F.col("SOURCE ROW").cast("string")]
    date = (
        F.when(used, F.col("ACTUAL MOVEMENT DATE")).when(timed, format_date(moved))
        .otherwise(F.coalesce(instance["actual_date"], F.col("DATE OF FLIGHT")))
    )
    bucket = F.when(used | timed, time_bucket(moved)).otherwise(
        F.coalesce(instance["bucket"], time_bucket(F.col("EOBT_DATETIME")))
    )
    settled = (
        F.when(used, register).when(timed, F.coalesce(register, F.col("slot_register")))
        .otherwise(F.coalesce(F.nullif(instance["register"], F.lit("")), register))
    )
    suffix = (
        F.when(used, F.concat_ws("-", F.lit("RECOVERY-SOURCE"), *origin))
        .when(ambiguous, F.concat_ws("-", F.lit("AMBIGUOUS"), *origin))
    )
    base = duplicate_group_key(*[field(c) for c in MATCH_KEY_COLUMNS], settled, date, bucket)
    key = F.concat_ws(" | ", base, suffix)
    named = joined.withColumns({"MOVEMENT_TIME_BUCKET": bucket, "FLIGHT_INSTANCE_KEY": key})
    return named.withColumn("DUPLICATE_GROUP_KEY", F.col("FLIGHT_INSTANCE_KEY")).drop(
        *KEYS, "_salt", "_a", "_b", "slot_register", "found", "instance"
    )
