"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, given by an offset and a step that its
name hashes to. Shards take turns claiming the best slot still free until the table is full, so each has an equal
share and a lost shard moves few keys besides its own. A key's slot is its hash modulo the size: a
broadcast of the table, whose size is a parameter, places every row in constant time without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 4099
MAX_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. ``slots`` must be prime, so every step visits all slots."""
    if slots < 3 or slots > MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from 3 to {MAX_SLOTS}")
    if not names or len(names) > slots or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, and no more of them than slots")
    at = [_number(f"{name}|offset") % slots for name in names]
    step = [_number(f"{name}|step") % (slots - 1) + 1 for name in names]
    table = [-1] * slots
    for turn in range(slots):
        shard = turn % len(names)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        table[at[shard]] = shard
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key, by its text; null keys hash as the empty text."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(hashed, F.lit(slots)).cast("int")


def place(df: DataFrame, key: Column, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (the name of the shard) of ``key``; a column of those names is replaced.

    Null keys all go to the slot of the empty text. Equal keys go to the same shard. An empty table stays empty.
    """
    rows = [(slot, names[shard]) for slot, shard in enumerate(lookup_table(names, slots))]
    table = df.sparkSession.createDataFrame(rows, "_llm_slot int, _llm_shard string")  # at most MAX_SLOTS short rows
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return (
        df.withColumn("_llm_key_slot", slot_of(key, slots)).join(F.broadcast(table), F.col("_llm_key_slot") == F.col("_llm_slot"))
        .select(*kept, F.col("_llm_slot").alias("slot"), F.col("_llm_shard").alias("shard"))
    )
