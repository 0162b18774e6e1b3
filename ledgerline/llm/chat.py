"""Preference formatting: pairs of conversations as one prompt and two masked completions.

Turns of the chosen and the rejected conversation are lined up by position. Up to the first position where they
differ they are the prompt, which is rendered once; what follows on each side is its completion. Only the text
of assistant turns is trained on, so every completion carries the stretches (from, to; in characters) of that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|turn|>", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END))


def first_difference(turns: DataFrame) -> DataFrame:
    """pair_id, shared: how many leading turns the two sides of each pair have in common. ``turns`` has pair_id,
    side (chosen, rejected), at (position from 0), role, text. Sums by position only, so no pair is collected."""
    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.struct("role", "text"))).alias(name)

    lined = turns.groupBy("pair_id", "at").agg(of("chosen", "c"), of("rejected", "r"))
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    return lined.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("at"))), F.max("at") + 1).cast("int").alias("shared"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side, turn, role, text) with ``at``, the position from 0 on its side by turn, role and text.
    Null roles and texts become empty. Repeated turns each take a position."""
    clean = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return clean.withColumn("at", F.row_number().over(order) - 1)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans: a row for each pair.

    ``turns`` has pair_id, side (``chosen`` or ``rejected``; other sides are ignored), turn, role, text. A side without
    turns is an empty conversation: nothing is shared and its completion is empty. Where both sides are equal, all
    turns are the prompt and both completions are empty. Turns of null pair ids form one pair. One pair is
    one training example, so its turns meet in one row; everything before works turn by turn.
    """
    placed = numbered(turns.where("side IN ('chosen', 'rejected')"))
    shared = first_difference(placed)
    known = placed.join(shared.select(F.col("pair_id").alias("_pair"), "shared"), F.col("pair_id").eqNullSafe(F.col("_pair")))
    part = F.when(F.col("at") < F.col("shared"), F.when(F.col("side") == "chosen", F.lit("prompt"))).otherwise(F.col("side"))
    cut = known.select("pair_id", "shared", "at", "role", "text", part.alias("part")).where("part IS NOT NULL")
    turn = F.struct("at", rendered(F.col("role"), F.col("text")).alias("body"), F.char_length("text").alias("n"),
                    F.char_length(rendered(F.col("role"), F.lit(""))).alias("frame"), (F.col("role") == "assistant").alias("trained"))

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == name, turn))).alias(name)

    def text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda t: t["body"]), "").alias(name)

    def spans(name: str) -> Column:
        start = F.struct(F.lit(0).alias("upto"), F.expr("CAST(array() AS array<struct<from:int,to:int>>)").alias("spans"))
        lead = len(TURN_END)
        return F.aggregate(name, start, lambda a, t: F.struct(
            (a["upto"] + t["frame"] + t["n"]).alias("upto"),
            F.when(t["trained"], F.concat(a["spans"], F.array(F.struct(
                (a["upto"] + t["frame"] - lead).alias("from"), (a["upto"] + t["frame"] - lead + t["n"]).alias("to")))))
            .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"]).alias(f"{name}_spans")

    whole = cut.groupBy("pair_id", "shared").agg(side("prompt"), side("chosen"), side("rejected"))
    return whole.select("pair_id", F.col("shared").alias("n_prompt_turns"), text("prompt"), text("chosen"), text("rejected"),
                        spans("chosen"), spans("rejected"))


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text: every conversation as chosen, and as rejected with its last assistant turn
    replaced by an echo of the turn before it. Without an assistant turn after another turn both sides are equal."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    known = conversations.select("conv_id", "turn", "role", "text").withColumns({
        "before": F.lag(F.coalesce("text", F.lit(""))).over(by_turn), "at": F.row_number().over(by_turn)})
    last = F.max(F.when((F.col("role") == "assistant") & (F.col("at") > 1), F.col("at"))).over(Window.partitionBy("conv_id"))
    known = known.withColumn("last", last)
    sides = F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(F.col("at") == F.col("last"), F.col("before")).otherwise(F.col("text")).alias("text"))))
    return known.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
