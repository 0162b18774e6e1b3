"""Evaluation of candidates, their ranking, and the outcome of a record."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    DEFAULT_INVALID_STREAM_STATUSES, DEFAULT_TOLERANCE_MINUTES, MATCHED, MISSING, MODE_ACTUAL,
    MODE_RECOVERED, MODE_SPECIAL, NEED_REVIEW, REVIEW_LIMIT_MINUTES, SPECIAL_REASON,
    VALIDATION_FOUND, VALIDATION_NOT_FOUND, VALIDATION_REVIEW, VALIDATION_REVIEW_DAT,
)
from ledgerline.functions.times import format_date, minutes_apart
from ledgerline.operators.lookup import LOOKUPS, SPECIAL, SPECIAL_DATE_USED, SPECIAL_RANK
from ledgerline.plans.mapping import check_tolerance, plain_code


@dataclass(frozen=True)
class MatchRules:
    """Options of the candidate evaluation."""

    tolerance_minutes: float = DEFAULT_TOLERANCE_MINUTES
    review_limit_minutes: float = REVIEW_LIMIT_MINUTES
    invalid_statuses: tuple[str, ...] = DEFAULT_INVALID_STREAM_STATUSES
    invalid_status_is_missing: bool = True

    @staticmethod
    def of(
        tolerance_minutes: float = DEFAULT_TOLERANCE_MINUTES,
        invalid_statuses: Iterable[str] | None = None,
        invalid_status_is_missing: bool = True,
    ) -> MatchRules:
        check_tolerance(tolerance_minutes)
        codes = {plain_code(s) for s in (invalid_statuses or DEFAULT_INVALID_STREAM_STATUSES)}
        return MatchRules(
            tolerance_minutes, REVIEW_LIMIT_MINUTES, tuple(sorted(codes - {""})), invalid_status_is_missing
        )


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _text(mode: Column, choices: dict[str, str], default: str) -> Column:
    """Wording by match mode."""
    chain = F.when(F.lit(False), F.lit(default))
    for key, value in choices.items():
        chain = chain.when(mode == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def _by_lookup(special: Column, value_of_special: object, values: list) -> Column:
    """Value by lookup number; special rows count as found by remark, however reached."""
    chain = F.when(special | (F.col("lookup") == SPECIAL), F.lit(value_of_special))
    for number, value in enumerate(values):
        chain = chain.when(F.col("lookup") == number, F.lit(value))
    return chain


def invalid_status(rules: MatchRules) -> Column:
    if not (rules.invalid_status_is_missing and rules.invalid_statuses):
        return F.lit(False)
    return _flag(F.col("r_status").isin(*rules.invalid_statuses))


def findings(pairs: DataFrame) -> DataFrame:
    """Add what the preference depends on; ``invalid_status`` is there already."""
    both = F.col("l_at").isNotNull() & F.col("r_at").isNotNull()
    days_apart = F.abs(F.datediff(F.col("r_at").cast("date"), F.col("l_at").cast("date")))
    allowed = F.col("r_at").cast("date") == F.col("l_at").cast("date")
    moved_on = format_date(F.col("r_at"))  # written out for recovered records only
    recovered = F.col("l_recovered") & (
        moved_on.eqNullSafe(F.col("l_moved_on")) | moved_on.eqNullSafe(F.col("l_recovered_on"))
    )
    wrong_date = F.when(F.col("r_special"), days_apart > 1).otherwise(~(allowed | _flag(recovered)))
    return pairs.withColumns({
        "register_mismatch": _flag(F.col("l_register") != F.col("r_register")),
        "time_difference": F.when(both, minutes_apart(F.col("r_at"), F.col("l_at"))),
        "date_mismatch": both & _flag(wrong_date),
        "mode_rank": _by_lookup(F.col("r_special"), SPECIAL_RANK, [rank for *_, rank in LOOKUPS]),
    })


def worded(found: DataFrame) -> DataFrame:
    """Add the texts a report shows for an evaluated candidate."""
    movement_field = F.when(F.col("move") == "A", F.lit("ATA")).otherwise(F.lit("ATD"))
    special = F.col("r_special")
    reasons = found.withColumns({
        "date_used": _by_lookup(special, SPECIAL_DATE_USED, [used for used, *_ in LOOKUPS]),
        "mode": _by_lookup(special, MODE_SPECIAL, [mode for _, mode, *_ in LOOKUPS]),
        "invalid_reason": F.nullif(F.concat_ws(
            " / ",
            F.when(F.col("invalid_status"), F.concat(F.lit("STREAM STATUS "), F.col("r_status"))),
            F.when(F.col("l_at").isNull(), F.lit("DAT INVALID MOVEMENT TIME")),
            F.when(F.col("r_at").isNull(), F.lit("STREAM INVALID MOVEMENT TIME")),
            F.when(F.col("date_mismatch"), F.concat(F.lit("STREAM INVALID "), movement_field, F.lit(" DATE"))),
        ), F.lit("")),
    })
    valid_text = _text(F.col("mode"), {
        MODE_SPECIAL: SPECIAL_REASON,
        MODE_RECOVERED: "VALID STREAM CANDIDATE BY RECOVERED DATE",
        MODE_ACTUAL: "VALID STREAM CANDIDATE BY ACTUAL MOVEMENT DATE",
    }, "VALID STREAM CANDIDATE")
    return reasons.withColumn("validation_result", F.concat_ws(
        " / ", F.coalesce(F.col("invalid_reason"), valid_text),
        F.when(F.col("register_mismatch"), F.lit("STREAM AC REGISTER MISMATCH")),
    ))


def evaluate(pairs: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """Add the findings and texts about each candidate; nothing is filtered."""
    return worded(findings(pairs.withColumn("invalid_status", invalid_status(rules))))


def selection_order(rules: MatchRules = MatchRules()) -> Column:
    """Struct whose smallest value is the preferred candidate."""
    outside = F.col("time_difference").isNull() | (F.col("time_difference") > rules.tolerance_minutes)
    version_age = F.lit("9999-12-31").cast("timestamp_ntz") - F.col("r_version")
    return F.struct(
        F.col("invalid_status").alias("o1"),
        F.col("r_at").isNull().alias("o2"),
        F.col("date_mismatch").alias("o3"),
        outside.alias("o4"),
        F.col("r_special").alias("o5"),
        F.col("register_mismatch").alias("o6"),
        F.coalesce(F.col("time_difference"), F.lit(float("inf"))).alias("o7"),
        F.col("mode_rank").alias("o8"),
        F.col("r_version").isNull().alias("o9"), version_age.alias("o10"),
        F.coalesce(-F.col("r_message"), F.lit(float("inf"))).alias("o11"),
        (-F.col("r_row")).alias("o12"),
    )


EVALUATION = [
    "r_row", "r_status", "r_remark", "r_special", "r_keyword", "r_at", "time_difference",
    "date_mismatch", "register_mismatch", "invalid_reason", "validation_result", "date_used", "mode",
]


def evaluation() -> Column:
    """The evaluation of a candidate as one struct."""
    return F.struct(*EVALUATION)


def best_per_record(evaluated: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """The selected one of listed candidates per record, combined on the map side."""
    best = F.min(F.struct(selection_order(rules).alias("order"), *EVALUATION)).alias("_best")
    return evaluated.groupBy("l_data", "l_row").agg(best)


def classify(evaluation: Column, rules: MatchRules = MatchRules()) -> tuple[Column, Column]:
    """Status and reason of a record with a selected candidate."""
    e = evaluation
    late = e["time_difference"]
    close = late <= rules.tolerance_minutes
    status = (
        F.when(e["r_special"], NEED_REVIEW)
        .when(e["invalid_reason"].isNotNull() | late.isNull(), MISSING)
        .when(close & ~e["register_mismatch"], MATCHED)
        .when(late <= max(rules.review_limit_minutes, rules.tolerance_minutes), NEED_REVIEW)
        .otherwise(MISSING)
    )
    matched_text = _text(e["mode"], {
        MODE_RECOVERED: "VALID STREAM MATCH BY RECOVERED DATE",
        MODE_ACTUAL: "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE",
    }, "VALID STREAM MATCH")
    reason = (
        F.when(e["r_special"], SPECIAL_REASON)
        .when(e["invalid_reason"].isNotNull(), e["invalid_reason"])
        .when(late.isNull(), "STREAM INVALID MOVEMENT TIME")
        .when(close & e["register_mismatch"], "STREAM AC REGISTER MISMATCH")
        .when(close, matched_text)
        .when(late <= rules.review_limit_minutes, F.concat_ws(
            " / ", F.lit("STREAM TIME DIFFERENCE"),
            F.when(e["register_mismatch"], F.lit("STREAM AC REGISTER MISMATCH")),
        ))
        .otherwise("STREAM TIME MISMATCH")
    )
    return status, reason


def validation(status: Column, moved: Column, has_candidate: Column) -> Column:
    return (
        F.when(moved.isNull(), VALIDATION_REVIEW_DAT)
        .when(~has_candidate, VALIDATION_NOT_FOUND)
        .when(status == MATCHED, VALIDATION_FOUND)
        .otherwise(VALIDATION_REVIEW)
    )
