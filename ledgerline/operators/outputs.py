"""Result tables: outcome, extra, duplicate, excluded and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    AUDIT_COLUMNS, DETAIL_COLUMNS, DISPLAY_RESULT_COLUMNS, DUPLICATE, EXCLUDED, EXTRA, MISSING,
    MODE_NONE, NOT_SELECTED, RESULT_COLUMNS, VALIDATION_NOT_FOUND, VALIDATION_REVIEW_DAT,
)
from ledgerline.functions.text import field
from ledgerline.functions.times import format_datetime, round_tenth
from ledgerline.operators.evaluate import MatchRules, classify, evaluation, validation
from ledgerline.operators.standardize import empty_text_to_blank

# fixed values: reasons of records without a candidate, and of the other tables
NOT_FOUND_REASON = "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW AND ORIGINAL DATE SEARCH"
NOT_FOUND_RECOVERED_REASON = (
    "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW, ORIGINAL, AND RECOVERED DATE SEARCH"
)
NO_TIME_REASON = "DAT MOVEMENT TIME EMPTY"
EXCLUDED_REASON = "FLIGHT NUMBER MATCHES INTERNAL/NON-BILLABLE RULE"
RESULT_DETAIL = [*DETAIL_COLUMNS, "STREAM SOURCE ROW"]


def decide(unique: DataFrame, best: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """Selected records with ``_best`` (their candidate), STATUS, MATCH_REASON, VALIDASI."""
    joined = unique.join(
        best.withColumnsRenamed({"l_data": "SOURCE DATA", "l_row": "SOURCE ROW"}),
        ["SOURCE DATA", "SOURCE ROW"], "left",
    )
    moved, chosen = F.col("DAT_MOVEMENT_DATETIME"), F.col("_best").isNotNull()
    status, reason = classify(F.col("_best"), rules)
    searched = F.when(F.col("DAT_RECOVERY_USED"), NOT_FOUND_RECOVERED_REASON).otherwise(NOT_FOUND_REASON)
    decided = joined.withColumns({
        "STATUS": F.when(chosen, status).otherwise(F.lit(MISSING)),
        "MATCH_REASON": F.when(moved.isNull(), NO_TIME_REASON).when(~chosen, searched).otherwise(reason),
    })
    return decided.withColumn("VALIDASI", validation(F.col("STATUS"), moved, chosen))


def _of_record() -> dict[str, Column]:
    """Audit columns that depend on the record alone."""
    key = F.col("DUPLICATE_GROUP_KEY")
    return {
        "DAT MOVEMENT DATETIME": format_datetime(F.col("DAT_MOVEMENT_DATETIME")),
        "DUPLICATE GROUP KEY": key,
        "SELECTED DAT RECORD": F.lit(True),
        "STREAM MATCH KEY": key,
        "BILLING CATEGORY": F.lit("BILLING REVIEW"),
    }


def _of_candidate(evaluation: Column) -> dict[str, Column]:
    """Audit columns a record shows for one evaluated candidate (or none)."""
    e, chosen = evaluation, evaluation.isNotNull()
    return {
        "STREAM STATUS FLIGHT": e["r_status"],
        "STREAM REMARK": e["r_remark"],
        "STREAM SPECIAL REMARK FLAG": F.coalesce(e["r_special"], F.lit(False)),
        "STREAM MOVEMENT DATETIME": format_datetime(e["r_at"]),
        "TIME DIFFERENCE MINUTES": round_tenth(e["time_difference"]),
        "STREAM VALIDATION RESULT": F.when(chosen, e["validation_result"]).otherwise("STREAM NOT FOUND"),
        "STREAM MATCH DATE USED": e["date_used"],
        "STREAM MATCH MODE": F.when(chosen, e["mode"]).otherwise(MODE_NONE),
        "ROUTE MATCH IGNORED": F.coalesce(e["r_special"], F.lit(False)),
        "SPECIAL REMARK KEYWORD FOUND": F.upper(e["r_keyword"]),
        "STREAM SOURCE ROW": e["r_row"],
    }


def _result(df: DataFrame, columns: dict[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    wanted = [*RESULT_DETAIL, *extra]
    return empty_text_to_blank(df.select(*[columns.get(n, field(n)).alias(n) for n in wanted]))


def record_results(decided: DataFrame) -> DataFrame:
    """Matched, need-review and missing rows in one table, told apart by STATUS."""
    return _result(decided, {**_of_record(), **_of_candidate(F.col("_best"))})


def decided_side(records: DataFrame, decided: DataFrame) -> DataFrame:
    """Lookup columns of the records that have a selected candidate, with its row (``_selected_row``) and what the audit
    shows of the record itself: written out once a record, a pair only passes it on."""
    chosen = decided.where(F.col("_best.r_row").isNotNull())
    own = {**_of_record(), "STATUS": F.lit(NOT_SELECTED), "MATCH_REASON": F.lit("LOWER PRIORITY STREAM CANDIDATE")}
    pair = _of_candidate(F.col("_best"))
    shown = empty_text_to_blank(chosen.select(
        *[own.get(n, field(n)).alias(n) for n in RESULT_DETAIL if n not in pair], F.col("_best.r_row").alias("_selected_row")))
    same = (F.col("l_data") == F.col("SOURCE DATA")) & (F.col("l_row") == F.col("SOURCE ROW"))
    return records.join(shown, same)


def not_selected_results(evaluated: DataFrame) -> DataFrame:
    """Audit rows of the candidates that were looked at but not selected.

    ``evaluated`` lists the candidates of :func:`decided_side`: a pair brings what is shown of its record, so the
    pairs are neither exchanged nor joined again.
    """
    return _result(evaluated.where(F.col("r_row") != F.col("_selected_row")), _of_other_candidate())


def _of_other_candidate() -> dict[str, Column]:
    other = _of_candidate(evaluation())
    return {
        **other,
        "STREAM MOVEMENT DATETIME": F.col("r_moved"),
        "STREAM VALIDATION RESULT": F.concat(F.lit("NOT SELECTED / "), F.col("validation_result")),
    }


def _blank_recovery() -> dict[str, Column]:
    none_text = F.lit(None).cast("string")
    return {
        "DAT_RECOVERY_USED": F.lit(False), "DAT_RECOVERY_REASON": none_text,
        "DAT_RECOVERY_SOURCE_DATE": none_text, "DAT_RECOVERY_SOURCE_ROW": F.lit(None).cast("bigint"),
        "ORIGINAL_DAT_DATE": none_text, "RECOVERED_DAT_DATE": none_text, "USED_FOR_RECOVERY": F.lit(False),
    }


def extra_results(extra: DataFrame) -> DataFrame:
    """Billing rows no record ever looked at."""
    none_text = F.lit(None).cast("string")
    return _result(extra, {
        **_blank_recovery(),
        "VALIDASI": none_text,
        "STATUS": F.lit(EXTRA),
        "MATCH_REASON": F.lit("DAT NOT FOUND"),
        "DAT MOVEMENT DATETIME": none_text,
        "STREAM MOVEMENT DATETIME": format_datetime(F.col("STREAM_MOVEMENT_DATETIME")),
        "TIME DIFFERENCE MINUTES": F.lit(None).cast("double"),
        "DUPLICATE GROUP KEY": none_text,
        "SELECTED DAT RECORD": F.lit(False),
        "STREAM MATCH KEY": F.col("DUPLICATE_GROUP_KEY"),
        "STREAM VALIDATION RESULT": F.lit("DAT NOT FOUND"),
        "STREAM MATCH DATE USED": none_text,
        "STREAM MATCH MODE": F.lit(MODE_NONE),
        "ROUTE MATCH IGNORED": F.lit(False),
        "BILLING CATEGORY": none_text,
        "FLIGHT_INSTANCE_KEY": none_text,
        "MOVEMENT_TIME_BUCKET": none_text,
        "STREAM SOURCE ROW": F.lit(None).cast("bigint"),
    })


def duplicate_audit_results(duplicates: DataFrame) -> DataFrame:
    """Duplicates as audit rows; they carry their score instead of a candidate."""
    none_text = F.lit(None).cast("string")
    return _result(duplicates, {
        "VALIDASI": none_text,
        "STATUS": F.lit(DUPLICATE),
        "MATCH_REASON": F.col("DUPLICATE_REASON"),
        "STREAM STATUS FLIGHT": none_text,
        "STREAM REMARK": none_text,
        "STREAM SPECIAL REMARK FLAG": F.lit(False),
        "DAT MOVEMENT DATETIME": none_text,
        "STREAM MOVEMENT DATETIME": none_text,
        "TIME DIFFERENCE MINUTES": F.lit(None).cast("double"),
        "DUPLICATE GROUP KEY": F.col("DUPLICATE_GROUP_KEY"),
        "SELECTED DAT RECORD": F.lit(False),
        "STREAM MATCH KEY": none_text,
        "STREAM VALIDATION RESULT": F.lit("NOT APPLICABLE"),
        "STREAM MATCH DATE USED": none_text,
        "STREAM MATCH MODE": F.lit(MODE_NONE),
        "ROUTE MATCH IGNORED": F.lit(False),
        "SPECIAL REMARK KEYWORD FOUND": none_text,
        "BILLING CATEGORY": F.lit("BILLING REVIEW"),
        "DAT_RECOVERY_USED": F.lit(False),
        "ORIGINAL_DAT_DATE": none_text,
        "RECOVERED_DAT_DATE": none_text,
        "STREAM SOURCE ROW": F.lit(None).cast("bigint"),
    }, extra=["COMPLETENESS_SCORE", "HAS_MOVEMENT_TIME"])


def audit_union(
    records: DataFrame, not_selected: DataFrame, extra: DataFrame, duplicates: DataFrame
) -> DataFrame:
    """Everything that happened to a row, excluded rows apart."""
    union = records.unionByName(not_selected).unionByName(extra)
    return union.unionByName(duplicates, allowMissingColumns=True)


def audit_blocks(records: DataFrame, packed: DataFrame, extra: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The rows of :func:`audit_union` before its pairs are listed: ``packed`` has the candidate blocks of
    :func:`decided_side`, all other rows stand for themselves."""
    others = audit_union(records, records.limit(0), extra, duplicates)
    return others.unionByName(packed.drop("flight"), allowMissingColumns=True)


def audit_listed(listed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the audit rows of evaluated blocks, in the order they come in; what a record shows is settled already."""
    pair = _of_other_candidate()
    shown = {n: F.when(F.col("lookup").isNull(), field(n)).otherwise(c) for n, c in pair.items()}
    kept = listed.where(F.col("lookup").isNull() | (F.col("r_row") != F.col("_selected_row")))
    rows = kept.select(*[shown.get(n, field(n)).alias(n) for n in columns])
    texts = {n: F.coalesce(field(n), F.lit("")) for n, t in rows.dtypes if n in pair and t == "string"}
    return rows.withColumns(texts)


def excluded_output(records: DataFrame, billing: DataFrame) -> DataFrame:
    both = records.unionByName(billing).withColumns({
        "STATUS": F.lit(EXCLUDED), "MATCH_REASON": F.lit(EXCLUDED_REASON),
    })
    return empty_text_to_blank(
        both.select(*RESULT_COLUMNS, "SOURCE DATA", "SOURCE ROW", "STATUS", "MATCH_REASON")
    )


def not_found_only(missing: DataFrame) -> DataFrame:
    return missing.where(F.col("VALIDASI") == VALIDATION_NOT_FOUND)


def without_movement_time(missing: DataFrame) -> DataFrame:
    """Records that were never looked up because they have no movement time."""
    return missing.where(F.col("VALIDASI") == VALIDATION_REVIEW_DAT)


def ordered_records(df: DataFrame) -> DataFrame:
    """Report order; the source row settles ties. Sort where a table is written or shown."""
    return df.orderBy("DATE OF FLIGHT", "FLIGHT NUMBER", "D/A/L/O", "SOURCE DATA", "SOURCE ROW")


def ordered_excluded(df: DataFrame) -> DataFrame:
    return df.orderBy("SOURCE DATA", "DATE OF FLIGHT", "FLIGHT NUMBER", "SOURCE ROW")


def select_with_backfill(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Requested columns in order; missing ones are blank. ``None`` keeps everything."""
    if columns is None:
        return df
    return df.select(*[field(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def display_columns(df: DataFrame, extra: Sequence[str] = (), audit: bool = False) -> DataFrame:
    """Default result columns, then the extra and audit columns that exist."""
    wanted = [*DISPLAY_RESULT_COLUMNS, *extra, *(AUDIT_COLUMNS if audit else [])]
    present = [c for c in dict.fromkeys(wanted) if c in df.columns]
    return df.select(*[field(c) for c in present])


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)
