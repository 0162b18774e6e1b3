"""Counters of a reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    DAT_ARR, DAT_DEP, DUPLICATE, EXCLUDED, EXTRA, MATCHED, MISSING, MONITORED_REASONS, NEED_REVIEW,
    STREAM, VALIDATION_FOUND, VALIDATION_NOT_FOUND, VALIDATION_REVIEW, VALIDATION_REVIEW_DAT,
)

# fixed values: report line, counter behind it, in report order
SUMMARY_LINES = {
    "Total DAT DEP": "total_dat_dep",
    "Total DAT ARR": "total_dat_arr",
    "Total DAT Combined": "total_dat_combined",
    "Total DAT Unique": "total_dat_unique",
    "Total STREAM": "total_stream",
    "Matched": "matched",
    "Missing in Stream": "missing_in_stream",
    "Missing Billing Review": "missing_billing_review",
    "Need Review": "need_review",
    "Total Ada di STREAM": "total_ada_di_stream",
    "Total Validasi": "total_validasi",
    "Total Perlu Review STREAM": "total_perlu_review_stream",
    "Total Perlu Review DAT": "total_perlu_review_dat",
    "Extra in Stream": "extra_in_stream",
    "Duplicate DAT": "duplicate_dat",
    "Excluded DAT Non-Billable": "excluded_dat_non_billable",
    "Excluded STREAM Non-Billable": "excluded_stream_non_billable",
    "Accuracy Percentage": "accuracy_percentage",
}


def accuracy(matched: Column, unique: Column) -> Column:
    share = matched.cast("double") / F.nullif(unique, F.lit(0)).cast("double") * F.lit(100.0)
    return F.coalesce(share, F.lit(0.0))


def _tagged(df: DataFrame, table: str, kind: Column, validasi: Column | None = None,
            complete: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(table).alias("table"), kind.alias("kind"),
        (F.lit(None).cast("string") if validasi is None else validasi).alias("validasi"),
        (F.lit(True) if complete is None else complete).alias("complete"),
    ).groupBy("table", "kind", "validasi", "complete").agg(F.count("*").alias("n"))


def summary(
    combined: DataFrame, decided: DataFrame, stream: DataFrame, extra: DataFrame,
    duplicates: DataFrame, excluded: DataFrame,
) -> DataFrame:
    """One row with all counters: each table is counted once, then the counts are spread."""
    parts = [
        _tagged(combined, "combined", F.col("SOURCE DATA")),
        _tagged(decided, "unique", F.col("STATUS"), F.col("VALIDASI"), F.col("_complete_key")),
        _tagged(stream, "stream", F.lit(STREAM), None, F.col("_complete_key")),
        _tagged(extra, "extra", F.lit(EXTRA)),
        _tagged(duplicates, "duplicates", F.lit(DUPLICATE)),
        _tagged(excluded, EXCLUDED, F.col("SOURCE DATA")),
    ]
    counts = reduce(DataFrame.unionByName, parts)

    def total(table: str, *conditions: Column) -> Column:
        matching = reduce(Column.__and__, conditions, F.col("table") == table)
        return F.coalesce(F.sum(F.when(matching, F.col("n"))), F.lit(0)).cast("bigint")

    kind, validasi, complete = F.col("kind"), F.col("validasi"), F.col("complete")
    missing = total("unique", kind == MISSING)
    not_matched = kind.isin(MISSING, NEED_REVIEW)
    counters = {
        "total_dat_dep": total("combined", kind == DAT_DEP),
        "total_dat_arr": total("combined", kind == DAT_ARR),
        "total_dat_combined": total("combined"),
        "total_dat_unique": total("unique"),
        "total_stream": total("stream"),
        "matched": total("unique", kind == MATCHED),
        "missing_in_stream": missing,
        "missing_billing_review": missing,
        "missing_non_billable_review": F.lit(0).cast("bigint"),
        "need_review": total("unique", kind == NEED_REVIEW),
        "total_ada_di_stream": total("unique", kind == MATCHED, validasi == VALIDATION_FOUND),
        "total_validasi": total("unique", kind == MISSING, validasi == VALIDATION_NOT_FOUND),
        "total_perlu_review_stream": total("unique", not_matched, validasi == VALIDATION_REVIEW),
        "total_perlu_review_dat": total("unique", not_matched, validasi == VALIDATION_REVIEW_DAT),
        "extra_in_stream": total("extra"),
        "duplicate_dat": total("duplicates"),
        "excluded_dat_non_billable": total(EXCLUDED, kind != STREAM),
        "excluded_stream_non_billable": total(EXCLUDED, kind == STREAM),
        "incomplete_dat_keys": total("unique", ~complete),
        "incomplete_stream_keys": total("stream", ~complete),
    }
    row = counts.agg(*[c.alias(n) for n, c in counters.items()])
    return row.withColumn("accuracy_percentage", accuracy(F.col("matched"), F.col("total_dat_unique")))


def summary_table(summary_row: DataFrame) -> DataFrame:
    """METRIC / VALUE lines in report order (``LINE``)."""
    lines = []
    for number, (label, counter) in enumerate(SUMMARY_LINES.items(), start=1):
        value = F.col(counter).cast("double")
        value = value / F.lit(100.0) if counter == "accuracy_percentage" else value
        lines.append(F.struct(F.lit(number).alias("LINE"), F.lit(label).alias("METRIC"), value.alias("VALUE")))
    return summary_row.select(F.inline(F.array(*lines)))


def reason_histogram(
    df: DataFrame, reasons: Sequence[str] = MONITORED_REASONS, column: str = "MATCH_REASON"
) -> DataFrame:
    """How many rows mention each monitored reason; reasons nobody mentions are left out."""
    text = F.coalesce(F.col(column), F.lit(""))
    counts = df.agg(*[F.count_if(text.contains(r)).alias(f"_{i}") for i, r in enumerate(reasons)])
    lines = [F.struct(F.lit(r).alias("reason"), F.col(f"_{i}").alias("rows")) for i, r in enumerate(reasons)]
    return counts.select(F.inline(F.array(*lines))).where(F.col("rows") > 0)
