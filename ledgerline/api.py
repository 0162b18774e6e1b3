"""Public names, importable from one place."""

from ledgerline.constants import (
    AUDIT_COLUMNS, DEFAULT_INVALID_STREAM_STATUSES, DETAIL_COLUMNS, DISPLAY_RESULT_COLUMNS,
    DUPLICATE_AUDIT_COLUMNS, MATCH_KEY_COLUMNS, MISSING_EXPORT_COLUMNS, RECOVERY_AUDIT_COLUMNS,
    RESULT_COLUMNS, SPECIAL_REMARK_AUDIT_COLUMNS, SPECIAL_REMARK_KEYWORDS, VALIDATION_EXPORT_COLUMNS,
    VALIDATION_FOUND, VALIDATION_NOT_FOUND, VALIDATION_REVIEW, VALIDATION_REVIEW_DAT, VALIDATION_VALUES,
)
from ledgerline.functions.remarks import (
    has_special_stream_remark, is_excluded_flight_number, is_non_billable_flight,
    special_stream_remark_keyword,
)
from ledgerline.operators.dedup import deduplicate_dat
from ledgerline.operators.filters import date_bounds, filter_options, filter_results
from ledgerline.operators.keys import prepare_keys
from ledgerline.operators.recovery import recover_adjacent_date_movements
from ledgerline.operators.standardize import standardize_dataset
from ledgerline.operators.summary import reason_histogram
from ledgerline.plans.compare import compare_datasets
from ledgerline.plans.mapping import detect_mapping, detected_mapping, validate_required_columns
from ledgerline.plans.reconcile import reconcile_dat_vs_stream
from ledgerline.sources.delimited import read_source_csv, read_uploaded_table
from ledgerline.sources.html_report import read_html_report
from ledgerline.sources.sinks import write_comparison, write_report

__all__ = [
    "AUDIT_COLUMNS", "DEFAULT_INVALID_STREAM_STATUSES", "DETAIL_COLUMNS", "DISPLAY_RESULT_COLUMNS",
    "DUPLICATE_AUDIT_COLUMNS", "MATCH_KEY_COLUMNS", "MISSING_EXPORT_COLUMNS", "RECOVERY_AUDIT_COLUMNS",
    "RESULT_COLUMNS", "SPECIAL_REMARK_AUDIT_COLUMNS", "SPECIAL_REMARK_KEYWORDS", "VALIDATION_EXPORT_COLUMNS",
    "VALIDATION_FOUND", "VALIDATION_NOT_FOUND", "VALIDATION_REVIEW", "VALIDATION_REVIEW_DAT",
    "VALIDATION_VALUES", "compare_datasets", "date_bounds", "deduplicate_dat", "detect_mapping",
    "detected_mapping", "filter_options", "filter_results", "has_special_stream_remark",
    "is_excluded_flight_number", "is_non_billable_flight", "prepare_keys", "read_html_report",
    "read_source_csv", "read_uploaded_table", "reason_histogram", "reconcile_dat_vs_stream",
    "recover_adjacent_date_movements", "special_stream_remark_keyword", "standardize_dataset",
    "validate_required_columns", "write_comparison", "write_report",
]
