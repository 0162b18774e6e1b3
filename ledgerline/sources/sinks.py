"""Report datasets: one folder per bundle, one dataset per result.

A bundle is written to a hidden folder beside its place, its files are read back for the manifest (rows and digest of
every dataset), and then it is renamed into place as a whole. Readers see the report that stood there before or the new
one, never a part; a write that fails leaves the earlier one as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.constants import MISSING_EXPORT_COLUMNS, REPORT_DATE_COLUMNS, VALIDATION_EXPORT_COLUMNS
from ledgerline.functions.dates import iso_day
from ledgerline.functions.text import field
from ledgerline.operators.outputs import ordered_excluded, ordered_records, select_with_backfill
from ledgerline.plans.compare import Comparison
from ledgerline.plans.reconcile import Reconciliation
from ledgerline.plans.staging import Run

# fixed values: dataset names, in report order
COMPARISON_BUNDLE = {
    "01_hanya_data_sumber": "source_only",
    "02_hanya_data_aktual": "actual_only",
    "03_semua_tidak_cocok": "unmatched",
    "04_data_cocok": "matched",
    "05_perbedaan_nilai": "differences",
}
REPORT_SHEETS = (
    ("Summary", "summary_table"),
    ("Validasi", "validasi"),
    ("Missing in Stream", "missing"),
    ("Matched", "matched"),
    ("Need Review", "need_review"),
    ("Extra in Stream", "extra"),
    ("Duplicate DAT", "duplicates"),
    ("Audit Detail", "audit_detail"),
    ("Excluded Non-Billable", "excluded_non_billable"),
)
MANIFEST, SETTINGS = "Manifest", "Settings"
SHEET_COLUMNS = {"validasi": VALIDATION_EXPORT_COLUMNS, "missing": MISSING_EXPORT_COLUMNS}


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 text with a header in every part file."""
    df.write.option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {"csv": write_csv, "parquet": write_parquet}


def typed_dates(df: DataFrame) -> DataFrame:
    """ISO date texts as dates. A column that also holds unreadable texts keeps them
    next to its date, as ``<name> (TEXT)``."""
    present = [c for c in REPORT_DATE_COLUMNS if c in df.columns]
    unread = {
        f"{c} (TEXT)": F.when(iso_day(field(c)).isNull(), F.nullif(field(c), F.lit("")))
        for c in present if c == "DATE OF FLIGHT"
    }
    return df.withColumns(unread).withColumns({c: iso_day(field(c)) for c in present})


def settings_table(result: Reconciliation) -> DataFrame:
    """The settings of the run as lines (name, value): when it was written, tolerance, invalid statuses."""
    rules = result.rules
    lines = [("Time tolerance", f"{rules.tolerance_minutes:g} minutes"),
             ("Invalid STREAM status", ", ".join(rules.invalid_statuses))]
    spark = result.combined.sparkSession
    written = spark.range(1).select(F.lit(0).alias("LINE"), F.lit("Generated").alias("SETTING"),
                                    F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("VALUE"))
    return reduce(DataFrame.unionByName, [
        spark.range(1).select(F.lit(i).alias("LINE"), F.lit(name).alias("SETTING"), F.lit(value).alias("VALUE"))
        for i, (name, value) in enumerate(lines, 1)], written)


def report_tables(result: Reconciliation, sheets: Collection[str] | None = None) -> dict[str, DataFrame]:
    """The nine report datasets, or those named, with their column lists, unsorted."""
    return {
        sheet: select_with_backfill(getattr(result, name), SHEET_COLUMNS.get(name))
        for sheet, name in REPORT_SHEETS if sheets is None or sheet in sheets
    }


def _in_report_order(sheet: str, df: DataFrame) -> DataFrame:
    if sheet == "Summary":
        return df.orderBy("LINE")
    if sheet == "Excluded Non-Billable":
        return ordered_excluded(df)
    if "SOURCE DATA" in df.columns:
        return ordered_records(df)
    return df.orderBy("DATE OF FLIGHT", "FLIGHT NUMBER", "D/A/L/O")


@contextmanager
def published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A hidden folder to write to; it takes the place of ``folder``, and of what stands there, once all is written.

    Where an earlier bundle stands it is set aside first and put back if the new one cannot take its place.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(folder.rstrip("/"))
    parent, name, mark = place.getParent(), place.getName(), uuid.uuid4().hex
    hidden, aside = path(parent, f".{name}-{mark}"), path(parent, f".{name}-{mark}-before")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield hidden.toString()
        stood = files.exists(place)
        if stood and not files.rename(place, aside):
            raise OSError(f"{folder}: the earlier report cannot be set aside")
        if not files.rename(hidden, place):
            if stood:
                files.rename(aside, place)
            raise OSError(f"{folder}: the report cannot be put in place")
        if stood:
            files.delete(aside, True)
    finally:
        files.delete(hidden, True)


def _read_back(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if file_format == "csv" else spark.read.parquet(path)


def manifest(spark: SparkSession, folder: str, datasets: Collection[str], file_format: str = "parquet") -> DataFrame:
    """(dataset, rows, digest) of the files of each dataset as they are; the digest does not depend on their order."""
    lines = []
    for name in datasets:
        rows = _read_back(spark, f"{folder}/{name}", file_format)
        digest = F.sum(F.xxhash64(*[field(c) for c in rows.columns]).cast("decimal(38,0)"))
        lines.append(rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.coalesce(digest.cast("string"), F.lit("0")).alias("digest")))
    return reduce(DataFrame.unionByName, lines)


def write_report(
    result: Reconciliation, folder: str, file_format: str = "parquet", sheets: Collection[str] | None = None
) -> list[str]:
    """Write the nine datasets, or those named, in report order below ``folder``, and the settings and a manifest beside
    them; returns the paths of the datasets. What stood in ``folder`` is replaced as a whole."""
    spark, write, run = result.combined.sparkSession, WRITERS[file_format], Run(result.run.mode)
    tables = report_tables(result, sheets)
    try:
        with published(spark, folder) as hidden:
            write(settings_table(result).coalesce(1).sortWithinPartitions("LINE"), f"{hidden}/{SETTINGS}")  # three rows
            for sheet, df in tables.items():
                typed = typed_dates if file_format == "parquet" else (lambda rows: rows)
                if sheet == "Audit Detail":  # ordered by record, then the candidates of a record are listed in their place
                    ordered = result.audit_listed(typed(ordered_records(result.audit_blocks)), typed(df).columns)
                else:
                    ordered = typed(_in_report_order(sheet, run.stage(df, "report-rows")))  # a range sort reads its rows twice
                write(ordered, f"{hidden}/{sheet}")
            write(manifest(spark, hidden, tables, file_format).coalesce(1), f"{hidden}/{MANIFEST}")  # a row a dataset
    finally:
        run.release()
    return [f"{folder.rstrip('/')}/{sheet}" for sheet in tables]


build_report = write_report


def write_comparison(result: Comparison, folder: str, file_format: str = "csv") -> list[str]:
    """Write the five comparison datasets and a manifest below ``folder``, replacing what stood there; returns the paths
    of the datasets."""
    spark, write = result.aligned.sparkSession, WRITERS[file_format]
    with published(spark, folder) as hidden:
        for dataset, name in COMPARISON_BUNDLE.items():
            write(result[name], f"{hidden}/{dataset}")
        write(manifest(spark, hidden, COMPARISON_BUNDLE, file_format).coalesce(1), f"{hidden}/{MANIFEST}")
    return [f"{folder.rstrip('/')}/{dataset}" for dataset in COMPARISON_BUNDLE]
