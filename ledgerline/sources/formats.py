"""Physical format and digest of landed files, as columns over their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: signatures, format names and labels
OLE2_SIGNATURE = "D0CF11E0A1B11AE1"
ZIP_SIGNATURE = "504B0304"
HTML_STARTS = ("<!doctype html", "<html")
TABLE_TAG = "<table"
HEAD_BYTES = 65536
FORMAT_LABELS = {
    "xls": "Excel 97–2003 (XLS)",
    "xlsx": "Excel Workbook (XLSX)",
    "html": "Tabel HTML berformat .xls",
    "unknown": "Format tidak dikenal",
}
DELIMITED_SUFFIXES = ("csv", "tsv", "txt")
DIGEST_LENGTH = 16


def actual_file_format(content: Column) -> Column:
    """Format by signature; report exports are often HTML behind a spreadsheet suffix.

    The signature test is defined on the head of the file, which is all it looks at.
    """
    head = F.substring(content, 1, HEAD_BYTES)
    text = F.lower(F.ltrim(F.decode(head, "ISO-8859-1"), F.lit(" \t\n\r\x0b\x0c")))
    is_html = text.contains(TABLE_TAG)
    for start in HTML_STARTS:
        is_html = is_html | text.startswith(start)
    return (
        F.when(F.hex(F.substring(content, 1, 8)) == OLE2_SIGNATURE, "xls")
        .when(F.hex(F.substring(content, 1, 4)) == ZIP_SIGNATURE, "xlsx")
        .when(is_html, "html").otherwise("unknown")
    )


def format_label(file_format: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, label in FORMAT_LABELS.items():
        chain = F.when(file_format == name, label).otherwise(chain)
    return chain


def file_digest(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, DIGEST_LENGTH)


def scan_kind(path: Column, file_format: Column) -> Column:
    """Reader a landed file needs: ``delimited``, ``html`` or ``workbook``."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(suffix.isin(*DELIMITED_SUFFIXES) | (file_format == "unknown"), "delimited")
        .when(file_format == "html", "html").otherwise("workbook")
    )


def classify_content(files: DataFrame) -> DataFrame:
    """Files (``path``, ``content``) with format, label, reader and digest."""
    typed = files.withColumn("format", actual_file_format(F.col("content")))
    return typed.select(
        "path", "format", format_label(F.col("format")).alias("label"),
        scan_kind(F.col("path"), F.col("format")).alias("reader"),
        file_digest(F.col("content")).alias("digest"),
    )


def landed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(folder)
    )
