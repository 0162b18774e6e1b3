"""Delimited text scans: every cell is text, names come from the header line of each file."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.functions.text import field
from ledgerline.plans.mapping import make_unique_columns
from ledgerline.sources.formats import DELIMITED_SUFFIXES, classify_content, landed_files
from ledgerline.sources.html_report import read_html_report
from ledgerline.sources.rows import file_pieces, numbered_pieces

DELIMITERS = ",;\t|"
HEAD_BYTES, LONGEST_HEAD, SAMPLE = 65536, 1 << 26, 8192
RECORD, LONG = "__record", "__long"  # the text of a row that does not fit its header, and whether it has more cells
QUOTED = r'"(?:[^"]|"")*+"?'
BYTE_ORDER_MARK = bytes.fromhex("EFBBBF")
UTF8, WINDOWS = "utf-8-sig", "cp1252"
_HIGH = [(chr(b), bytes([b]).decode(WINDOWS, "ignore")) for b in range(0x80, 0xA0)]


@dataclass(frozen=True)
class Layout:
    """What the head of a file says about it; files that agree are scanned together."""

    encoding: str
    sep: str
    names: tuple[str, ...]
    several_lines: bool = False  # a line break stands inside a quoted name


def _decoded(head: bytes, encoding: str | None) -> tuple[str, str]:
    """Text and encoding of the head; a character cut off at its end does not count against UTF-8."""
    if encoding:
        return head.decode(encoding, "replace").removeprefix(chr(0xFEFF)), encoding
    for cut in range(4 if len(head) >= HEAD_BYTES else 1):
        try:
            return head[: len(head) - cut].decode(UTF8), UTF8
        except UnicodeDecodeError:
            continue
    return head.decode(WINDOWS, "replace"), WINDOWS


def _encoding_name(head: bytes, encoding: str | None) -> str:
    """The encoding as labels name it: the signature counts only where there is one."""
    found = _decoded(head, encoding)[1].lower()
    return "utf-8" if found == UTF8 and not head.startswith(BYTE_ORDER_MARK) else found


def _header(text: str, sep: str) -> tuple[list[str], bool]:
    """The first record of a text, and whether it takes several lines. Only line feeds and carriage returns end lines."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    return next(reader, []), reader.line_num > 1


def delimiter_of(sample: str) -> str:
    """The delimiter the sample suggests; a comma where it suggests none."""
    try:
        found = csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        found = ","
    first, _ = _header(sample, found)
    return ";" if len(first) < 2 and ";" in sample else found


def file_marks(spark: SparkSession, heads: dict[str, bytes]) -> dict[str, tuple[bool, bool]]:
    """For each file, by all its bytes, whether they are UTF-8 and whether some line has an odd number of quotes, as
    where a quoted cell goes on over a line break. Files longer than their heads are read by lines in a distributed pass."""
    out, places = {}, {}
    for path, head in heads.items():
        out[path] = _decoded(head, None)[1] == UTF8, any(line.count(b'"') % 2 for line in head.splitlines())
        if len(head) >= HEAD_BYTES:
            places[spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()] = path  # as scans tell it
    if places:
        line = F.col("value")
        quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
        lines = spark.read.text(list(places.values())).select(
            F.col("_metadata.file_path").alias("_path"), F.is_valid_utf8(line).alias("_valid"), (quotes % 2 == 1).alias("_odd"))
        for r in lines.groupBy("_path").agg(F.min("_valid").alias("_valid"), F.max("_odd").alias("_odd")).collect():
            out[places[r["_path"]]] = r["_valid"], r["_odd"]
    return out


def _encodings(marks: dict[str, tuple[bool, bool]], encoding: str | None) -> dict[str, str]:
    """The encoding of each file: the one given, or Windows-1252 where any of its bytes are not UTF-8."""
    return {path: encoding or (UTF8 if valid else WINDOWS) for path, (valid, _) in marks.items()}


def layout_of(head: bytes, sep: str | None = None, encoding: str | None = None) -> Layout:
    """Encoding, delimiter and column names by the first bytes of a file."""
    text, encoding = _decoded(head, encoding)
    sep = sep or delimiter_of(text[:SAMPLE])
    header, several_lines = _header(text, sep)
    return Layout(encoding, sep, tuple(make_unique_columns(header)), several_lines)


def file_heads(spark: SparkSession, paths: Iterable[str], size: int = HEAD_BYTES) -> dict[str, bytes]:
    """The first bytes of each file, as many as its first line needs, read where the plan is built as file footers are."""
    conf, out = spark._jsc.hadoopConfiguration(), {}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(conf).open(place)
        try:
            head = more = bytes(stream.readNBytes(size))
            while len(more) == size and len(head) < LONGEST_HEAD and not (b"\n" in head or b"\r" in head):
                more = bytes(stream.readNBytes(size))
                head += more
            out[path] = head
        finally:
            stream.close()
    return out


def _paths(spark: SparkSession, path: str) -> list[str]:
    """Files below ``path`` without the hidden ones; listing reads no content."""
    listed = landed_files(spark, path).select("path", "length").where("length > 0").collect()
    return sorted(r["path"] for r in listed)


def _cells(record: Column, sep: str) -> Column:
    """How many cells a raw record has: delimiters outside quotes, and one."""
    bare = F.regexp_replace(record, QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _scan(spark: SparkSession, paths: list[str], layout: Layout, multi_line: bool) -> DataFrame:
    windows = layout.encoding == WINDOWS
    charset = {UTF8: "UTF-8", WINDOWS: "ISO-8859-1"}.get(layout.encoding, layout.encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*layout.names, RECORD)])
    scan = (
        spark.read.options(sep=layout.sep, encoding=charset, multiLine=multi_line, quote='"', escape='"', header=True,
                           enforceSchema=True, inferSchema=False, emptyValue="", mode="PERMISSIVE",
                           columnNameOfCorruptRecord=RECORD).schema(schema).csv(paths)
    )
    pieces = file_pieces(scan).fillna("", list(layout.names))  # an empty cell is an empty text, not a missing one
    # Only rows that do not fit come with their record, so only those are looked at again. The second branch never
    # holds: the reader refuses to give the record without any other column.
    long = _cells(field(RECORD), layout.sep) > len(layout.names)
    pieces = pieces.withColumn(LONG, F.when(field(RECORD).isNotNull(), long).when(F.length(field(layout.names[0])) < 0, True))
    if not windows:
        return pieces
    source, target = "".join(a for a, b in _HIGH if b), "".join(b for _, b in _HIGH)
    return pieces.withColumns({n: F.translate(field(n), source, target) for n in (*layout.names, RECORD)})


def _fitted(rows: DataFrame, columns: list[Column], rescue: str | None) -> DataFrame:
    """``columns`` of the scanned rows; those that do not fit their header keep their record as ``rescue``, or the scan
    fails at the first that has more cells than names."""
    if rescue:
        return rows.select(*columns, F.coalesce(RECORD, F.lit("")).alias(rescue))
    place = [F.col(c).cast("string") for c in rows.columns if c in ("__file", "_row")]
    message = F.concat_ws(" ", F.lit("CSV tidak dapat dibaca: baris memiliki lebih banyak sel daripada header."), *place, field(RECORD))
    return rows.where(F.assert_true(~F.coalesce(LONG, F.lit(False)), message).isNull()).select(*columns)


def read_source_csv(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    multi_line: bool = False, row_numbers: str | None = "__row", per_file: bool = False, rescue: str | None = None,
) -> DataFrame:
    """Scan delimited files, all cells as text, no NULL inference.

    Unless given, the delimiter is found by the head of each file and the encoding (UTF-8, else Windows-1252) by all
    its bytes. Files with other headers or another order of columns keep their values
    under their own names; the result has the union of all columns, NULL where a file lacks
    one. Files are split over tasks unless ``multi_line`` asks for line breaks inside
    quotes. ``row_numbers`` names the ordinal (first data line is 2, counting on over the
    files or ``per_file``); ``__file`` tells the file.

    A row with more cells than its header has names fails the query and tells its file and ordinal, so that no cell is
    lost; missing cells are empty. ``rescue`` names a column that takes the record as it stands of every row that has
    more or fewer cells (else ""), and no row fails.
    """
    heads = file_heads(spark, _paths(spark, path))
    encodings = dict.fromkeys(heads, encoding) if encoding else _encodings(file_marks(spark, heads), None)
    return _read_files(spark, path, heads, encodings, dict.fromkeys(heads, multi_line), sep, row_numbers, per_file, rescue)


def _read_files(
    spark: SparkSession, path: str, heads: dict[str, bytes], encodings: dict[str, str], multi_line: dict[str, bool],
    sep: str | None = None, row_numbers: str | None = "__row", per_file: bool = False, rescue: str | None = None,
) -> DataFrame:
    groups: dict[tuple[Layout, bool], list[str]] = {}
    for name, head in heads.items():
        layout = layout_of(head, sep, encodings[name])
        groups.setdefault((layout, multi_line[name] or layout.several_lines), []).append(name)
    groups = {kind: paths for kind, paths in groups.items() if kind[0].names}
    if not groups:
        raise ValueError(f"{path}: CSV tidak dapat dibaca.")
    scans = [_scan(spark, paths, *kind) for kind, paths in groups.items()]
    pieces = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    names = list(dict.fromkeys(n for layout, _ in groups for n in layout.names))
    columns = [field(n) for n in names]
    if not row_numbers:
        return _fitted(pieces, columns, rescue)
    numbered = numbered_pieces(pieces, "_row", per_file=per_file)
    return _fitted(numbered, [*columns, F.col("__file"), F.col("_row").alias(row_numbers)], rescue)


def _suffix(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def read_uploaded_table(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool | None = None,
    rescue: str | None = None,
) -> tuple[DataFrame, str]:
    """Scan a landing folder, every file by its suffix or else its signature.

    The second result names the formats found. Only files whose suffix does not settle the
    reader have their content looked at. Delimited files are read with line breaks inside quotes where they
    hold such, or as ``multi_line`` says; only those are not split over tasks. Rows that do not fit their header are
    treated as :func:`read_source_csv` does. Delimited files and HTML reports may lie together:
    their rows are aligned by column name, ``__file`` and ``__row`` tell the place.
    Workbooks are not decoded here: convert them to CSV or Parquet upstream.
    """
    paths = _paths(spark, path)
    delimited = [p for p in paths if _suffix(p) in DELIMITED_SUFFIXES]
    others = [p for p in paths if _suffix(p) not in DELIMITED_SUFFIXES]
    parts, labels = [], []
    reports: list[str] = []
    if others:
        content = spark.read.format("binaryFile").load(others)
        found = classify_content(content).select("path", "reader", "label").collect()
        workbooks = sorted(r["path"] for r in found if r["reader"] == "workbook")
        if workbooks:
            raise ValueError(f"{path}: workbooks must be converted first: {', '.join(workbooks[:5])}")
        delimited += [r["path"] for r in found if r["reader"] == "delimited"]
        reports = [r["path"] for r in found if r["reader"] == "html"]
        labels += sorted({f"{r['label']} · Tabel Data" for r in found if r["reader"] == "html"})
    if delimited:
        heads = file_heads(spark, sorted(delimited))
        marks = file_marks(spark, heads)
        encodings = _encodings(marks, encoding)
        multi = {p: odd if multi_line is None else multi_line for p, (_, odd) in marks.items()}
        labels = sorted({f"Delimited text · {_encoding_name(h, encodings[p])}" for p, h in heads.items()}) + labels
        parts.append(_read_files(spark, path, heads, encodings, multi, sep, rescue=rescue))
    if reports:
        table = read_html_report(spark.read.format("binaryFile").load(reports))
        parts.append(table.withColumnsRenamed({"path": "__file", "row_no": "__row"}) if delimited else table)
    if not parts:
        raise ValueError(f"{path}: no files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), " + ".join(labels)
