"""Table reports in HTML, taken apart by column expressions.

A report is split into an array of tokens (tags and the text between them). One pass over
its tags gives the depth of tables and the places of rows and cells; the text of a cell is
what stands between its tags. Only whole files are exchanged, by path, never their tokens.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerline.functions.text import WHITESPACE
from ledgerline.plans.mapping import make_unique_columns
from ledgerline.plans.staging import stage

RAW = r"<(?:script|style)\b[^>]*+>(?s:.*?)(?=</(?:script|style))"  # their content is text, whatever it holds
TOKEN = rf"(?i)(<!--(?s:.*?)-->|{RAW}|</?[a-z][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|<[!?][^>]*+>|[^<]++|<)"
TAG = r"^<(/?[a-zA-Z][a-zA-Z0-9]*)"
BLANKS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"
BYTE_ORDER_MARK = chr(0xFEFF)


def report_text(content: Column) -> Column:
    """UTF-8 where the bytes are that, else Windows-1252, else Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    known = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    windows = F.translate(latin, "".join(a for a, b in known if b), "".join(b for _, b in known))
    unknown = "[" + "".join(f"\\x{{{ord(a):x}}}" for a, b in known if not b) + "]"
    text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).when(latin.rlike(unknown), latin).otherwise(windows)
    return F.regexp_replace(decoded, f"^{BYTE_ORDER_MARK}", "")


def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda texts: [t and html.unescape(t) for t in texts], na_action="ignore")


_unescaped = F.pandas_udf(_unescape, T.ArrayType(T.StringType()))


def _rows_of(tags: str) -> list[tuple]:
    """Closed rows of the closed top-level tables in the tags of a file: (table_no, row_no, is_header, first and last
    tag of each cell that is closed)."""
    rows, row, begin = [], None, None
    depth = table_no = row_no = 0
    for at, tag in enumerate(tags.split(" ")):
        if tag == "table":
            depth += 1
            table_no += depth == 1
        elif tag == "/table":
            depth = max(depth - 1, 0)  # a closing tag too many counts for nothing
        elif depth != 1:
            continue
        elif tag == "tr":
            row, begin = [False, [], []], None
            row_no += 1
        elif row is None:
            continue
        elif tag == "/tr":
            if row[1]:
                rows.append((table_no, row_no - 1, *row))
            row = None
        elif tag in ("td", "th"):
            row[0], begin = row[0] or tag == "th", at
        elif tag in ("/td", "/th") and begin is not None:
            row[1].append(begin)
            row[2].append(at)
            begin = None
    # Only the last table of a file can stay open, where the file is cut off: it is no table then.
    return [r for r in rows if depth == 0 or r[0] < table_no]


def _places(values: pd.Series) -> pd.Series:
    return values.map(_rows_of, na_action="ignore")


_placed = F.pandas_udf(_places, T.ArrayType(T.StructType([
    T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("is_header", T.BooleanType()),
    T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType()))])))


def _collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, BLANKS, " "))


def _tokens(content: Column) -> Column:
    return F.regexp_extract_all(report_text(content), F.lit(TOKEN), F.lit(1))


def html_tokens(files: DataFrame) -> DataFrame:
    """(path, tokens, tags): every tag (``td``, ``/td``, lower case) and stretch of text of a file, in order.
    Contents under one path are read side by side, as one file."""
    contents = files.groupBy("path").agg(F.collect_list("content").alias("contents"))
    several = F.transform("contents", _tokens)
    places = F.sequence(F.lit(0), F.array_max(F.transform(several, F.size)))
    beside = F.flatten(F.transform(places, lambda i: F.array_compact(F.transform(several, lambda t: F.get(t, i)))))
    tokens = F.when(F.size("contents") > 1, beside).otherwise(_tokens(F.get("contents", F.lit(0))))
    return contents.select("path", F.filter(tokens, lambda t: ~t.startswith("<!--")).alias("tokens")).withColumn(
        "tags", F.transform("tokens", lambda t: F.when(t.startswith("<"), F.lower(F.regexp_extract(t, TAG, 1))).otherwise("")))


def html_rows(files: DataFrame) -> DataFrame:
    """Every row of every top-level table of files (``path``, ``content``):
    (path, table_no, row_no, is_header, cells). A table that is never closed has no rows.

    A file is taken apart within its own row: only its tags and the texts with entity references go to Python.
    """
    escaped = F.zip_with("tokens", "tags", lambda t, tag: F.when((tag == "") & t.contains("&"), t))
    placed = html_tokens(files).withColumns({
        "rows": _placed(F.array_join("tags", " ")),
        "plain": _unescaped(F.when(F.exists(escaped, lambda t: t.isNotNull()), escaped)),
    })
    said = F.zip_with("tokens", "tags", lambda t, tag: F.when(tag == "", t).when(
        tag.isin("script", "style"), F.regexp_replace(t, r"^<[^>]*+>", "")).when(tag == "br", " "))
    said = F.when(F.col("plain").isNull(), said).otherwise(F.zip_with("plain", said, lambda plain, t: F.coalesce(plain, t)))

    def cells(r: Column, said: Column) -> Column:
        return F.zip_with(r["first"], r["last"], lambda first, last: _collapsed(
            F.array_join(F.slice(said, first + 2, last - first - 1), "")))

    # The lambda binds the texts of the file, so they are made once and not for every cell.
    rows = F.get(F.transform(F.array(said), lambda said: F.transform("rows", lambda r: F.struct(
        r["table_no"].alias("table_no"), r["row_no"].alias("row_no"), r["is_header"].alias("is_header"),
        cells(r, said).alias("cells")))), F.lit(0))
    return placed.select("path", F.inline(rows))


def _header() -> Column:
    return F.max(F.when(F.col("is_header"), F.struct(
        F.size("cells").alias("width"), (-F.col("row_no")).alias("first"), F.col("cells").alias("headers"))))


def data_tables(rows: DataFrame) -> DataFrame:
    """(path, table_no, headers): the data table of each file that has one.

    Chosen is the table with a header that has the most data rows, then the widest header,
    then the first; its widest header row names the columns.
    """
    tables = rows.groupBy("path", "table_no").agg(
        F.count_if(~F.col("is_header")).alias("n"), _header().alias("header")).where(F.col("header").isNotNull())
    best = F.max_by(F.struct("table_no", "header.headers"), F.struct("n", "header.width", -F.col("table_no")))
    return tables.groupBy("path").agg(best.alias("best")).select("path", "best.table_no", "best.headers")


def report_rows(rows: DataFrame) -> DataFrame:
    """(path, row_no, headers, cells) of each file's data table (:func:`data_tables`, told by windows here so that
    ``rows`` is read once). Rows are cut or padded to the width of the header; rows without any text are dropped."""
    table, file = Window.partitionBy("path", "table_no"), Window.partitionBy("path")
    ranked = rows.where(F.col("path").isNotNull()).withColumns({
        "n": F.count_if(~F.col("is_header")).over(table), "header": _header().over(table)})
    place = F.struct("n", "header.width", (-F.col("table_no")).alias("first"), "header.headers")
    chosen = ranked.withColumn("best", F.max(F.when(F.col("header").isNotNull(), place)).over(file))
    width = F.size("headers")
    padded = F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.greatest(width - F.size("cells"), F.lit(0))))
    return (
        chosen.where(~F.col("is_header") & (F.col("best.first") == -F.col("table_no")))
        .withColumn("headers", F.col("best.headers"))
        .withColumn("cells", F.slice(padded, F.lit(1), width))
        .where(F.exists("cells", lambda c: c != ""))
        .select("path", "row_no", "headers", "cells")
    )


def report_table(reports: DataFrame, layouts: list[list[str]]) -> DataFrame:
    """One column for every header of ``layouts``, in order of appearance; a row fills those of its own file."""
    places: dict[str, Column] = {}
    for headers in layouts:
        mine = F.col("headers") == F.array(*[F.lit(h) for h in headers])
        for i, name in enumerate(make_unique_columns(headers)):
            value = F.when(mine, F.col("cells")[i])
            places[name] = F.coalesce(places[name], value) if name in places else value
    return reports.select("path", "row_no", *[value.alias(name) for name, value in places.items()])


def read_html_report(files: DataFrame) -> DataFrame:
    """Data rows of HTML reports with ``path`` and ``row_no``; the columns are the union of
    all files' headers, NULL where a file lacks one.

    The files are taken apart once and the rows kept (:func:`ledgerline.plans.staging.stage`).
    Plan time reads the distinct header rows, and the names of a few files that have no
    headed table if there are any: those raise, as nothing could be said about their rows.
    """
    rows = stage(html_rows(files), "html-rows")
    tables = data_tables(rows)
    layouts = tables.groupBy("headers").agg(F.min("path").alias("first")).orderBy("first").collect()
    bare = files.select("path").join(tables.select("path"), "path", "left_anti").limit(5).collect()
    if bare or not layouts:
        names = ", ".join(sorted(r["path"] for r in bare))
        raise ValueError(f"Tabel data dengan header tidak ditemukan di dalam file HTML. {names}".strip())
    return report_table(report_rows(rows), [list(r["headers"]) for r in layouts])
