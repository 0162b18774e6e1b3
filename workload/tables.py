"""Table-diff and file queries."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.operators import compare as ops
from ledgerline.operators.occurrence import occurrence_number
from ledgerline.operators.outputs import preview, select_with_backfill
from ledgerline.plans.compare import Comparison, compare_datasets
from ledgerline.plans.mapping import detect_mapping
from ledgerline.sources import formats, html_report, rows as row_numbers
from ledgerline.sources.delimited import read_source_csv, read_uploaded_table
from ledgerline.sources.sinks import COMPARISON_BUNDLE, write_comparison, write_csv
from workload.movements import table
from workload.scratch import scratch

KEYS = ("flight", "ades")
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders, and the same orders as a second system would report them."""
    o = row_numbers.spread(table(spark, sf_dir, "orders"))
    source = o.select(
        (F.col("o_orderkey") + 2).alias("row"),
        F.concat(F.lit("C "), F.col("o_custkey")).alias("Flight Number"), F.col("o_orderstatus").alias("From"),
        F.col("o_orderpriority").alias("Destination"), F.col("o_orderdate").alias("Date of Flight"),
        F.col("o_totalprice").alias("Parking"), F.lower("o_orderpriority").alias("Register"),
    )
    actual = o.select(
        (F.col("o_orderkey") + 2).alias("row"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("'c"), F.col("o_custkey"), F.lit("'"))).alias("Callsign"),
        F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("ADEP"),
        F.when(F.col("o_orderkey") % 7 == 0, "9-NEW").otherwise(F.col("o_orderpriority")).alias("ADES"),
        F.date_format(F.when(F.col("o_orderkey") % 11 == 0, F.date_add(F.col("o_orderdate").cast("date"), 1)).otherwise(
            F.col("o_orderdate").cast("date")), "dd/MM/yyyy").alias("EOBD"),
        F.col("o_totalprice").alias("Stand"), F.upper("o_orderpriority").alias("Registration"),
    )
    return source, actual


@lru_cache(maxsize=4)
def _shared(application: str, sf_dir: str) -> Comparison:
    source, actual = _sides(SparkSession.active(), sf_dir)
    maps = (detect_mapping(c for c in side.columns if c != "row") for side in (source, actual))
    return compare_datasets(source, actual, *maps, KEYS, row_col="row")


def _compared(spark, sf_dir) -> Comparison:
    """One comparison per session and scale; its result tables share the staged rows."""
    return _shared(spark.sparkContext.applicationId, sf_dir)


def forget() -> None:
    _shared.cache_clear()


SIDES_SQL = """
s0 AS (SELECT o_orderkey + 2 AS row, 'C' || o_custkey AS flight, o_orderstatus AS adep,
              regexp_replace(o_orderpriority, '[^A-Z0-9]+', '', 'g') AS ades, o_orderpriority AS ades_text,
              strftime(o_orderdate, '%Y-%m-%d') AS eobd FROM orders),
a0 AS (SELECT o_orderkey + 2 AS row, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'C' || o_custkey END AS flight,
              CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS adep,
              CASE WHEN o_orderkey % 7 = 0 THEN '9NEW' ELSE regexp_replace(o_orderpriority, '[^A-Z0-9]+', '', 'g') END AS ades,
              CASE WHEN o_orderkey % 7 = 0 THEN '9-NEW' ELSE o_orderpriority END AS ades_text,
              strftime(CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS eobd,
              regexp_replace(o_orderpriority, '[^A-Z0-9]+', '', 'g') AS reg FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY flight, ades ORDER BY row) AS occ FROM s0),
a AS (SELECT *, row_number() OVER (PARTITION BY flight, ades ORDER BY row) AS occ FROM a0),
sr AS (SELECT s.*, o_totalprice AS price, regexp_replace(o_orderpriority, '[^A-Z0-9]+', '', 'g') AS reg FROM s JOIN orders ON o_orderkey + 2 = row),
ar AS (SELECT a.*, o_totalprice AS price FROM a JOIN orders ON o_orderkey + 2 = row),
m AS (SELECT s.row AS srow, a.row AS arow, s.adep AS sadep, a.adep AS aadep, s.eobd AS seobd, a.eobd AS aeobd,
             concat_ws(', ', CASE WHEN s.adep <> a.adep THEN 'Aerodrome / ADEP / From' END,
                             CASE WHEN s.eobd <> a.eobd THEN 'EOBD / Date of Flight' END,
                             CASE WHEN s.reg <> a.reg THEN 'Register' END,
                             CASE WHEN s.price <> a.price THEN 'Parking / Gate' END) AS fields
      FROM sr s JOIN ar a ON s.flight = a.flight AND s.ades = a.ades AND s.occ = a.occ)
"""
MATCHED_SQL = f"""WITH {SIDES_SQL}
SELECT CASE WHEN fields = '' THEN 'Sama' ELSE 'Ada Perbedaan' END AS status, fields, srow, arow, sadep, aadep, seobd, aeobd FROM m"""


def _pairs(matched: DataFrame) -> DataFrame:
    return matched.select(
        F.col("Status Perbandingan").alias("status"), F.col("Field Berbeda").alias("fields"),
        F.col("Baris Sumber").alias("srow"), F.col("Baris Aktual").alias("arow"),
        F.col("Aerodrome / ADEP / From (Sumber)").alias("sadep"), F.col("Aerodrome / ADEP / From (Aktual)").alias("aadep"),
        F.col("EOBD / Date of Flight (Sumber)").alias("seobd"), F.col("EOBD / Date of Flight (Aktual)").alias("aeobd"),
    )


def _single(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("Keterangan").alias("note"), F.col("Asal Data").alias("origin"), F.col("Baris Asli").alias("row"),
        F.col("Flight Number / Callsign").alias("flight"), F.col("To / ADES").alias("ades"),
    )


SOURCE_ONLY = """SELECT 'Hanya ada di Data Sumber; tidak ditemukan di Data Aktual' AS note, 'Data Sumber' AS origin, row,
  'C ' || substr(flight, 2) AS flight, ades_text AS ades FROM s WHERE row NOT IN (SELECT srow FROM m)"""
ACTUAL_ONLY = """SELECT 'Hanya ada di Data Aktual; tidak ditemukan di Data Sumber' AS note, 'Data Aktual' AS origin, row,
  coalesce('c' || substr(flight, 2), '') AS flight, ades_text AS ades FROM a WHERE row NOT IN (SELECT arow FROM m)"""
SUMMARY = """SELECT (SELECT count(*) FROM s) AS source_total, (SELECT count(*) FROM a) AS actual_total,
  (SELECT count(*) FROM m) AS matched_total, (SELECT count(*) FROM s) - (SELECT count(*) FROM m) AS source_only_total,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM m) AS actual_only_total,
  (SELECT count(*) FROM m WHERE fields <> '') AS differences_total, CAST(0 AS BIGINT) AS source_incomplete_keys,
  (SELECT count(*) FROM a WHERE flight IS NULL) AS actual_incomplete_keys"""


def compare_matched(spark, sf_dir):
    return _pairs(_compared(spark, sf_dir).matched)


def compare_diff(spark, sf_dir):
    return _pairs(_compared(spark, sf_dir).differences)


def compare_source_only(spark, sf_dir):
    return _single(_compared(spark, sf_dir).source_only)


def compare_actual_only(spark, sf_dir):
    return _single(_compared(spark, sf_dir).actual_only)


def compare_unmatched(spark, sf_dir):
    return _single(_compared(spark, sf_dir).unmatched)


def compare_summary(spark, sf_dir):
    return _compared(spark, sf_dir).summary


def compare_incomplete(spark, sf_dir):
    """Blank keys pair up with blank keys when asked to: the second report against itself."""
    _, actual = _sides(spark, sf_dir)
    mapping = detect_mapping(c for c in actual.columns if c != "row")
    return compare_datasets(actual, actual, mapping, mapping, KEYS, True, row_col="row").summary


COMPARE_INCOMPLETE = """
SELECT count(*) AS source_total, count(*) AS actual_total, count(*) AS matched_total, CAST(0 AS BIGINT) AS source_only_total,
       CAST(0 AS BIGINT) AS actual_only_total, CAST(0 AS BIGINT) AS differences_total, count(*) FILTER (WHERE o_orderkey % 13 = 0) AS source_incomplete_keys,
       count(*) FILTER (WHERE o_orderkey % 13 = 0) AS actual_incomplete_keys FROM orders"""


def canonicalize(spark, sf_dir):
    _, actual = _sides(spark, sf_dir)
    mapping = detect_mapping(c for c in actual.columns if c != "row")
    return ops.canonicalize(actual, mapping, "row").select("__row", "flight", "adep", "ades", "eobd", "register", "movement")


CANONICALIZE = """
SELECT o_orderkey + 2 AS __row, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'c' || o_custkey END AS flight,
       CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS adep,
       CASE WHEN o_orderkey % 7 = 0 THEN '9-NEW' ELSE o_orderpriority END AS ades,
       strftime(CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS eobd,
       o_orderpriority AS register, CAST(NULL AS VARCHAR) AS movement FROM orders"""


def occurrence(spark, sf_dir):
    """Lines of an order that share a line number, counted over whole rows in value order."""
    li = table(spark, sf_dir, "lineitem")
    block = F.floor(F.col("l_partkey") / 512)
    return occurrence_number(li, ["l_orderkey", "l_linenumber"], LINE_ORDER, "occurrence", block).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "occurrence"
    )


OCCURRENCE = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) - 1 AS occurrence
FROM lineitem"""


def multiset_match(spark, sf_dir):
    """Lines against a copy with other line numbers: pairs by key and occurrence."""
    li = table(spark, sf_dir, "lineitem")
    block = F.floor(F.col("l_partkey") / 512)
    left = occurrence_number(li, ["l_orderkey", "l_linenumber"], LINE_ORDER, "occurrence", block)
    moved = li.withColumn("l_linenumber", F.when(F.col("l_quantity") > 45, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")))
    right = occurrence_number(moved, ["l_orderkey", "l_linenumber"], LINE_ORDER, "occurrence", block)
    ids = ["l_orderkey", "l_linenumber", "occurrence"]
    return left.select(*ids, F.col("l_extendedprice").alias("source_price")).join(
        right.select(*ids, F.col("l_extendedprice").alias("actual_price")), ids, "full_outer"
    )


MULTISET_MATCH = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS source_price,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) - 1 AS occurrence FROM lineitem),
r0 AS (SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN l_linenumber + 1 ELSE l_linenumber END AS l_linenumber) FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS actual_price,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) - 1 AS occurrence FROM r0)
SELECT * FROM l FULL JOIN r USING (l_orderkey, l_linenumber, occurrence)"""


def report_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("FLIGHT NUMBER"))
    return select_with_backfill(c, ["c_custkey", "FLIGHT NUMBER", "AERODROME"])


def report_preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey"))


def _page_files(spark, sf_dir) -> DataFrame:
    """Pages as landed files; some wrapped the way other exporters would write them."""
    page = F.col("html")
    shaped = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("PK\u0003\u0004"), page)).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("  \n"), page)).when(
        F.col("page_id") % 4 == 2, F.concat(F.lit("a;b\n"), F.regexp_replace(page, "<", "["))).otherwise(page)
    suffix = F.when(F.col("page_id") % 3 == 0, ".csv").otherwise(".xls")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.col("page_id").cast("string"), suffix).alias("path"), F.encode(shaped, "UTF-8").alias("content")
    )


def format_classify(spark, sf_dir):
    return formats.classify_content(_page_files(spark, sf_dir)).select("path", "format", "label", "reader")


FORMAT_CLASSIFY = """
WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xlsx' WHEN 2 THEN 'unknown' ELSE 'html' END AS format,
                  CASE WHEN page_id % 3 = 0 THEN '.csv' ELSE '.xls' END AS suffix FROM pages)
SELECT page_id || suffix AS path, format, CASE format WHEN 'xlsx' THEN 'Excel Workbook (XLSX)' WHEN 'html' THEN 'Tabel HTML berformat .xls'
         ELSE 'Format tidak dikenal' END AS label,
       CASE WHEN suffix = '.csv' OR format = 'unknown' THEN 'delimited' WHEN format = 'html' THEN 'html' ELSE 'workbook' END AS reader
FROM f"""


def digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", formats.file_digest(F.encode("html", "UTF-8")).alias("digest"))


def html_tables(spark, sf_dir):
    """Every order as an HTML report: a title table and a data table with uneven rows."""
    o = row_numbers.spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey").cast("string")
    page = F.concat(
        F.lit("<html><table><tr><th>Order</th></tr></table><TABLE><tr><th>KEY</th><th>STATUS</th><th>PRIORITY</th></tr><tr><td>"),
        key, F.lit("</td><td> "), F.col("o_orderstatus"), F.lit("<br>ok </td><td>"), F.col("o_orderpriority"),
        F.lit("</td><td>cut</td></tr><tr><td></td></tr><tr><td>a&amp;b "), key, F.lit("</td></tr></TABLE></html>"),
    )
    files = o.select(key.alias("path"), F.encode(page, "UTF-8").alias("content"))
    reports = html_report.report_rows(html_report.html_rows(files))
    return html_report.report_table(reports, [["KEY", "STATUS", "PRIORITY"]]).select("path", "row_no", "KEY", "STATUS", "PRIORITY")


HTML_TABLES = """
SELECT CAST(o_orderkey AS VARCHAR) AS path, 2 AS row_no, CAST(o_orderkey AS VARCHAR) AS "KEY", o_orderstatus || ' ok' AS "STATUS",
       o_orderpriority AS "PRIORITY" FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 4, 'a&b ' || o_orderkey, '', '' FROM orders"""


def html_reports(spark, sf_dir):
    """Every customer's orders as one HTML report; three exporters name and order the columns differently."""
    layout = F.col("o_custkey") % 3

    def row(tag: str, *cells: Column) -> Column:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))

    def by_layout(tag: str, key: Column, status: Column, priority: Column) -> Column:
        return F.when(layout == 0, row(tag, key, status)).when(layout == 1, row(tag, priority, key)).otherwise(row(tag, key, key, priority))

    head = by_layout("th", F.lit("KEY"), F.lit("STATUS"), F.lit("PRIORITY"))
    body = by_layout("td", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    orders = row_numbers.spread(table(spark, sf_dir, "orders"))
    files = orders.groupBy("o_custkey").agg(
        F.max(head).alias("head"), F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("tr")))).alias("rows"))
    page = F.concat(F.lit("<html><table>"), "head", F.array_join(F.transform("rows", lambda r: r["tr"]), ""), F.lit("</table></html>"))
    reports = html_report.read_html_report(
        files.select(F.col("o_custkey").cast("string").alias("path"), F.encode(page, "UTF-8").alias("content")))
    return reports.select("path", "row_no", "KEY", "STATUS", "PRIORITY", F.col("KEY (2)").alias("KEY_AGAIN"))


HTML_REPORTS = """
SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_no,
       CAST(o_orderkey AS VARCHAR) AS "KEY", CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS "STATUS",
       CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS "PRIORITY",
       CASE WHEN o_custkey % 3 = 2 THEN CAST(o_orderkey AS VARCHAR) END AS "KEY_AGAIN"
FROM orders"""


def csv_folder(spark, sf_dir):
    """Parts landed in one folder by three exporters, with other columns, another order and other delimiters."""
    path = scratch(spark, "folder")
    parts = table(spark, sf_dir, "part")
    exports = (("p_partkey", "p_name", "p_brand"), ","), (("p_type", "p_name", "p_partkey"), ";"), (("p_brand", "p_partkey", "p_size"), "\t")
    for i, (columns, sep) in enumerate(exports):
        parts.where(F.col("p_partkey") % 3 == i).select(*columns).write.csv(f"{path}/{i}", header=True, sep=sep)
    scanned = read_source_csv(spark, path)
    per_file = Window.partitionBy("__file")  # ordinals are dense within a file and the whole folder
    numbered = scanned.withColumn("dense", F.max("__row").over(per_file) - F.min("__row").over(per_file) + 1 == F.count("*").over(per_file))
    return numbered.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", "p_type", "p_size", "dense")


CSV_FOLDER = """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS p_name, CASE WHEN p_partkey % 3 <> 1 THEN p_brand END AS p_brand,
       CASE WHEN p_partkey % 3 = 1 THEN p_type END AS p_type, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size AS VARCHAR) END AS p_size,
       true AS dense
FROM part"""


def csv_round_trip(spark, sf_dir):
    """Parts written by the CSV sink and scanned again as text."""
    path = scratch(spark, "parts")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.lit("NA").alias("p_note"))
    write_csv(parts, path)
    scanned = read_source_csv(spark, path, row_numbers=None)
    return scanned.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", "p_note")


def uploaded_table(spark, sf_dir):
    """The same parts through the dispatching scan, which finds delimited text."""
    path = scratch(spark, "uploaded")
    write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), path)
    scanned, label = read_uploaded_table(spark, path)
    return scanned.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_type", F.lit(label).alias("label"))


def csv_ragged(spark, sf_dir):
    """Parts as an exporter with faults writes them: rows with a cell too many or two too few, and rows torn inside a quote."""
    path = scratch(spark, "ragged")
    key, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 7
    line = F.when(kind == 0, F.concat_ws(",", key, name, size, F.lit('"late, cell"'))).when(kind == 1, key).when(
        kind == 2, F.concat(key, F.lit(',"torn '), name)).otherwise(F.concat_ws(",", key, F.concat(F.lit('"'), name, F.lit(', ""new"""')), size))
    lines = table(spark, sf_dir, "part").select(line.alias("p_partkey,p_name,p_size"))
    lines.write.csv(path, header=True, sep="\x01", quote="", escapeQuotes=False)
    scanned = read_source_csv(spark, path, sep=",", rescue="record")
    return scanned.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.when(F.col("record") == "", F.col("p_name")).alias("p_name"),
                          F.when(~F.col("record").contains("torn"), F.col("p_size")).alias("p_size"), "record")


CSV_RAGGED = """
SELECT p_partkey, CASE WHEN p_partkey % 7 > 2 THEN p_name || ', "new"' END AS p_name,
       CASE p_partkey % 7 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS p_size,
       CASE p_partkey % 7 WHEN 0 THEN p_partkey || ',' || p_name || ',' || p_size || ',"late, cell"' WHEN 1 THEN CAST(p_partkey AS VARCHAR)
            WHEN 2 THEN p_partkey || ',"torn ' || p_name ELSE '' END AS record
FROM part"""


def html_cut(spark, sf_dir):
    """Every customer's orders as an HTML report of two tables; of a third of the reports the end is missing, so that their
    second table, the one with more rows, is never closed."""
    orders = row_numbers.spread(table(spark, sf_dir, "orders"))
    body = F.concat(F.lit("<tr><td>"), F.col("o_orderkey"), F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td></tr>"))
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("tr")))).alias("rows"))
    head = F.lit("<table><tr><th>KEY</th><th>STATUS</th></tr>")
    page = F.concat(
        F.lit("<html>"), head, F.lit("<tr><td>first</td><td>"), F.col("o_custkey"), F.lit("</td></tr></table>"), head,
        F.array_join(F.transform("rows", lambda r: r["tr"]), ""), F.lit("<tr><td>last</td><td>row</td></tr>"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("<tr><td>cut")).otherwise(F.lit("</table></html>")))
    reports = html_report.read_html_report(
        files.select(F.col("o_custkey").cast("string").alias("path"), F.encode(page, "UTF-8").alias("content")))
    return reports.select("path", "row_no", "KEY", "STATUS")


HTML_CUT = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
                  count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(n + 2 AS INTEGER) AS row_no, CAST(o_orderkey AS VARCHAR) AS "KEY", o_orderstatus AS "STATUS"
FROM o WHERE o_custkey % 3 <> 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(total + 3 AS INTEGER), 'last', 'row' FROM o WHERE n = 1 AND o_custkey % 3 <> 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 1, 'first', CAST(o_custkey AS VARCHAR) FROM o WHERE n = 1 AND o_custkey % 3 = 0"""


def file_ordinals(spark, sf_dir):
    """Orders written in key order as one folder of CSV files and scanned again: the ordinal of every single row."""
    path = scratch(spark, "ordinals")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").write.csv(path, header=True)
    scanned = read_source_csv(spark, path)
    return scanned.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("__row").alias("line"))


FILE_ORDINALS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS line FROM orders"


def comparison_sink(spark, sf_dir):
    """The five comparison datasets, written and read back."""
    folder = scratch(spark, "comparison")
    write_comparison(_compared(spark, sf_dir), folder, "parquet")
    counts = [
        spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"))
        for name in COMPARISON_BUNDLE
    ]
    return reduce(DataFrame.unionByName, counts)


COMPARISON_SINK = f"""WITH {SIDES_SQL}
SELECT '01_hanya_data_sumber' AS dataset, (SELECT count(*) FROM s) - (SELECT count(*) FROM m) AS rows
UNION ALL SELECT '02_hanya_data_aktual', (SELECT count(*) FROM a) - (SELECT count(*) FROM m)
UNION ALL SELECT '03_semua_tidak_cocok', (SELECT count(*) FROM s) + (SELECT count(*) FROM a) - 2 * (SELECT count(*) FROM m)
UNION ALL SELECT '04_data_cocok', (SELECT count(*) FROM m)
UNION ALL SELECT '05_perbedaan_nilai', (SELECT count(*) FROM m WHERE fields <> '')"""


def comparison_rows(spark, sf_dir):
    """The rows of the five written datasets, by the source rows they name."""
    folder = scratch(spark, "comparison")
    write_comparison(_compared(spark, sf_dir), folder, "parquet")
    parts = []
    for name in COMPARISON_BUNDLE:
        rows = spark.read.parquet(f"{folder}/{name}")
        if "Baris Asli" in rows.columns:
            ids = [F.when(F.col("Asal Data") == side, F.col("Baris Asli")) for side in ("Data Sumber", "Data Aktual")]
            note = F.col("Keterangan")
        else:
            ids, note = [F.col("Baris Sumber"), F.col("Baris Aktual")], F.col("Field Berbeda")
        parts.append(rows.select(F.lit(name).alias("dataset"), ids[0].alias("srow"), ids[1].alias("arow"), note.alias("note")))
    return reduce(DataFrame.unionByName, parts)


COMPARISON_ROWS = f"""WITH {SIDES_SQL},
so AS ({SOURCE_ONLY}), ao AS ({ACTUAL_ONLY})
SELECT '01_hanya_data_sumber' AS dataset, row AS srow, NULL AS arow, note FROM so
UNION ALL SELECT '02_hanya_data_aktual', NULL, row, note FROM ao
UNION ALL SELECT '03_semua_tidak_cocok', row, NULL, note FROM so
UNION ALL SELECT '03_semua_tidak_cocok', NULL, row, note FROM ao
UNION ALL SELECT '04_data_cocok', srow, arow, fields FROM m
UNION ALL SELECT '05_perbedaan_nilai', srow, arow, fields FROM m WHERE fields <> ''"""


def compare_shared(spark, sf_dir):
    """Rows of the first report whose key and occurrence the second one has, kept as they are."""
    source, actual = _sides(spark, sf_dir)
    prepared = [
        ops.prepare_for_matching(
            ops.canonicalize(df, detect_mapping(c for c in df.columns if c != "row"), "row"), list(KEYS), side
        ) for df, side in ((source, "SOURCE"), (actual, "ACTUAL"))
    ]
    return ops.shared_rows(*prepared, KEYS).select("__row", "key_flight", "key_ades", "occurrence")


COMPARE_SHARED = f"""WITH {SIDES_SQL}
SELECT row AS __row, flight AS key_flight, ades AS key_ades, occ - 1 AS occurrence FROM s WHERE row IN (SELECT srow FROM m)"""


def row_ordinals(spark, sf_dir):
    """Scan-order ordinals: gap-free, starting at line 2."""
    numbered = row_numbers.with_row_numbers(table(spark, sf_dir, "lineitem").select("l_orderkey"), "line")
    return numbered.agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("rows"),
        F.sum("line").alias("total"),
    )


ROW_ORDINALS = """
SELECT CAST(2 AS BIGINT) AS first, count(*) + 1 AS last, count(*) AS rows, CAST(count(*) * (count(*) + 3) / 2 AS BIGINT) AS total FROM lineitem"""

QUERIES = {
    "compare_matched": (compare_matched, MATCHED_SQL),
    "compare_diff": (compare_diff, MATCHED_SQL + " WHERE fields <> ''"),
    "compare_source_only": (compare_source_only, f"WITH {SIDES_SQL} {SOURCE_ONLY}"),
    "compare_actual_only": (compare_actual_only, f"WITH {SIDES_SQL} {ACTUAL_ONLY}"),
    "compare_unmatched": (compare_unmatched, f"WITH {SIDES_SQL} {SOURCE_ONLY} UNION ALL {ACTUAL_ONLY}"),
    "compare_summary": (compare_summary, f"WITH {SIDES_SQL} {SUMMARY}"),
    "compare_incomplete": (compare_incomplete, COMPARE_INCOMPLETE),
    "canonicalize": (canonicalize, CANONICALIZE),
    "occurrence_number": (occurrence, OCCURRENCE),
    "multiset_match": (multiset_match, MULTISET_MATCH),
    "report_backfill": (report_backfill, 'SELECT c_custkey, c_name AS "FLIGHT NUMBER", \'\' AS "AERODROME" FROM customer'),
    "report_preview": (report_preview, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10"),
    "format_classify": (format_classify, FORMAT_CLASSIFY),
    "digest": (digest, "SELECT page_id, substr(sha256(html), 1, 16) AS digest FROM pages"),
    "html_tables": (html_tables, HTML_TABLES),
    "html_reports": (html_reports, HTML_REPORTS),
    "csv_folder": (csv_folder, CSV_FOLDER),
    "csv_round_trip": (csv_round_trip, "SELECT p_partkey, p_name, p_brand, 'NA' AS p_note FROM part"),
    "uploaded_table": (uploaded_table, "SELECT p_partkey, p_name, p_type, 'Delimited text · utf-8' AS label FROM part"),
    "csv_ragged": (csv_ragged, CSV_RAGGED),
    "html_cut": (html_cut, HTML_CUT),
    "file_ordinals": (file_ordinals, FILE_ORDINALS),
    "comparison_sink": (comparison_sink, COMPARISON_SINK),
    "comparison_rows": (comparison_rows, COMPARISON_ROWS),
    "compare_shared": (compare_shared, COMPARE_SHARED),
    "row_ordinals": (row_ordinals, ROW_ORDINALS),
}
