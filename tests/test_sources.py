import hashlib

import pytest
from ledgerline.plans.mapping import detect_mapping
from ledgerline.sources.delimited import read_source_csv, read_uploaded_table
from ledgerline.sources.formats import classify_content
from ledgerline.sources.html_report import html_rows, report_rows
from ledgerline.sources.rows import with_row_numbers

REPORT = b"""<html><body>
<table><tr><td>Daily movements</td></tr></table>
<table><tr><th>DATE OF FLIGHT</th><th>FLIGHT NUMBER</th><th>AC REGISTER</th><th>RWY</th></tr>
<tr><td>2026-06-27</td><td>CTV<br>910</td><td> PK  GTG </td><td>23</td><td>cut off</td></tr>
<tr><td></td><td> </td></tr>
<tr><td>2026-06-28</td><td>A&amp;B<table><tr><td>inner</td></tr></table></td></tr>
</table></body></html>"""


def test_delimited_scan_keeps_text_and_names(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Flight Number;From;;From\nGA100;NA;007;x\n;;;\nID2;CGK;;\"a\"\"b\"\n".encode())
    df = read_source_csv(spark, str(tmp_path / "a.csv"), sep=";")
    assert df.columns == ["Flight Number", "From", "Kolom Tanpa Nama", "From (2)", "__file", "__row"]
    rows = [tuple(r)[:4] + (r["__row"],) for r in df.orderBy("__row").collect()]
    assert rows == [("GA100", "NA", "007", "x", 2), ("", "", "", "", 3), ("ID2", "CGK", "", 'a"b', 4)]


@pytest.mark.parametrize("per_file", [False, True])
def test_row_numbers_follow_the_file_over_many_splits(spark, tmp_path, per_file):
    for name, rows in (("one.csv", 3000), ("two.csv", 700)):
        body = "".join(f"{name}-{i}\n" for i in range(rows))
        (tmp_path / name).write_text("id\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        df = read_source_csv(spark, str(tmp_path), per_file=per_file)
        got = {(r["id"], r["__row"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    start = {"one.csv": 2, "two.csv": 2 if per_file else 3002}
    want = {(f"{n}-{i}", i + start[n]) for n, k in (("one.csv", 3000), ("two.csv", 700)) for i in range(k)}
    assert got == want


def test_row_numbers_of_a_table(spark):
    df = with_row_numbers(spark.range(0, 1000, 1, 7), "n")
    assert sorted((r.id, r.n) for r in df.collect()) == [(i, i + 2) for i in range(1000)]


def test_html_report_behind_a_spreadsheet_suffix(spark, tmp_path):
    (tmp_path / "stream.xls").write_bytes(REPORT)
    df, label = read_uploaded_table(spark, str(tmp_path / "stream.xls"))
    assert label.endswith("Tabel Data")
    rows = [tuple(r)[2:] for r in df.orderBy("row_no").collect()]
    assert rows == [("2026-06-27", "CTV 910", "PK GTG", "23"), ("2026-06-28", "A&Binner", "", "")]
    mapping = detect_mapping(df.columns[2:])
    assert (mapping["register"], mapping["runway"]) == ("AC REGISTER", "RWY")


def test_formats_labels_and_digests(spark):
    files = [
        ("a.xls", bytes.fromhex("d0cf11e0a1b11ae1") + b"x"), ("b.xlsx", b"PK\x03\x04z"),
        ("c.xls", b"  \n<!DOCTYPE HTML><p>"), ("d.csv", b"a,b\n"), ("e.bin", b"\xff\xfe <TABLE>"),
        ("f.tsv", REPORT),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: (r.format, r.reader, r.digest) for r in classify_content(df).collect()}
    kinds = {"a.xls": ("xls", "workbook"), "b.xlsx": ("xlsx", "workbook"), "c.xls": ("html", "html"),
             "d.csv": ("unknown", "delimited"), "e.bin": ("html", "html"), "f.tsv": ("html", "delimited")}
    assert got == {p: (*kinds[p], hashlib.sha256(c).hexdigest()[:16]) for p, c in files}


def test_files_of_one_folder_may_differ_in_columns(spark, tmp_path):
    (tmp_path / "1.csv").write_text("A,B\n1,2\n")
    (tmp_path / "2.csv").write_text("B,A\n3,4\n")
    (tmp_path / "3.csv").write_text("A;C\n5;6,7\n")
    (tmp_path / "4.csv").write_bytes("A,D\nx,caf\xe9 \x80\n".encode("latin-1"))
    df = read_source_csv(spark, str(tmp_path))
    rows = sorted(((r["__row"], r["A"], r["B"], r["C"], r["D"]) for r in df.collect()))
    assert rows == [(2, "1", "2", None, None), (3, "4", "3", None, None), (4, "5", None, "6,7", None), (5, "x", None, None, "café €")]


def test_delimiter_is_found(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Flight Number;From;To\nGA100;CGK;DPS\n")
    df, label = read_uploaded_table(spark, str(tmp_path))
    assert df.columns[:3] == ["Flight Number", "From", "To"] and label == "Delimited text · utf-8"


def test_reports_of_differing_headers_keep_all_rows(spark, tmp_path):
    for name, head, rows in (("a.xls", "AB", ["12", "34"]), ("b.xls", "AC", ["56"]), ("c.xls", "BA", ["78"])):
        cells = lambda tag, text: "".join(f"<{tag}>{c}</{tag}>" for c in text)
        body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows)
        (tmp_path / name).write_text(f"<html><table><tr>{cells('th', head)}</tr>{body}</table></html>")
    df, _ = read_uploaded_table(spark, str(tmp_path))
    got = sorted((r["path"][-5:], r["A"], r["B"], r["C"]) for r in df.collect())
    assert got == [("a.xls", "1", "2", None), ("a.xls", "3", "4", None), ("b.xls", "5", None, "6"), ("c.xls", "8", "7", None)]
    (tmp_path / "d.xls").write_text("<html><table><tr><td>no head</td></tr></table>")
    with pytest.raises(ValueError, match="d.xls"):
        read_uploaded_table(spark, str(tmp_path))


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FLIGHT NUMBER,RWY\nX1,09\n")
    (tmp_path / "b.xls").write_bytes(REPORT)
    df, label = read_uploaded_table(spark, str(tmp_path))
    assert sorted((r["FLIGHT NUMBER"], r["RWY"]) for r in df.collect()) == [("A&Binner", ""), ("CTV 910", "23"), ("X1", "09")]
    assert "Delimited" in label and "Tabel" in label


def test_odd_markup(spark):
    page = (b"</table><table><tr><td>lost<tr><th>K</th><th>V</th></tr><!-- <tr><td>x</td></tr> --><tr><td a='>'>1<script>a<b</script></td>"
            b"<td>&lt;&#233;\xe9</td></tr><tr></tr><tr><td>2</td><td>open</tr><tr><td>3</td></tr></table>")
    files = spark.createDataFrame([("p", page)], "path string, content binary")
    rows = [(r.row_no, r.is_header, r.cells) for r in html_rows(files).orderBy("row_no").collect()]
    assert rows == [(1, True, ["K", "V"]), (2, False, ["1a<b", "<éé"]), (4, False, ["2"]), (5, False, ["3"])]


def test_row_numbers_do_not_exchange_the_rows(spark, tmp_path):
    spark.range(0, 5000, 1, 8).write.parquet(str(tmp_path / "t"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = with_row_numbers(spark.read.parquet(str(tmp_path / "t")), "n")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.index("BroadcastHashJoin") < plan.index("Exchange")
        assert sorted(r.n for r in df.collect()) == list(range(2, 5002))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_encoding_follows_bytes_far_behind_the_head(spark, tmp_path):
    rows = [f"{i},Flight remark number {i}" for i in range(4000)]
    (tmp_path / "late one+1.csv").write_bytes("\n".join(["ID,REMARK", *rows, "4000,Caf\u00e9 \u20ac"]).encode("cp1252"))
    (tmp_path / "utf.csv").write_bytes("\n".join(["ID,REMARK", *rows, "4001,Caf\u00e9 \u20ac"]).encode())
    want = [("4000", "Caf\u00e9 \u20ac"), ("4001", "Caf\u00e9 \u20ac")]
    df = read_source_csv(spark, str(tmp_path))
    assert df.count() == 8002
    assert [tuple(r) for r in df.where("ID >= 4000").select("ID", "REMARK").orderBy("ID").collect()] == want
    df, label = read_uploaded_table(spark, str(tmp_path))
    assert label == "Delimited text \u00b7 cp1252 + Delimited text \u00b7 utf-8"
    assert [tuple(r) for r in df.where("ID >= 4000").select("ID", "REMARK").orderBy("ID").collect()] == want


def test_uploaded_cells_keep_their_line_breaks(spark, tmp_path):
    rows = [f"{i},Flight remark number {i}" for i in range(4000)]
    (tmp_path / "late.csv").write_text("\n".join(["ID,REMARK", *rows, '4000,"held at gate, ""late""\nthen\n\nleft"', "4001,after"]))
    (tmp_path / "plain.csv").write_text('ID,REMARK\n5000,"a ""b"" c"\n5001,last\n')
    (tmp_path / "short.csv").write_text('ID,REMARK\n6000,"one\ntwo"\n6001,end\n')
    df, _ = read_uploaded_table(spark, str(tmp_path))
    got = [tuple(r) for r in df.where("ID >= 4000 OR ID IS NULL OR ID = ''").select("ID", "REMARK", "__row").orderBy("__row").collect()]
    assert got == [("4000", 'held at gate, "late"\nthen\n\nleft', 4002), ("4001", "after", 4003), ("5000", 'a "b" c', 4004),
                   ("5001", "last", 4005), ("6000", "one\ntwo", 4006), ("6001", "end", 4007)]
    assert df.count() == 4006


def test_long_rows_fail_or_are_rescued(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,2\n"x, y",3\n1,2,3\n7\n8,\n9,"q"",z",\n')
    with pytest.raises(Exception, match=r"a\.csv 4 1,2,3"):
        read_source_csv(spark, str(tmp_path), sep=",").collect()
    rows = read_source_csv(spark, str(tmp_path), sep=",", rescue="record").orderBy("__row").collect()
    assert [(r.A, r.B, r["__row"], r.record) for r in rows] == [
        ("1", "2", 2, ""), ("x, y", "3", 3, ""), ("1", "2", 4, "1,2,3"), ("7", "", 5, "7"), ("8", "", 6, ""), ("9", 'q",z', 7, '9,"q"",z",')]
    (tmp_path / "a.csv").write_text("A,B\n1,2\n7\n")  # missing cells are no fault
    assert sorted((r.A, r.B) for r in read_source_csv(spark, str(tmp_path), sep=",").collect()) == [("1", "2"), ("7", "")]


def test_headers_with_line_breaks_and_unusual_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"A\nname",B\n1,2\n3,4\n'.encode())
    df = read_source_csv(spark, str(tmp_path / "a.csv"), sep=",")
    assert df.columns[1] == "B" and df.columns[0].split() == ["A", "name"] and len(df.columns) == 4
    assert [tuple(r)[:2] for r in df.orderBy("__row").collect()] == [("1", "2"), ("3", "4")]
    (tmp_path / "b.csv").write_bytes("A\u2028x,B\u0085y\n1,2\n".encode())
    assert len(read_source_csv(spark, str(tmp_path / "b.csv"), sep=",").columns) == 4
    wide = ",".join(f"column number {i}" for i in range(6000))
    (tmp_path / "c.csv").write_text(f"{wide}\n" + ",".join("7" * 6000) + "\n")
    assert len(wide) > 65536
    assert len(read_source_csv(spark, str(tmp_path / "c.csv"), sep=",").columns) == 6002


def test_tables_that_are_never_closed_are_no_tables(spark, tmp_path):
    head = "<table><tr><th>K</th></tr>"
    (tmp_path / "a.xls").write_text(f"<html>{head}<tr><td>closed</td></tr></table>{head}<tr><td>1</td></tr><tr><td>2</td></tr>")
    df, _ = read_uploaded_table(spark, str(tmp_path))
    assert [r["K"] for r in df.collect()] == ["closed"]
    (tmp_path / "b.xls").write_text(f"<html>{head}<tr><td>1</td></tr><tr><td>2</td></tr>")
    with pytest.raises(ValueError, match="b.xls"):
        read_uploaded_table(spark, str(tmp_path))


def test_files_are_taken_apart_within_their_row(spark):
    page = "<p>&amp;<table><tr><th>K</th><th>V</th></tr><tr><td>{0}&lt;<table><tr><td>in</td></tr></table></td><td> x<br/>y&amp;</td></tr></table>"
    files = spark.createDataFrame([(str(i), page.format(i).encode()) for i in range(50)], "path string, content binary")
    rows = html_rows(files)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan  # tokens are no rows, so none is exchanged or sorted
    got = sorted((int(r.path), r.table_no, r.row_no, r.is_header, r.cells) for r in rows.collect())
    assert got == [row for i in range(50) for row in ((i, 1, 0, True, ["K", "V"]), (i, 1, 1, False, [f"{i}<in", "x y&"]))]
    assert sorted(r.cells for r in report_rows(rows).collect()) == sorted([f"{i}<in", "x y&"] for i in range(50))
    assert "Join" not in report_rows(rows)._jdf.queryExecution().executedPlan().toString()  # the files are read once
