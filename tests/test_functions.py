import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, remarks, text, times
from ledgerline.plans.mapping import detect_mapping, make_unique_columns, normalize_header


def V():
    return F.col("v")


@pytest.fixture(scope="module")
def texts(spark):
    def apply(values, *expressions):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [tuple(r) for r in df.select(*[e.alias(f"c{i}") for i, e in enumerate(expressions)]).collect()]
    return apply


def test_cleaning(texts):
    values = [" 'x' ", "\"' a b '\"", "'\"'\"'deep'\"'\"'", "'", "''", " - ", "n/a", "NaT", None, "\u00a0q\u3000", "it's", "'a\""]
    assert texts(values, text.clean_text(V()), text.is_present(V())) == [
        ("x", True), ("a b", True), ("deep", True), ("'", True), (None, False), (None, False), (None, False),
        (None, False), (None, False), ("q", True), ("it's", True), ("'a\"", True)]
    assert texts(["-", " "], text.clean_scalar_text(V())) == [("-",), (None,)]


def test_codes(texts):
    values = ["GA 100", "ＧＡ１００", "pk-gaa", "é", "①ﬁ", "½", "Cafe\u0301", "㎏9", None]
    assert texts(values, text.normalize_code(V())) == [
        ("GA100",), ("GA100",), ("PKGAA",), (None,), ("1FI",), ("12",), ("CAF",), ("KG9",), (None,)]


@pytest.mark.parametrize("value,reconcile,compare", [
    ("260523", "2026-05-23", "2026-05-23"), ("690101", "1969-01-01", "1969-01-01"), ("680101", "2068-01-01", "2068-01-01"),
    ("269999", "269999", "269999"), ("20122026", "2026-12-20", "20122026"), ("20271306", "20271306", "20271306"),
    ("27/6/2026", "2026-06-27", "2026-06-27"), ("06/27/2026", "2026-06-27", "2026-06-27"),
    ("27.06.26", "2026-06-27", "2026-06-27"), ("2026-06-27T08:30:00", "2026-06-27", "2026-06-27"),
    ("2026-06-27x", "2026-06-27", "2026-06-27X"), ("2026-02-30", "2026-02-30", "2026-02-30"),
    ("46200", "46200", "2026-06-27"), ("27 June 2026", "2026-06-27", "2026-06-27"), ("jun 5, 2026", "2026-06-05", "2026-06-05"),
    ("some  day", "SOME DAY", "SOME DAY"), ("830", "830", "830"),
])
def test_dates(texts, value, reconcile, compare):
    assert texts([value], dates.normalize_date(V()), dates.normalize_compare_date(V())) == [(reconcile, compare)]


def test_month_first_timestamps_and_day_first_dates(texts):
    values = ["05/06/2026 08:30", "27/06/2026 08:30", "2026-06-27T08:30:15Z", "20260627 08:30", "06/27/26", "5/6/2026 7:05 PM", "08:30"]
    assert texts(values, times.parse_priority_timestamp(V()).cast("string"), times.has_explicit_date(V())) == [
        ("2026-05-06 08:30:00", True), ("2026-06-27 08:30:00", True), ("2026-06-27 08:30:15", False),
        ("2026-06-27 08:30:00", True), ("2026-06-27 00:00:00", True), ("2026-05-06 19:05:00", True), (None, False)]


def test_times(texts):
    values = ["8:30", "08.30", "830", "5", "23:59:59", "24:00", "12:60", "830.0", "x"]
    assert texts(values, times.time_minutes(V())) == [(m,) for m in (510, 510, 510, 5, 1439, None, None, None, None)]
    assert texts(["830", "25:00"], times.fallback_time_display(V())) == [("08:30",), ("25:00",)]


def test_anchoring_and_overnight(spark):
    df = spark.createDataFrame([("2026-05-29", "23:44", "00:48"), ("2026-05-29", "10:00", "2026-05-29 09:00"), ("bad", "10:00", "")],
                               "d string, l string, a string")
    rows = df.select(
        times.parse_datetime_value(F.col("l"), F.col("d")).alias("l"), times.parse_datetime_value(F.col("a"), F.col("d")).alias("a"),
        times.has_explicit_date(F.col("a")).alias("x"),
    ).select("l", times.overnight_arrival(F.col("l"), F.col("a"), F.col("x")))
    at = datetime.datetime
    assert [tuple(r) for r in rows.collect()] == [
        (at(2026, 5, 29, 23, 44), at(2026, 5, 30, 0, 48)), (at(2026, 5, 29, 10), at(2026, 5, 29, 9)), (None, None)]


def test_typed_cells(spark):
    df = spark.createDataFrame(
        [(46200.5, 260523, datetime.timedelta(hours=25, minutes=5), datetime.date(2026, 6, 27), 2.25)],
        "f double, i int, t interval day to second, d date, m double")
    day = F.lit("2026-01-02").cast("date")
    row = df.select(
        times.parse_datetime(F.col("f"), day, "float")[0].cast("string"), dates.normalize_date(F.col("i"), "int"),
        times.time_minutes(F.col("t"), "interval"), times.parse_datetime(F.col("d"), day, "date")[0].cast("string"),
        times.round_tenth(F.col("m")), text.display_text(F.lit(8.0), "float"), text.display_text(F.lit(8.5), "float"),
    ).first()
    assert tuple(row) == ("2026-06-27 12:00:00", "2026-05-23", 65, "2026-06-27 00:00:00", 2.2, "8", "8.5")


def test_float_texts(spark):
    df = spark.createDataFrame([(12345678.9,), (123456789012.5,), (0.00025,), (8.0,), (float("nan"),)], "f double")
    shown = df.select(text.display_text(F.col("f"), "float"), text.clean_text(text.as_text(F.col("f"), "float")))
    assert [tuple(r) for r in shown.collect()] == [
        ("12345678.9", "12345678.9"), ("123456789012.5", "123456789012.5"), ("0.00025", "0.00025"), ("8", "8.0"), (None, None)]


def test_message_numbers_and_buckets(texts, spark):
    assert texts(["12", "no. -3.5 x", "none", ""], times.parse_message_number(V())) == [(12.0,), (-3.5,), (None,), (None,)]
    df = spark.createDataFrame([(datetime.datetime(2026, 1, 1, 23, 59),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(times.time_bucket(F.col("t"))).collect()] == ["18-23", "NO-TIME"]


def test_remarks(spark):
    df = spark.createDataFrame(
        [("a", "A", "ok", "no"), ("", "", "Divert", ""), ("", "", "ok", "yes"), ("return  to", "", "", "0")],
        "REMARK string, Notes string, `Status Flight` string, `RTB/RTA` string")
    keyword = remarks.special_remark_keyword(df.columns)
    found = df.withColumn("k", keyword).select("k", remarks.remark_display(df.columns, F.col("k")))
    assert [tuple(r) for r in found.collect()] == [(None, "a"), ("DIVERT", "Divert"), ("RTB", "ok"), ("RETURN", "return  to")]
    codes = spark.createDataFrame([("X-car 9",), ("LNI1",), ("",)], "v string")
    assert [r[0] for r in codes.select(remarks.is_excluded_flight_number(V())).collect()] == [True, False, False]


def test_headers():
    assert normalize_header("  D/A/L/Ó ") == "dalo"
    assert make_unique_columns(["a", " a", None, ""]) == ["a", "a (2)", "Kolom Tanpa Nama", "Kolom Tanpa Nama (2)"]
    mapping = detect_mapping(["No", "Tanggal Penerbangan", "Reg", "Departure Runway", "Arrival Gate No", "Dep Runway"])
    assert (mapping["flight"], mapping["eobd"], mapping["register"]) == ("No", "Tanggal Penerbangan", "Reg")
    assert (mapping["departure_runway"], mapping["arrival_gate"], mapping["runway"]) == (
        "Departure Runway", "Arrival Gate No", "Dep Runway")
    assert detect_mapping(["No"], strict=True)["flight"] is None
