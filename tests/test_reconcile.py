"""End-to-end scenarios, one flight number each, all reconciled in a single run."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.constants import (
    DETAIL_COLUMNS, MISSING_EXPORT_COLUMNS, NON_BILLABLE_TOKENS, SPECIAL_REMARK_KEYWORDS,
    VALIDATION_EXPORT_COLUMNS, VALIDATION_FOUND, VALIDATION_NOT_FOUND, VALIDATION_REVIEW,
    VALIDATION_REVIEW_DAT,
)
from ledgerline.functions.remarks import special_stream_remark_keyword
from ledgerline.plans.mapping import parse_status_list, validate_required_columns
from ledgerline.plans.reconcile import reconcile_dat_vs_stream
from ledgerline.sources import sinks
from ledgerline.sources.sinks import report_tables, write_report

RECORD = ["callsign", "adep", "ades", "eobd", "eobt", "atd", "ata", "register", "gate", "runway", "timeStamp", "messageNum"]
BILLING = ["DATE OF FLIGHT", "FLIGHT NUMBER", "AERODROME", "TO FROM", "AC REGISTER", "D/A/L/O", "RWY", "PARKING",
           "ATD", "ATA", "STATUS FLIGHT", "REMARK", "NOTES", "DIVERT", "RTB/RTA"]



def rec(callsign, eobd, adep="WIMM", ades="WIII", **more):
    return {**dict.fromkeys(RECORD, ""), "callsign": callsign, "adep": adep, "ades": ades, "eobd": eobd, **more}


def bill(flight, day, move, at, adep="WIMM", ades="WIII", register="", status="REGULER", **more):
    times = {"ATD": at} if move == "D" else {"ATA": at}
    return {**dict.fromkeys(BILLING, ""), "DATE OF FLIGHT": day, "FLIGHT NUMBER": flight, "AERODROME": adep,
            "TO FROM": ades, "AC REGISTER": register, "D/A/L/O": move, "STATUS FLIGHT": status, **times, **more}


DEPARTURES = [
    # an exact repeat, cells wrapped in quotes
    rec("'LNI201'", "'260523'", atd="'2026-05-23 22:19:00'", gate="'30'", runway="'23'", register="'PKLHO'"),
    rec("'LNI201'", "'260523'", atd="'2026-05-23 22:19:00'", gate="'30'", runway="'23'", register="'PKLHO'"),
    rec("CTV911", "260523", ades="WSSS", atd="23:01"),
    # tolerance edges
    rec("TOL30", "260620", atd="10:00"), rec("TOL31", "260620", atd="11:00"),
    rec("TOL121", "260620", atd="12:00"), rec("DATEBAD", "260620", atd="13:00"),
    # versions of one movement: time first, then completeness
    rec("ABC123", "260620", register="PKAAA", gate="10", runway="23", timeStamp="2026-06-20 09:00", messageNum="30"),
    rec("ABC123", "260620", atd="08:00", timeStamp="2026-06-20 08:00", messageNum="20"),
    rec("ABC123", "260620", atd="08:00", register="PKBEST", gate="12", runway="23", timeStamp="2026-06-20 07:00", messageNum="10"),
    # invalid status, window, unrelated flight date
    rec("OTHER1", "260624", atd="12:00", register="PKCCC"),
    rec("WINDOW1", "260524", atd="2026-05-24 23:55", register="PKWIN"),
    rec("ACTD01", "260624", atd="2026-06-25 00:10", register="PKDEP"),
    # no movement time
    rec("PKCAA", "260524", ades="WIHH"),
    # special remarks
    rec("DIV1", "260525", atd="06:14", register="PKABC"), rec("CHKDIV", "260525", atd="06:14", register="PKDIV"),
    rec("CHKRTB", "260525", atd="07:14", register="PKRTB"), rec("REGFAIL", "260525", atd="06:14", register="PKAAA"),
    rec("TIMEFAIL", "260525", atd="07:00", register="PKBBB"),
    rec("REG001", "260623", atd="10:00", register="PKAAA"),
    *[rec(f"X{token}9", "260620", atd="08:00") for token in NON_BILLABLE_TOKENS],
    rec("", "260620", atd="09:00"), rec("BADDAY", "someday", atd="09:00"),
]
ARRIVALS = [
    rec("LNI200", "260523", "WIII", "WIMM", ata="2026-05-24 00:09:00", register="PKLHO"),
    rec("WON1265", "260523", "WIMB", "WIMM", ata="2026-05-24 00:28:00"),
    # blank and complete version of one arrival, overnight without explicit date
    rec("SIA990", "260529", "WSSS", "WIMM", timeStamp="2026-05-29 23:00", messageNum="1"),
    rec("SIA990", "260529", "WSSS", "WIMM", atd="23:44", ata="00:48", register="9VMBT", gate="13", runway="23"),
    rec("2AMBO", "260620", "ZGGG", "WIMM", atd="2026-06-20 10:36", ata="2026-06-20 14:08", register="2AMBO"),
    rec("ARRSP1", "260525", "WIII", "WIMM", ata="2026-05-25 23:55", register="PKARR"),
    rec("NORMAL1", "260525", "WIII", "WIMM", ata="2026-05-25 10:00", register="PKNRM"),
    # midnight recovery: alone, matched, register mismatch
    *[
        row for flight in ("CTV010", "CTV011", "CTV013") for row in (
            rec(flight, "260623", "WIHH", "WIMM", eobt="2340", register="PKGLM", runway="23"),
            rec(flight, "260624", "WIHH", "WIMM", eobt="0045", atd="2026-06-24 00:54", ata="2026-06-24 02:52",
                register="PKGLM", gate="27", runway="23"),
        )
    ],
    # one key, two actual dates
    rec("TWODAYS", "260624", "WIHH", "WIMM", ata="2026-06-24 02:52", register="PKGLM"),
    rec("TWODAYS", "260624", "WIHH", "WIMM", ata="2026-06-25 02:09", register="PKGLM"),
]
STREAM = [
    bill("LNI201", "2026-05-23", "D", "2026-05-23 22:19", register="PKLHO"),
    bill("LNI200", "2026-05-23", "A", "2026-05-24 00:09", "WIII", "WIMM", "PKLHO"),
    bill("EXTRA1", "2026-05-23", "D", "09:00"),
    bill("TOL30", "2026-06-20", "D", "2026-06-20 10:30"), bill("TOL31", "2026-06-20", "D", "2026-06-20 11:31"),
    bill("TOL121", "2026-06-20", "D", "2026-06-20 14:01"), bill("DATEBAD", "2026-06-20", "D", "2026-06-19 13:00"),
    bill("OTHER1", "2026-06-24", "D", "2026-06-24 12:00", register="PKCCC", status="OTHER"),
    bill("WINDOW1", "2026-05-26", "D", "2026-05-25 00:10", register="PKWIN"),
    bill("ACTD01", "2026-06-23", "D", "2026-06-25 00:15", register="PKDEP"),
    bill("PKCAA", "2026-05-24", "D", "2026-05-24 09:00", ades="WIHH"),
    bill("DIV1", "2026-05-25", "D", "2026-05-25 06:16", "WIDD", "WADD", "PKABC", REMARK="DIVERT"),
    bill("CHKDIV", "2026-05-25", "D", "2026-05-25 06:14", "WIDD", "WADD", "PKDIV", DIVERT="checked"),
    bill("CHKRTB", "2026-05-25", "D", "2026-05-25 07:14", "WIDD", "WADD", "PKRTB", **{"RTB/RTA": "TRUE"}),
    bill("REGFAIL", "2026-05-25", "D", "2026-05-25 06:16", "WIDD", "WADD", "PKXXX", REMARK="RTB"),
    bill("TIMEFAIL", "2026-05-25", "D", "2026-05-25 08:00", "WIDD", "WADD", "PKBBB", REMARK="ALTERNATE"),
    bill("REG001", "2026-06-23", "D", "2026-06-23 10:00", register="PKXXX"),
    bill("REG001", "2026-06-23", "D", "2026-06-23 10:01", register="PKAAA"),
    bill("2AMBO", "2026-06-20", "A", "2026-06-19 14:08", "ZGGG", "WIMM", status="OTHER"),
    bill("ARRSP1", "2026-05-26", "A", "2026-05-26 00:10", "WIDD", "WADD", "PKARR", status="RTB"),
    bill("NORMAL1", "2026-05-25", "A", "2026-05-25 10:05", "WIII", "WIMM", "PKNRM"),
    bill("NORMAL1", "2026-05-25", "A", "2026-05-25 10:00", "WIDD", "WADD", "PKNRM", NOTES="DIVERSION"),
    bill("CTV011", "2026-06-23", "A", "2026-06-23 02:52", "WIHH", "WIMM", "PKGLM"),
    bill("CTV011", "2026-06-24", "A", "2026-06-24 02:52", "WIHH", "WIMM", "PKGLM"),
    bill("CTV013", "2026-06-24", "A", "2026-06-24 02:52", "WIHH", "WIMM", "PKXXX"),
    *[bill(f"X{token}9", "2026-06-20", "D", "08:00") for token in NON_BILLABLE_TOKENS],
]


def text_table(spark, columns, rows, rename=None):
    names = [(rename or {}).get(c, c) for c in columns]
    data = [(*[row[c] for c in columns], i) for i, row in enumerate(rows, start=2)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) + ", line int")


@pytest.fixture(scope="module")
def result(spark):
    departures = text_table(spark, RECORD, DEPARTURES, {"gate": "departureGate", "runway": "departureRunway"})
    arrivals = text_table(spark, RECORD, ARRIVALS, {"gate": "arrivalGate", "runway": "arrivalRunway"})
    return reconcile_dat_vs_stream(departures, arrivals, text_table(spark, BILLING, STREAM), row_col="line")


@pytest.fixture(scope="module")
def outcomes(result):
    rows = [r.asDict() for r in result.records.collect()]
    by_flight = {}
    for row in rows:
        by_flight.setdefault(row["FLIGHT NUMBER"], []).append(row)
    return by_flight


def only(outcomes, flight):
    assert len(outcomes[flight]) == 1
    return outcomes[flight][0]


@pytest.mark.parametrize("flight,status,reason,validasi", [
    ("LNI201", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("LNI200", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("WON1265", "MISSING IN STREAM", "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW AND ORIGINAL DATE SEARCH", VALIDATION_NOT_FOUND),
    ("TOL30", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("TOL31", "NEED REVIEW", "STREAM TIME DIFFERENCE", VALIDATION_REVIEW),
    ("TOL121", "MISSING IN STREAM", "STREAM TIME MISMATCH", VALIDATION_REVIEW),
    ("DATEBAD", "MISSING IN STREAM", "STREAM INVALID ATD DATE", VALIDATION_REVIEW),
    ("OTHER1", "MISSING IN STREAM", "STREAM STATUS OTHER", VALIDATION_REVIEW),
    ("WINDOW1", "MISSING IN STREAM", "STREAM INVALID ATD DATE", VALIDATION_REVIEW),
    ("ACTD01", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("PKCAA", "MISSING IN STREAM", "DAT MOVEMENT TIME EMPTY", VALIDATION_REVIEW_DAT),
    ("DIV1", "NEED REVIEW", "STREAM SPECIAL REMARK FOUND - ROUTE IGNORED FOR VALIDATION", VALIDATION_REVIEW),
    ("REGFAIL", "MISSING IN STREAM", "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW AND ORIGINAL DATE SEARCH", VALIDATION_NOT_FOUND),
    ("TIMEFAIL", "MISSING IN STREAM", "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW AND ORIGINAL DATE SEARCH", VALIDATION_NOT_FOUND),
    ("2AMBO", "MISSING IN STREAM", "STREAM STATUS OTHER / STREAM INVALID ATA DATE", VALIDATION_REVIEW),
    ("CTV010", "MISSING IN STREAM", "STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW, ORIGINAL, AND RECOVERED DATE SEARCH", VALIDATION_NOT_FOUND),
    ("CTV011", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("CTV013", "NEED REVIEW", "STREAM AC REGISTER MISMATCH", VALIDATION_REVIEW),
    ("REG001", "MATCHED", "VALID STREAM MATCH BY ACTUAL MOVEMENT DATE", VALIDATION_FOUND),
    ("BADDAY", "MISSING IN STREAM", "DAT MOVEMENT TIME EMPTY", VALIDATION_REVIEW_DAT),
])
def test_outcome(outcomes, flight, status, reason, validasi):
    row = only(outcomes, flight)
    assert (row["STATUS"], row["MATCH_REASON"], row["VALIDASI"]) == (status, reason, validasi)


def test_texts_and_codes_are_clean(outcomes):
    row = only(outcomes, "LNI201")
    assert (row["DATE OF FLIGHT"], row["ATD"], row["DEPARTURE GATE"], row["DEPARTURE RUNWAY"]) == (
        "2026-05-23", "22:19", "30", "23")
    assert row["FLIGHT_INSTANCE_KEY"] == "2026-05-23 | LNI201 | WIMM | WIII | D | PKLHO | 2026-05-23 | 18-23"
    assert only(outcomes, "BADDAY")["DATE OF FLIGHT"] == "SOMEDAY"


def test_overnight_arrival_keeps_its_flight_date(outcomes):
    row = only(outcomes, "SIA990")
    assert (row["ATD"], row["ATA"], row["DAT MOVEMENT DATETIME"], row["ACTUAL MOVEMENT DATE"]) == (
        "23:44", "00:48", "2026-05-30 00:48", "2026-05-30")
    assert (row["AC REGISTER"], row["ARRIVAL GATE"], row["ARRIVAL RUNWAY"]) == ("9VMBT", "13", "23")


def test_duplicates_and_reasons(result, outcomes):
    losers = {(r["FLIGHT NUMBER"], r["SOURCE ROW"]): r for r in result.duplicates.collect()}
    assert only(outcomes, "ABC123")["AC REGISTER"] == "PKBEST"
    assert {k[0] for k in losers} == {"LNI201", "ABC123", "SIA990", "CTV010", "CTV011", "CTV013"}
    first, second = (r for k, r in sorted(losers.items()) if k[0] == "ABC123")
    assert first["DUPLICATE_REASON"] == "MOVEMENT TIME EMPTY; BETTER RECORD SELECTED"
    assert second["DUPLICATE_REASON"] == "LOWER COMPLETENESS SCORE"
    blank = next(r for k, r in losers.items() if k[0] == "SIA990")
    assert (blank["COMPLETENESS_SCORE"], blank["HAS_MOVEMENT_TIME"], blank["SELECTED_RECORD_FLAG"]) == (0, False, False)
    source = next(r for k, r in losers.items() if k[0] == "CTV010")
    assert (source["USED_FOR_RECOVERY"], source["DUPLICATE_REASON"]) == (True, "USED FOR ADJACENT DATE MIDNIGHT RECOVERY")
    assert source["FLIGHT_INSTANCE_KEY"].endswith("| RECOVERY-SOURCE-DAT ARR-10")


def test_midnight_recovery_fills_the_target(outcomes):
    row = only(outcomes, "CTV010")
    assert (row["DATE OF FLIGHT"], row["ACTUAL MOVEMENT DATE"], row["ATD"], row["ATA"], row["ARRIVAL GATE"]) == (
        "2026-06-23", "2026-06-24", "00:54", "02:52", "27")
    assert (row["DAT_RECOVERY_USED"], row["DAT_RECOVERY_SOURCE_DATE"], row["DAT_RECOVERY_SOURCE_ROW"]) == (
        True, "2026-06-24", 10)
    found = only(outcomes, "CTV011")
    assert (found["STREAM MOVEMENT DATETIME"], found["TIME DIFFERENCE MINUTES"]) == ("2026-06-24 02:52", 0.0)
    assert found["STREAM VALIDATION RESULT"] == "VALID STREAM CANDIDATE BY ACTUAL MOVEMENT DATE"


def test_dates_make_distinct_instances(outcomes):
    assert {r["ACTUAL MOVEMENT DATE"] for r in outcomes["TWODAYS"]} == {"2026-06-24", "2026-06-25"}


def test_special_remarks(outcomes):
    row = only(outcomes, "DIV1")
    assert (row["STREAM MATCH MODE"], row["ROUTE MATCH IGNORED"], row["STREAM REMARK"], row["TIME DIFFERENCE MINUTES"]) == (
        "SPECIAL REMARK MATCH", True, "DIVERT", 2.0)
    assert only(outcomes, "CHKDIV")["SPECIAL REMARK KEYWORD FOUND"] == "DIVERT"
    assert only(outcomes, "CHKRTB")["SPECIAL REMARK KEYWORD FOUND"] == "RTB"
    late = only(outcomes, "ARRSP1")
    assert (late["SPECIAL REMARK KEYWORD FOUND"], late["TIME DIFFERENCE MINUTES"]) == ("RTB", 15.0)
    normal = only(outcomes, "NORMAL1")
    assert (normal["STATUS"], normal["STREAM MATCH MODE"], normal["STREAM SPECIAL REMARK FLAG"]) == (
        "MATCHED", "ACTUAL MOVEMENT DATE MATCH", False)


def test_register_beats_nearness(outcomes):
    row = only(outcomes, "REG001")
    assert (row["TIME DIFFERENCE MINUTES"], row["STREAM SOURCE ROW"]) == (1.0, 19)


def test_window_lookup_is_named(outcomes):
    row = only(outcomes, "WINDOW1")
    assert (row["STREAM MATCH DATE USED"], row["STREAM MATCH MODE"]) == (
        "ACTUAL MOVEMENT DATE +1 DAY", "ACTUAL MOVEMENT DATE WINDOW MATCH")


def test_extra_and_excluded(result):
    extra = {r["FLIGHT NUMBER"] for r in result.extra.collect()}
    assert extra == {"EXTRA1", "PKCAA", "REGFAIL", "TIMEFAIL"}
    excluded = result.excluded_non_billable.groupBy("SOURCE DATA").count().collect()
    assert {r["SOURCE DATA"]: r["count"] for r in excluded} == {
        "DAT DEP": len(NON_BILLABLE_TOKENS), "STREAM": len(NON_BILLABLE_TOKENS)}
    tokens = {f"X{t}9" for t in NON_BILLABLE_TOKENS}
    assert not tokens & {r["FLIGHT NUMBER"] for r in result.audit_detail.select("FLIGHT NUMBER").collect()}


def test_summary_is_consistent(result):
    s = result.summary_values()
    assert s["matched"] + s["need_review"] + s["missing_in_stream"] == s["total_dat_unique"]
    assert s["total_dat_unique"] + s["duplicate_dat"] == s["total_dat_combined"]
    assert s["total_dat_dep"] + s["total_dat_arr"] == s["total_dat_combined"]
    assert s["total_dat_combined"] + s["excluded_dat_non_billable"] == len(DEPARTURES) + len(ARRIVALS)
    assert s["total_stream"] == len(STREAM) - len(NON_BILLABLE_TOKENS)
    assert s["accuracy_percentage"] == s["matched"] / s["total_dat_unique"] * 100
    assert s["incomplete_dat_keys"] == 1 and s["extra_in_stream"] == 4
    lines = result.summary_table.orderBy("LINE").collect()
    assert [r["METRIC"] for r in lines][:2] == ["Total DAT DEP", "Total DAT ARR"] and len(lines) == 18
    assert lines[-1]["VALUE"] == s["accuracy_percentage"] / 100


def test_audit_holds_every_row_once_and_the_other_candidates(result):
    counts = {r["STATUS"]: r["count"] for r in result.audit_detail.groupBy("STATUS").count().collect()}
    s = result.summary_values()
    assert counts["MATCHED"] == s["matched"] and counts["DUPLICATE DAT"] == s["duplicate_dat"]
    assert counts["EXTRA IN STREAM"] == 4 and counts["STREAM CANDIDATE NOT SELECTED"] == 3
    others = result.not_selected.where(F.col("FLIGHT NUMBER") == "REG001").first()
    assert others["STREAM VALIDATION RESULT"] == (
        "NOT SELECTED / VALID STREAM CANDIDATE BY ACTUAL MOVEMENT DATE / STREAM AC REGISTER MISMATCH")


def test_report_datasets(result, spark, tmp_path):
    tables = report_tables(result)
    assert list(tables) == [
        "Summary", "Validasi", "Missing in Stream", "Matched", "Need Review", "Extra in Stream",
        "Duplicate DAT", "Audit Detail", "Excluded Non-Billable",
    ]
    assert tables["Missing in Stream"].columns == MISSING_EXPORT_COLUMNS and len(MISSING_EXPORT_COLUMNS) == 33
    assert tables["Validasi"].columns == VALIDATION_EXPORT_COLUMNS and len(VALIDATION_EXPORT_COLUMNS) == 17
    assert tables["Matched"].columns[:len(DETAIL_COLUMNS)] == DETAIL_COLUMNS
    paths = write_report(result, str(tmp_path / "report"))
    assert len(paths) == 9
    missing = spark.read.parquet(paths[2])
    assert dict(missing.dtypes)["DATE OF FLIGHT"] == "date"
    assert missing.count() == result.summary_values()["missing_in_stream"]


def test_the_audit_is_put_in_order_before_its_pairs_are_listed(result, spark, tmp_path, monkeypatch):
    from ledgerline.operators import lookup
    from ledgerline.operators.outputs import ordered_records
    from ledgerline.sources.sinks import typed_dates

    monkeypatch.setattr(lookup, "BLOCK_ROWS", 1)
    wanted = typed_dates(result.audit_detail)
    rows = result.audit_listed(ordered_records(result.audit_blocks), result.audit_detail.columns)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_rows") < plan.index("Sort [")
    path, = write_report(result, str(tmp_path / "report"), sheets=["Audit Detail"])
    written = spark.read.parquet(path)
    assert written.dtypes == wanted.dtypes
    assert sorted(map(str, written.collect())) == sorted(map(str, wanted.collect()))
    keys = ["day", "FLIGHT NUMBER", "D/A/L/O", "SOURCE DATA", "SOURCE ROW"]
    day = F.coalesce(F.col("DATE OF FLIGHT").cast("string"), "DATE OF FLIGHT (TEXT)", F.lit(""))
    placed = written.withColumn("day", day).select("_metadata.file_name", "_metadata.row_index", *keys).collect()
    order = [tuple(r)[2:] for r in sorted(placed, key=lambda r: (r.file_name, r.row_index))]
    assert order == sorted(order) and len(order) > 20


def test_a_report_is_replaced_as_a_whole_or_not_at_all(result, spark, tmp_path, monkeypatch):
    folder = tmp_path / "report"
    sheets = ["Matched", "Missing in Stream"]
    write_report(result, str(folder), "csv", sheets)
    assert {p.name for p in folder.iterdir()} == {*sheets, "Manifest", "Settings"}
    lines = {r.dataset: int(r.rows) for r in spark.read.option("header", True).csv(str(folder / "Manifest")).collect()}
    assert lines == {"Matched": result.matched.count(), "Missing in Stream": result.missing.count()}
    before = sorted((str(p), p.stat().st_mtime_ns) for p in folder.rglob("*"))

    def failing(df, path):
        if path.endswith("Missing in Stream"):
            raise OSError("disk full")
        sinks.write_csv(df, path)
    monkeypatch.setitem(sinks.WRITERS, "csv", failing)
    with pytest.raises(OSError, match="disk full"):
        write_report(result, str(folder), "csv", ["Matched", "Missing in Stream"])
    assert sorted((str(p), p.stat().st_mtime_ns) for p in folder.rglob("*")) == before
    monkeypatch.undo()
    first = spark.read.option("header", True).csv(str(folder / "Manifest")).collect()
    write_report(result, str(folder), "csv", sheets)
    assert sorted(spark.read.option("header", True).csv(str(folder / "Manifest")).collect()) == sorted(first)
    write_report(result, str(folder), "parquet", ["Need Review"])
    assert {p.name for p in folder.iterdir()} == {"Need Review", "Manifest", "Settings"}
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_closing_one_result_leaves_the_others(spark):
    from ledgerline.plans.staging import NONE, Run

    dep = spark.createDataFrame([("GA1", "CGK", "DPS", "2026-06-27", "10:00", 2)], "callsign string, adep string, ades string, eobd string, atd string, line int")
    arr = dep.limit(0)
    stream = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in BILLING) + ", line int")
    one, two = (reconcile_dat_vs_stream(dep, arr, stream, row_col="line") for _ in range(2))
    kept = [r.summary_values()["missing_in_stream"] for r in (one, two)]
    staged = [path for _, path in one.run._written]
    assert kept == [1, 1] and staged and all(os.path.exists(p) for p in staged)
    one.close()
    assert not any(os.path.exists(p) for p in staged)
    assert two.missing.count() == 1 and two.matched.count() == 0
    two.close()
    assert not two.run._written and not two.run._kept
    run = Run()
    shared = [reconcile_dat_vs_stream(dep, arr, stream, row_col="line", mode=r) for r in (run, run.hold())]
    shared[0].close()
    assert shared[1].missing.count() == 1
    shared[1].close()
    assert not run._written
    with pytest.raises(ValueError, match="mode"):
        Run("elsewhere")
    assert Run(NONE).stage(dep, "x") is dep


def test_keyword_of_each_remark(spark):
    rows = [(f"operation {k.lower()} confirmed", k) for k in SPECIAL_REMARK_KEYWORDS]
    df = spark.createDataFrame(rows, "NOTES string, wanted string")
    got = df.select("wanted", special_stream_remark_keyword(["NOTES"]).alias("found")).collect()
    assert all(r.found == r.wanted for r in got if r.wanted != "RETURN TO BASE")
    assert next(r.found for r in got if r.wanted == "RETURN TO BASE") == "RETURN TO BASE"


def test_options_are_checked(spark, result):
    mapping = dict.fromkeys(("flight", "eobd", "adep", "ades"), "x")
    issues = validate_required_columns(mapping, mapping, mapping)
    assert issues == ["STREAM: D/A/L/O"]
    empty = spark.createDataFrame([], "callsign string, adep string, ades string, eobd string")
    with pytest.raises(ValueError, match="D/A/L/O"):
        reconcile_dat_vs_stream(empty, empty, empty)
    stream = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in BILLING))
    for minutes in (0, 121):
        with pytest.raises(ValueError, match="tolerance"):
            reconcile_dat_vs_stream(empty, empty, stream, time_tolerance_minutes=minutes)
    assert parse_status_list(" other,\ncancelled ,") == ["OTHER", "CANCELLED"] and parse_status_list("") == ["OTHER"]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "callsign string, adep string, ades string, eobd string, line int")
    stream = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in BILLING) + ", line int")
    s = reconcile_dat_vs_stream(empty, empty, stream, row_col="line").summary_values()
    assert set(s.values()) == {0}
