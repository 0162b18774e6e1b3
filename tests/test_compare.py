import pytest
from pyspark.sql import functions as F

from ledgerline.functions.values import display_value, normalize_value
from ledgerline.operators.occurrence import occurrence_number
from ledgerline.plans.compare import compare_datasets
from ledgerline.plans.mapping import detect_mapping


def text_table(spark, columns, rows):
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.fixture(scope="module")
def sides(spark):
    source = text_table(
        spark, ["Flight Number", "From", "To", "Date of Flight", "EOBT", "ATD", "Register"],
        [
            ("GA 100", "CGK", "DPS", "27/06/2026", "08:30", "08:41", "PK-GAA"),
            ("ID200", "CGK", "SUB", "27/06/2026", "09:00", "09:12", "PK-IDA"),
            ("ID200", "CGK", "SUB", "27/06/2026", "09:00", "09:15", "PK-IDB"),
            ("QZ300", "DPS", "CGK", "27/06/2026", "10:00", "10:10", "PK-QZA"),
        ],
    )
    actual = spark.createDataFrame(
        [
            ("GA100", "WIII", "DPS", "2026-06-27", 830, "08:43", "PKGAA"),
            ("ID 200", "CGK", "SUB", "2026-06-27", 900, "09:12", "PK-IDA"),
            ("ID200", "CGK", "SUB", "2026-06-27", 900, "09:15", "PK-IDB"),
            ("JT400", "SUB", "CGK", "2026-06-27", 1100, "11:05", "PK-JTA"),
        ],
        "Callsign string, ADEP string, ADES string, EOBD string, EOBT int, ATD string, Registration string",
    ).coalesce(1)
    return source, actual


def test_duplicates_pair_by_occurrence(sides):
    source, actual = sides
    result = compare_datasets(
        source, actual, detect_mapping(source.columns), detect_mapping(actual.columns),
        ["flight", "eobd", "ades"],
    )
    counts = result.summary_values()
    assert counts == {
        "source_total": 4, "actual_total": 4, "matched_total": 3, "source_only_total": 1,
        "actual_only_total": 1, "differences_total": 1, "source_incomplete_keys": 0,
        "actual_incomplete_keys": 0,
    }
    pairs = {(r["Baris Sumber"], r["Baris Aktual"]) for r in result.matched.collect()}
    assert pairs == {(2, 2), (3, 3), (4, 4)}
    diff = result.differences.collect()
    assert [r["Field Berbeda"] for r in diff] == ["Aerodrome / ADEP / From, ATD"]
    assert diff[0]["EOBT (Aktual)"] == "08:30"
    only = result.unmatched.orderBy("Asal Data").collect()
    assert [(r["Asal Data"], r["Flight Number / Callsign"], r["Baris Asli"]) for r in only] == [
        ("Data Aktual", "JT400", 5), ("Data Sumber", "QZ300", 5),
    ]


def test_small_blocks_give_the_same_pairs(sides):
    source, actual = sides
    maps = detect_mapping(source.columns), detect_mapping(actual.columns)
    keys = ["flight", "eobd", "ades"]
    plain = compare_datasets(source, actual, *maps, keys).matched
    blocked = compare_datasets(source, actual, *maps, keys, block_rows=1).matched
    assert sorted(plain.collect()) == sorted(blocked.collect())


def test_occurrence_number_matches_a_plain_row_number(spark):
    rows = [(i, "hot" if i % 3 else "k%d" % (i % 7), i * 7919 % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "row long, k string, v int").withColumn(
        "k", F.when(F.col("row") % 11 == 0, None).otherwise(F.col("k"))
    )
    got = {r.row: r.n for r in occurrence_number(df, ["k"], ["row"], "n", F.floor(F.col("row") / 17)).collect()}
    seen, want = {}, {}
    for r in sorted(df.collect()):
        want[r.row] = seen.get(r.k, 0)
        seen[r.k] = want[r.row] + 1
    assert got == want


@pytest.mark.parametrize("allow,matched", [(False, 0), (True, 1)])
def test_blank_keys_match_only_on_request(spark, allow, matched):
    source = text_table(spark, ["Flight Number", "Date of Flight"], [("", "27/06/2026")])
    actual = text_table(spark, ["Callsign", "EOBD"], [("", "2026-06-27")])
    counts = compare_datasets(
        source, actual, detect_mapping(source.columns), detect_mapping(actual.columns),
        ["flight", "eobd"], allow_incomplete_keys=allow,
    ).summary_values()
    assert counts["matched_total"] == matched
    assert counts["source_only_total"] == counts["actual_only_total"] == 1 - matched
    assert counts["source_incomplete_keys"] == counts["actual_incomplete_keys"] == 1


def test_key_options_are_checked(sides):
    source, actual = sides
    maps = detect_mapping(source.columns), detect_mapping(actual.columns)
    for keys, message in (
        ([], "minimal satu"), (["nope"], "tidak dikenal"), (["movement"], "harus dipetakan"),
    ):
        with pytest.raises(ValueError, match=message):
            compare_datasets(source, actual, *maps, keys)


@pytest.mark.parametrize("value,name,expected", [
    ("GA 100", "flight", "GA100"), ("27/06/2026", "eobd", "2026-06-27"),
    ("27062026", "eobd", "2026-06-27"), ("20260627", "eobd", "2026-06-27"),
    ("46200", "eobd", "2026-06-27"), ("2026-06-27 08:30", "atd", "08:30"), ("-", "ata", None),
    ("830.0", "atd", "830:0"), ("late 7:05 ok", "atd", "07:05"), (" stand  a1 ", "parking", "STAND A1"),
])
def test_text_values(spark, value, name, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(normalize_value(F.col("v"), name)).first()[0] == expected


def test_typed_values(spark):
    df = spark.createDataFrame([(0.5, 830, "2026-06-27 -", 46200.0)], "f double, i int, s string, d double")
    row = df.select(
        normalize_value(F.col("f"), "eobt", "float"), normalize_value(F.col("i"), "eobt", "int"),
        display_value(F.col("s"), "ata"), normalize_value(F.col("d"), "eobd", "float"),
        display_value(F.col("d"), "parking", "float"),
    ).first()
    assert tuple(row) == ("12:00", "08:30", None, "2026-06-27", "46200")
