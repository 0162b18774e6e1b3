"""Reconciliation queries: every step of the two-sided job, over all events."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.constants import MODE_SPECIAL
from ledgerline.functions import times
from ledgerline.functions.text import field
from ledgerline.operators import auditcounts, dedup, evaluate as ev, extra as extra_ops, filters, instances, keys, lookup, outputs, recovery
from ledgerline.operators.summary import reason_histogram
from ledgerline.plans.reconcile import Reconciliation, reconcile_dat_vs_stream
from ledgerline.sources.delimited import read_source_csv
from ledgerline.sources.sinks import report_tables, write_csv, write_report
from workload import movements
from workload.scratch import scratch
from workload.movements import reconcile_events, sql


@lru_cache(maxsize=4)
def _shared(application: str, sf_dir: str) -> Reconciliation:
    return reconcile_events(SparkSession.active(), sf_dir)


@lru_cache(maxsize=4)
def _one_flight(application: str, sf_dir: str) -> Reconciliation:
    return movements.reconcile_one_flight(SparkSession.active(), sf_dir)


def reconciled(spark: SparkSession, sf_dir: str) -> Reconciliation:
    """One reconciliation per session and scale; its result tables share the staged steps."""
    return _shared(spark.sparkContext.applicationId, sf_dir)


def forget() -> None:
    _shared.cache_clear()
    _one_flight.cache_clear()


def _names(**columns: str | Column) -> list[Column]:
    return [(field(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]


ID = {"src": "SOURCE DATA", "row": "SOURCE ROW"}
ROUTE = {"dof": "DATE OF FLIGHT", "flight": "FLIGHT NUMBER", "adep": "AERODROME", "ades": "TO FROM", "move": "D/A/L/O"}


def standardize_records(spark, sf_dir):
    r = reconciled(spark, sf_dir)
    both = r.combined.unionByName(r.excluded_records)
    return both.select(*_names(
        **ID, **ROUTE, register="AC REGISTER", moved_on="ACTUAL MOVEMENT DATE", atd_text="ATD", ata_text="ATA",
        arrival_gate="ARRIVAL GATE", departure_gate="DEPARTURE GATE", arrival_runway="ARRIVAL RUNWAY",
        departure_runway="DEPARTURE RUNWAY", moved=times.format_datetime(F.col("MOVEMENT_DATETIME")),
        eobt=times.format_datetime(F.col("EOBT_DATETIME")), version="TIMESTAMP", message="MESSAGE NUM",
        differs="MOVEMENT_DATE_DIFFERS_FROM_FLIGHT_DATE",
    ))


STANDARDIZE_RECORDS = sql("""
SELECT src, row, dof, flight, adep, ades, move, register, strftime(moved, '%Y-%m-%d') AS moved_on, atd_text, ata_text,
       CASE WHEN move = 'A' THEN gate END AS arrival_gate, CASE WHEN move = 'D' THEN gate END AS departure_gate,
       CASE WHEN move = 'A' THEN runway END AS arrival_runway, CASE WHEN move = 'D' THEN runway END AS departure_runway,
       strftime(moved, '%Y-%m-%d %H:%M') AS moved, strftime(eobt, '%Y-%m-%d %H:%M') AS eobt,
       strftime(version, '%Y-%m-%d %H:%M:%S') AS version, 'MSG ' || CAST(CAST(message AS BIGINT) AS VARCHAR) AS message,
       coalesce(CAST(moved AS DATE) <> fd, false) AS differs
FROM stdm""", 2)


def standardize_billing(spark, sf_dir):
    return reconciled(spark, sf_dir).billing.select(*_names(
        row="SOURCE ROW", **ROUTE, register="AC REGISTER", moved=times.format_datetime(F.col("STREAM_MOVEMENT_DATETIME")),
        status="STREAM STATUS FLIGHT", special="STREAM SPECIAL REMARK FLAG", keyword="SPECIAL REMARK KEYWORD FOUND",
        remark="STREAM REMARK", parking=F.coalesce("ARRIVAL GATE", "DEPARTURE GATE"),
    ))


STANDARDIZE_BILLING = sql("""
SELECT row, dof, flight, adep, ades, move, register, strftime(moved, '%Y-%m-%d %H:%M') AS moved, status, special, keyword,
       remark, CASE WHEN move = 'L' THEN NULL ELSE k END AS parking FROM bil""", 3)


def exclude_split(spark, sf_dir):
    return reconciled(spark, sf_dir).excluded_non_billable.select(*_names(
        **ID, **ROUTE, status="STATUS", reason="MATCH_REASON",
    ))


EXCLUDE_SPLIT = sql("""
SELECT src, row, dof, coalesce(flight, '') AS flight, adep, ades, move, 'EXCLUDED NON-BILLABLE' AS status,
       'FLIGHT NUMBER MATCHES INTERNAL/NON-BILLABLE RULE' AS reason FROM stdm WHERE excluded
UNION ALL SELECT 'STREAM', row, dof, flight, adep, ades, move, 'EXCLUDED NON-BILLABLE',
       'FLIGHT NUMBER MATCHES INTERNAL/NON-BILLABLE RULE' FROM bil1 WHERE excluded""", 3)


def union_sides(spark, sf_dir):
    r = reconciled(spark, sf_dir)
    return r.combined.groupBy(F.col("SOURCE DATA").alias("src")).agg(
        F.count("*").alias("records"), F.count("MOVEMENT_DATETIME").alias("timed"),
        F.min("DATE OF FLIGHT").alias("first_day"),
    )


UNION_SIDES = sql("SELECT src, count(*) AS records, count(moved) AS timed, min(dof) AS first_day FROM kept GROUP BY src", 2)


def recovery_pairs(spark, sf_dir):
    return recovery.recovery_pairs(reconciled(spark, sf_dir).combined)


RECOVERY_PAIRS = sql("SELECT tsrc AS target_data, trow AS target_row, tsrc AS source_data, srow AS source_row FROM pairs", 4)


def recovery_one_flight(spark, sf_dir):
    """The same choice where one flight holds nearly all movements, in blocks of 20 events or more."""
    return recovery.recovery_pairs(_one_flight(spark.sparkContext.applicationId, sf_dir).combined, block_rows=20)


RECOVERY_ONE_FLIGHT = sql(
    "SELECT tsrc AS target_data, trow AS target_row, tsrc AS source_data, srow AS source_row FROM pairs", 4, movements.SQL_ONE_FLIGHT)


def midnight_recovery(spark, sf_dir):
    return reconciled(spark, sf_dir).recovered.select(*_names(
        **ID, register="AC REGISTER", atd_text="ATD", ata_text="ATA", moved_on="ACTUAL MOVEMENT DATE",
        moved=times.format_datetime(F.col("DAT_MOVEMENT_DATETIME")), recovered="DAT_RECOVERY_USED",
        reason="DAT_RECOVERY_REASON", source_date="DAT_RECOVERY_SOURCE_DATE", source_row="DAT_RECOVERY_SOURCE_ROW",
        original_date="ORIGINAL_DAT_DATE", recovered_date="RECOVERED_DAT_DATE", used="USED_FOR_RECOVERY",
    ))


MIDNIGHT_RECOVERY = sql("""
SELECT src, row, register, atd_text, ata_text, strftime(moved, '%Y-%m-%d') AS moved_on,
       strftime(moved, '%Y-%m-%d %H:%M') AS moved, recovered,
       CASE WHEN recovered THEN 'ADJACENT DATE MIDNIGHT RECOVERY'
            WHEN used THEN 'USED AS ADJACENT DATE MIDNIGHT RECOVERY SOURCE' END AS reason,
       source_date, source_row, CASE WHEN recovered THEN dof END AS original_date, source_date AS recovered_date, used
FROM recd""", 4)


def recovery_order(spark, sf_dir):
    """Targets in processing order: place inside their group by source row."""
    targets, _ = recovery.recovery_events(reconciled(spark, sf_dir).combined)
    from ledgerline.operators.occurrence import occurrence_number

    return occurrence_number(targets, ["group"], ["row"], "place").select("data", "row", "place")


RECOVERY_ORDER = sql("""
SELECT src AS data, row, row_number() OVER (PARTITION BY gid ORDER BY row) - 1 AS place FROM tgt
WHERE start_at <= CAST(fd AS TIMESTAMP) + INTERVAL 30 HOUR""", 4)


def _keyed(spark, sf_dir) -> DataFrame:
    return keys.prepare_keys(reconciled(spark, sf_dir).recovered)


def key_preparation(spark, sf_dir):
    return _keyed(spark, sf_dir).select(*_names(
        **ID, movement_date="_movement_date", complete="_complete_key", complete_movement="_complete_movement_key",
        complete_special="_complete_special_key", group_key="DUPLICATE_GROUP_KEY",
    ))


KEY_PREPARATION = sql("""
SELECT src, row, strftime(moved, '%Y-%m-%d') AS movement_date, flight IS NOT NULL AS complete,
       flight IS NOT NULL AND moved IS NOT NULL AS complete_movement, flight IS NOT NULL AS complete_special,
       dof || ' | ' || coalesce(flight, '') || ' | ' || adep || ' | ' || ades || ' | ' || move AS group_key
FROM recd""", 4)


def _plain_keys() -> list[Column]:
    return [F.concat_ws("|", *instances.KEYS).alias("key5")]


def slot_register(spark, sf_dir):
    return instances.slot_registers(_keyed(spark, sf_dir)).select(
        *_plain_keys(), F.col("actual_date").alias("moved_on"), "bucket", "slot_register"
    )


SLOT_REGISTER = sql("SELECT key5, moved_on, bucket, slot_register FROM slot", 5)


def movement_instances(spark, sf_dir):
    return instances.movement_instances(_keyed(spark, sf_dir)).select(
        *_plain_keys(), F.col("actual_date").alias("moved_on"), "bucket", "register",
        F.col("moved").cast("string").alias("first_at"), F.col("row").alias("first_row"),
    )


MOVEMENT_INSTANCES = sql("""
SELECT key5, moved_on, bucket, register, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, first_row FROM inst""", 5)


def attach_timeless(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return instances.attach_timeless(keyed, instances.movement_instances(keyed)).select(
        *_plain_keys(), "register", times.format_datetime(F.col("at")).alias("eobt"), "found",
        F.col("instance.actual_date").alias("moved_on"), F.col("instance.bucket").alias("bucket"),
        F.col("instance.register").alias("picked_register"),
    )


ATTACH_TIMELESS = sql("""
SELECT DISTINCT o.key5, coalesce(o.register, '') AS register, strftime(o.eobt, '%Y-%m-%d %H:%M') AS eobt,
       coalesce(p.n, 0) AS found, CASE WHEN p.ok = 1 THEN p.moved_on END AS moved_on,
       CASE WHEN p.ok = 1 THEN p.bucket END AS bucket, CASE WHEN p.ok = 1 THEN p.ireg END AS picked_register
FROM open0 o LEFT JOIN pickd p ON p.src = o.src AND p.row = o.row""", 5)


def instance_key(spark, sf_dir):
    return reconciled(spark, sf_dir).resolved.select(*_names(
        **ID, instance="FLIGHT_INSTANCE_KEY", bucket="MOVEMENT_TIME_BUCKET",
    ))


INSTANCE_KEY = sql("SELECT src, row, ikey AS instance, ibucket AS bucket FROM named", 5)


def completeness(spark, sf_dir):
    return reconciled(spark, sf_dir).resolved.select(*_names(
        **ID, score="COMPLETENESS_SCORE", has_time="HAS_MOVEMENT_TIME", message="_message_number",
        version=F.col("_priority_timestamp").cast("string"),
    ))


COMPLETENESS = sql("""
SELECT src, row, score, has_time, message, strftime(version, '%Y-%m-%d %H:%M:%S') AS version FROM named""", 5)


def dedup_best(spark, sf_dir):
    resolved = reconciled(spark, sf_dir).resolved
    eligible = resolved.where(F.col("_complete_key") & ~F.col("USED_FOR_RECOVERY"))
    return dedup.best_per_instance(eligible).select(
        F.col("FLIGHT_INSTANCE_KEY").alias("instance"), F.col("_winner")["SOURCE ROW"].alias("row"),
        F.col("_winner")["COMPLETENESS_SCORE"].alias("score"),
    )


DEDUP_BEST = sql("SELECT ikey AS instance, row, score FROM best", 5)


def dedup_selected(spark, sf_dir):
    return reconciled(spark, sf_dir).unique.select(*_names(**ID, **ROUTE, register="AC REGISTER"))


DEDUP_SELECTED = sql("SELECT src, row, dof, flight, adep, ades, move, register FROM resolved WHERE selected", 5)


def dedup_losers_reason(spark, sf_dir):
    return reconciled(spark, sf_dir).duplicates.select(*_names(
        **ID, **ROUTE, status="STATUS", reason="DUPLICATE_REASON", instance="DUPLICATE_GROUP_KEY",
        selected="SELECTED_RECORD_FLAG", score="COMPLETENESS_SCORE", used="USED_FOR_RECOVERY",
        source_row="DAT_RECOVERY_SOURCE_ROW",
    ))


DEDUP_LOSERS_REASON = sql("""
SELECT src, row, dof, coalesce(flight, '') AS flight, adep, ades, move, 'DUPLICATE DAT' AS status, reason, ikey AS instance,
       selected, score, used, source_row FROM resolved WHERE NOT selected""", 5)


def _lookup_texts() -> list[Column]:
    """Wording of a lookup number."""
    texts = [*lookup.LOOKUPS, (lookup.SPECIAL_DATE_USED, MODE_SPECIAL)]
    number = F.col("lookup") + 1
    return [
        F.element_at(F.array(*[F.lit(t[i]) for t in texts]), number).alias(n) for i, n in enumerate(("date_used", "mode"))
    ]


def search_specs(spark, sf_dir):
    records, _ = reconciled(spark, sf_dir).sides
    return lookup.search_records(records).select(
        F.col("l_data").alias("src"), F.col("l_row").alias("row"), F.col("by").alias("index"),
        F.col("date").alias("day"), *_lookup_texts(),
    )


SEARCH_SPECS = sql("""
SELECT s.src, s.row, s.by AS index, s.date AS day, s.date_used, s.mode
FROM spec s JOIN l ON l.src = s.src AND l.row = s.row WHERE l.flight IS NOT NULL""")


def multikey_candidates(spark, sf_dir):
    return lookup.lookup_pairs(*reconciled(spark, sf_dir).sides).select(
        F.col("l_data").alias("src"), F.col("l_row").alias("row"), "r_row", *_lookup_texts()
    )


MULTIKEY_CANDIDATES = sql("""
SELECT src, row, rrow AS r_row, date_used, mode FROM pair0 WHERE mode <> 'SPECIAL REMARK MATCH'""")


def special_band_candidates(spark, sf_dir):
    return lookup.special_pairs(*reconciled(spark, sf_dir).sides).select(
        F.col("l_data").alias("src"), F.col("l_row").alias("row"), "r_row", *_lookup_texts()
    )


SPECIAL_BAND_CANDIDATES = sql("""
SELECT src, row, rrow AS r_row, date_used, mode FROM pair0 WHERE mode = 'SPECIAL REMARK MATCH'""")


def candidate_evaluation(spark, sf_dir):
    r = reconciled(spark, sf_dir)
    return ev.evaluate(lookup.candidate_pairs(*r.sides), r.rules).select(
        F.col("l_data").alias("src"), F.col("l_row").alias("row"), "r_row", "date_used", "mode", "invalid_status",
        "register_mismatch", "date_mismatch", "time_difference", "invalid_reason", "validation_result",
    )


CANDIDATE_EVALUATION = sql("""
SELECT src, row, rrow AS r_row, date_used, mode, invalid AS invalid_status, regmis AS register_mismatch,
       datemis AS date_mismatch, diff AS time_difference, bad AS invalid_reason, vres AS validation_result FROM eval""")


def _choice(best: DataFrame) -> DataFrame:
    return best.select(
        F.col("l_data").alias("src"), F.col("l_row").alias("row"), F.col("_best.r_row").alias("r_row"),
        F.col("_best.mode").alias("mode"), F.col("_best.date_used").alias("date_used"),
        F.col("_best.time_difference").alias("time_difference"),
    )


def best_per_pair(spark, sf_dir):
    candidates = reconciled(spark, sf_dir).candidates
    return _choice(candidates.select("l_data", "l_row", ev.evaluation().alias("_best")))


BEST_PER_PAIR = sql("SELECT src, row, rrow AS r_row, mode, date_used, diff AS time_difference FROM one")


def best_candidate(spark, sf_dir):
    return _choice(reconciled(spark, sf_dir).best)


def best_candidate_dense(spark, sf_dir):
    """The same choice where one flight holds nearly all movements."""
    return _choice(_one_flight(spark.sparkContext.applicationId, sf_dir).best)


BEST_CANDIDATE = sql("SELECT src, row, rrow AS r_row, mode, date_used, diff AS time_difference FROM sel")
BEST_CANDIDATE_DENSE = sql(
    "SELECT src, row, rrow AS r_row, mode, date_used, diff AS time_difference FROM sel", events=movements.SQL_ONE_FLIGHT)

OUTCOME = dict(
    **ID, **ROUTE, register="AC REGISTER", moved_on="ACTUAL MOVEMENT DATE", atd_text="ATD", ata_text="ATA",
    status="STATUS", reason="MATCH_REASON", validasi="VALIDASI", stream_status="STREAM STATUS FLIGHT",
    stream_remark="STREAM REMARK", special="STREAM SPECIAL REMARK FLAG", dat_moved="DAT MOVEMENT DATETIME",
    stream_moved="STREAM MOVEMENT DATETIME", minutes="TIME DIFFERENCE MINUTES", result="STREAM VALIDATION RESULT",
    date_used="STREAM MATCH DATE USED", mode="STREAM MATCH MODE", route_ignored="ROUTE MATCH IGNORED",
    keyword="SPECIAL REMARK KEYWORD FOUND", recovered="DAT_RECOVERY_USED", instance="FLIGHT_INSTANCE_KEY",
    bucket="MOVEMENT_TIME_BUCKET", stream_row="STREAM SOURCE ROW",
)
OUTCOME_SQL = """
SELECT src, row, dof, coalesce(flight, '') AS flight, adep, ades, move, coalesce(register, '') AS register,
       coalesce(strftime(moved, '%Y-%m-%d'), '') AS moved_on, coalesce(atd_text, '') AS atd_text,
       coalesce(ata_text, '') AS ata_text, outcome AS status, why AS reason, validasi,
       coalesce(rstatus, '') AS stream_status, coalesce(remark, '') AS stream_remark, coalesce(special, false) AS special,
       coalesce(strftime(moved, '%Y-%m-%d %H:%M'), '') AS dat_moved,
       coalesce(strftime(rmoved, '%Y-%m-%d %H:%M'), '') AS stream_moved, round_even(diff, 1) AS minutes,
       coalesce(vres, 'STREAM NOT FOUND') AS result, coalesce(date_used, '') AS date_used,
       coalesce(mode, 'NO STREAM MATCH') AS mode, coalesce(special, false) AS route_ignored,
       coalesce(keyword, '') AS keyword, recovered, ikey AS instance, ibucket AS bucket, rrow AS stream_row
FROM decided"""


def classify_outcomes(spark, sf_dir):
    return reconciled(spark, sf_dir).records.select(*_names(**OUTCOME))


def ingest_outcomes(spark, sf_dir):
    """From landed CSV files to outcomes: the three extracts written as text and scanned again."""
    events = movements.base(spark, sf_dir)
    extracts = (
        movements.raw_records(events, True), movements.raw_records(events, False), movements.raw_billing(events),
    )
    scanned = []
    for extract in extracts:
        path = scratch(spark, "landed")
        write_csv(extract, path)
        scanned.append(read_source_csv(spark, path, row_numbers=None))
    return reconcile_dat_vs_stream(*scanned, row_col="row").records.select(*_names(**OUTCOME))


def matched(spark, sf_dir):
    return reconciled(spark, sf_dir).matched.select(*_names(**OUTCOME))


def need_review(spark, sf_dir):
    return reconciled(spark, sf_dir).need_review.select(*_names(**OUTCOME))


def missing(spark, sf_dir):
    return reconciled(spark, sf_dir).missing.select(*_names(**OUTCOME))


def missing_billing(spark, sf_dir):
    r = reconciled(spark, sf_dir)
    return r.missing_billing.unionByName(r.missing_non_billable).select(*_names(**ID, reason="MATCH_REASON"))


def validasi(spark, sf_dir):
    return reconciled(spark, sf_dir).validasi.select(*_names(**OUTCOME))


def empty_movement(spark, sf_dir):
    return outputs.without_movement_time(reconciled(spark, sf_dir).missing).select(
        *_names(**ID, reason="MATCH_REASON", mode="STREAM MATCH MODE")
    )


def extra_rows(spark, sf_dir):
    return reconciled(spark, sf_dir).extra.select(*_names(
        row="SOURCE ROW", **ROUTE, status="STATUS", reason="MATCH_REASON", match_key="STREAM MATCH KEY",
        moved="STREAM MOVEMENT DATETIME", keyword="SPECIAL REMARK KEYWORD FOUND",
    ))


EXTRA_SQL = """
SELECT row, dof, flight, adep, ades, move, 'EXTRA IN STREAM' AS status, 'DAT NOT FOUND' AS reason,
       dof || ' | ' || flight || ' | ' || adep || ' | ' || ades || ' | ' || move AS match_key,
       coalesce(strftime(moved, '%Y-%m-%d %H:%M'), '') AS moved, coalesce(keyword, '') AS keyword FROM extra"""


def not_selected(spark, sf_dir):
    return reconciled(spark, sf_dir).not_selected.select(*_names(
        **ID, status="STATUS", reason="MATCH_REASON", validasi="VALIDASI", stream_row="STREAM SOURCE ROW",
        result="STREAM VALIDATION RESULT", mode="STREAM MATCH MODE",
    ))


NOT_SELECTED_SQL = """
SELECT p.src, p.row, 'STREAM CANDIDATE NOT SELECTED' AS status, 'LOWER PRIORITY STREAM CANDIDATE' AS reason, d.validasi,
       p.rrow AS stream_row, 'NOT SELECTED / ' || p.vres AS result, p.mode
FROM placed p JOIN decided d ON d.src = p.src AND d.row = p.row WHERE p.place > 1"""


def audit_counts(spark, sf_dir):
    """What the audit lists, as numbers: candidates of every kind for each record, without the pairs."""
    r = reconciled(spark, sf_dir)
    return r.audit_counts.withColumnsRenamed({"l_data": "src", "l_row": "row"})


_PLAIN = "NOT o.special AND NOT o.invalid AND o.rmoved IS NOT NULL"
AUDIT_COUNTS_SQL = f"""
SELECT l.src, l.row, count(o.rrow) AS candidates, count(o.rrow) FILTER (WHERE o.special) AS special,
       count(o.rrow) FILTER (WHERE NOT o.special AND o.invalid) AS invalid_status,
       count(o.rrow) FILTER (WHERE NOT o.special AND NOT o.invalid AND o.rmoved IS NULL) AS no_time,
       count(o.rrow) FILTER (WHERE {_PLAIN} AND o.datemis) AS wrong_date,
       count(o.rrow) FILTER (WHERE {_PLAIN} AND NOT o.datemis AND o.diff <= 30 AND NOT o.regmis) AS matched,
       count(o.rrow) FILTER (WHERE {_PLAIN} AND NOT o.datemis AND o.diff <= 30 AND o.regmis) AS register_mismatch,
       count(o.rrow) FILTER (WHERE {_PLAIN} AND NOT o.datemis AND o.diff > 30 AND o.diff <= 120) AS late,
       count(o.rrow) FILTER (WHERE {_PLAIN} AND NOT o.datemis AND o.diff > 120) AS far
FROM l LEFT JOIN one o ON o.src = l.src AND o.row = l.row GROUP BY l.src, l.row"""


def audit_union(spark, sf_dir):
    return reconciled(spark, sf_dir).audit_detail.select(*_names(
        **ID, status="STATUS", reason="MATCH_REASON", validasi="VALIDASI", mode="STREAM MATCH MODE",
        category="BILLING CATEGORY", stream_row="STREAM SOURCE ROW", score="COMPLETENESS_SCORE",
        selected="SELECTED DAT RECORD", dat_moved="DAT MOVEMENT DATETIME",
    ))


AUDIT_SQL = """
SELECT src, row, outcome AS status, why AS reason, validasi, coalesce(mode, 'NO STREAM MATCH') AS mode,
       'BILLING REVIEW' AS category, rrow AS stream_row, NULL AS score, true AS selected,
       coalesce(strftime(moved, '%Y-%m-%d %H:%M'), '') AS dat_moved FROM decided
UNION ALL SELECT p.src, p.row, 'STREAM CANDIDATE NOT SELECTED', 'LOWER PRIORITY STREAM CANDIDATE', d.validasi, p.mode,
       'BILLING REVIEW', p.rrow, NULL, true, strftime(d.moved, '%Y-%m-%d %H:%M')
  FROM placed p JOIN decided d ON d.src = p.src AND d.row = p.row WHERE p.place > 1
UNION ALL SELECT 'STREAM', row, 'EXTRA IN STREAM', 'DAT NOT FOUND', '', 'NO STREAM MATCH', '', NULL, NULL, false, '' FROM extra
UNION ALL SELECT src, row, 'DUPLICATE DAT', reason, '', 'NO STREAM MATCH', 'BILLING REVIEW', NULL, score, false, ''
  FROM resolved WHERE NOT selected"""


def reconcile_summary(spark, sf_dir):
    return reconciled(spark, sf_dir).summary


SUMMARY_SQL = """
SELECT (SELECT count(*) FROM kept WHERE src = 'DAT DEP') AS total_dat_dep,
       (SELECT count(*) FROM kept WHERE src = 'DAT ARR') AS total_dat_arr,
       (SELECT count(*) FROM kept) AS total_dat_combined,
       (SELECT count(*) FROM decided) AS total_dat_unique,
       (SELECT count(*) FROM bil) AS total_stream,
       (SELECT count(*) FROM decided WHERE outcome = 'MATCHED') AS matched,
       (SELECT count(*) FROM decided WHERE outcome = 'MISSING IN STREAM') AS missing_in_stream,
       (SELECT count(*) FROM decided WHERE outcome = 'MISSING IN STREAM') AS missing_billing_review,
       CAST(0 AS BIGINT) AS missing_non_billable_review,
       (SELECT count(*) FROM decided WHERE outcome = 'NEED REVIEW') AS need_review,
       (SELECT count(*) FROM decided WHERE validasi = 'ADA DI STREAM') AS total_ada_di_stream,
       (SELECT count(*) FROM decided WHERE validasi = 'ADA DI DAT TIDAK ADA DI STREAM') AS total_validasi,
       (SELECT count(*) FROM decided WHERE validasi = 'PERLU REVIEW STREAM') AS total_perlu_review_stream,
       (SELECT count(*) FROM decided WHERE validasi = 'PERLU REVIEW DAT') AS total_perlu_review_dat,
       (SELECT count(*) FROM extra) AS extra_in_stream,
       (SELECT count(*) FROM resolved WHERE NOT selected) AS duplicate_dat,
       (SELECT count(*) FROM stdm WHERE excluded) AS excluded_dat_non_billable,
       (SELECT count(*) FROM bil1 WHERE excluded) AS excluded_stream_non_billable,
       (SELECT count(*) FROM decided WHERE NOT complete) AS incomplete_dat_keys,
       CAST(0 AS BIGINT) AS incomplete_stream_keys,
       (SELECT count(*) FILTER (WHERE outcome = 'MATCHED') / CAST(count(*) AS DOUBLE) * 100.0 FROM decided) AS accuracy_percentage"""


def summary_table(spark, sf_dir):
    return reconciled(spark, sf_dir).summary_table


_LINES = (
    ("Total DAT DEP", "total_dat_dep"), ("Total DAT ARR", "total_dat_arr"), ("Total DAT Combined", "total_dat_combined"),
    ("Total DAT Unique", "total_dat_unique"), ("Total STREAM", "total_stream"), ("Matched", "matched"),
    ("Missing in Stream", "missing_in_stream"), ("Missing Billing Review", "missing_billing_review"),
    ("Need Review", "need_review"), ("Total Ada di STREAM", "total_ada_di_stream"), ("Total Validasi", "total_validasi"),
    ("Total Perlu Review STREAM", "total_perlu_review_stream"), ("Total Perlu Review DAT", "total_perlu_review_dat"),
    ("Extra in Stream", "extra_in_stream"), ("Duplicate DAT", "duplicate_dat"),
    ("Excluded DAT Non-Billable", "excluded_dat_non_billable"),
    ("Excluded STREAM Non-Billable", "excluded_stream_non_billable"),
    ("Accuracy Percentage", "accuracy_percentage / 100.0"),
)
SUMMARY_TABLE_SQL = "\nUNION ALL ".join(
    f"SELECT {i} AS \"LINE\", '{label}' AS \"METRIC\", CAST({value} AS DOUBLE) AS \"VALUE\" FROM s"
    for i, (label, value) in enumerate(_LINES, start=1)
)


def reason_hist(spark, sf_dir):
    return reason_histogram(reconciled(spark, sf_dir).missing)


REASON_SQL = "\nUNION ALL ".join(
    f"SELECT '{r}' AS reason, count(*) AS rows FROM decided WHERE outcome = 'MISSING IN STREAM' AND contains(why, '{r}') HAVING count(*) > 0"
    for r in ("STREAM NOT FOUND", "STREAM STATUS OTHER", "STREAM INVALID ATA DATE", "STREAM INVALID ATD DATE",
              "STREAM TIME MISMATCH")
)


def filter_results(spark, sf_dir):
    kept = filters.filter_results(
        reconciled(spark, sf_dir).missing, "2024-01-05", "2024-01-20", " u1", ["CLICK", "ERROR"], ["H0", "H1"], ["A", "D"],
    )
    return kept.select(*_names(**ID, **ROUTE))


FILTER_SQL = """
SELECT src, row, dof, coalesce(flight, '') AS flight, adep, ades, move FROM decided
WHERE outcome = 'MISSING IN STREAM' AND fd BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND flight ILIKE '%u1%'
  AND adep IN ('CLICK', 'ERROR')"""


def filter_options(spark, sf_dir):
    return filters.filter_options(reconciled(spark, sf_dir).missing, "FLIGHT NUMBER")


def date_bounds(spark, sf_dir):
    bounds = filters.date_bounds(reconciled(spark, sf_dir).missing)
    return bounds.select(*[F.col(c).cast("string").alias(c) for c in bounds.columns])


def report_missing(spark, sf_dir):
    return report_tables(reconciled(spark, sf_dir))["Missing in Stream"].select(*_names(
        dof="DATE OF FLIGHT", flight="FLIGHT NUMBER", adep="AERODROME", ades="TO FROM", move="D/A/L/O",
        validasi="VALIDASI", reason="MATCH_REASON", source_row="DAT_RECOVERY_SOURCE_ROW", used="USED_FOR_RECOVERY",
        mode="STREAM MATCH MODE",
    ))


REPORT_MISSING_SQL = """
SELECT dof, coalesce(flight, '') AS flight, adep, ades, move, validasi, why AS reason, source_row, used,
       coalesce(mode, 'NO STREAM MATCH') AS mode FROM decided WHERE outcome = 'MISSING IN STREAM'"""


def display_columns(spark, sf_dir):
    shown = outputs.display_columns(reconciled(spark, sf_dir).need_review, ["STATUS", "MATCH_REASON"], audit=True)
    return shown.select(*_names(**ID, **ROUTE, reason="MATCH_REASON", category="BILLING CATEGORY", key="STREAM MATCH KEY"))


def _placed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written table with their file and their place in it."""
    return spark.read.parquet(path).select(
        *_names(**ID, **ROUTE), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def ordered_records(spark, sf_dir):
    """Matched records written in report order: the place of each row within its day, as the files have it."""
    path = scratch(spark, "ordered")
    outputs.ordered_records(reconciled(spark, sf_dir).matched).write.parquet(path)
    within = Window.partitionBy("dof").orderBy("file", "at")
    return _placed_rows(spark, path).withColumn("place", F.row_number().over(within) - 1).select(
        "src", "row", "dof", F.col("place").cast("bigint").alias("place"))


ORDERED_SQL = """
SELECT src, row, dof, row_number() OVER (PARTITION BY dof ORDER BY flight, move, src, row) - 1 AS place
FROM decided WHERE outcome = 'MATCHED'"""


def report_sink(spark, sf_dir):
    """The nine report datasets, written in report order and read back."""
    folder = scratch(spark, "report")
    paths = write_report(reconciled(spark, sf_dir), folder)
    read = [(path.rsplit("/", 1)[1], spark.read.parquet(path)) for path in paths]
    counts = [
        df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"),
               (F.max("DATE OF FLIGHT") if name != "Summary" else F.lit(None).cast("date")).cast("string").alias("last_day"))
        for name, df in read
    ]
    return reduce(DataFrame.unionByName, counts)


REPORT_SINK_SQL = """
SELECT 'Summary' AS dataset, 18 AS rows, NULL AS last_day
UNION ALL SELECT 'Validasi', count(*), CAST(max(fd) AS VARCHAR) FROM decided WHERE validasi = 'ADA DI DAT TIDAK ADA DI STREAM'
UNION ALL SELECT 'Missing in Stream', count(*), CAST(max(fd) AS VARCHAR) FROM decided WHERE outcome = 'MISSING IN STREAM'
UNION ALL SELECT 'Matched', count(*), CAST(max(fd) AS VARCHAR) FROM decided WHERE outcome = 'MATCHED'
UNION ALL SELECT 'Need Review', count(*), CAST(max(fd) AS VARCHAR) FROM decided WHERE outcome = 'NEED REVIEW'
UNION ALL SELECT 'Extra in Stream', count(*), max(dof) FROM extra
UNION ALL SELECT 'Duplicate DAT', count(*), CAST(max(fd) AS VARCHAR) FROM resolved WHERE NOT selected
UNION ALL SELECT 'Audit Detail', (SELECT count(*) FROM decided) + (SELECT count(*) FROM placed WHERE place > 1)
    + (SELECT count(*) FROM extra) + (SELECT count(*) FROM resolved WHERE NOT selected),
    greatest((SELECT max(dof) FROM extra), (SELECT CAST(max(fd) AS VARCHAR) FROM resolved))
UNION ALL SELECT 'Excluded Non-Billable', (SELECT count(*) FROM stdm WHERE excluded) + (SELECT count(*) FROM bil1 WHERE excluded),
    greatest((SELECT CAST(max(fd) AS VARCHAR) FROM stdm WHERE excluded), (SELECT max(dof) FROM bil1 WHERE excluded))"""


REPORT_ROWS_OF = ("Matched", "Need Review", "Extra in Stream", "Duplicate DAT")


def report_rows(spark, sf_dir):
    """Rows of the written report: which record stands at which place of its day."""
    folder = scratch(spark, "report")
    paths = {path.rsplit("/", 1)[1]: path for path in write_report(reconciled(spark, sf_dir), folder, sheets=REPORT_ROWS_OF)}
    within = Window.partitionBy("dof").orderBy("file", "at")
    parts = [
        _placed_rows(spark, paths[name]).select(
            F.lit(name).alias("dataset"), "src", "row", "flight", (F.row_number().over(within) - 1).cast("bigint").alias("place"))
        for name in REPORT_ROWS_OF
    ]
    return reduce(DataFrame.unionByName, parts)


_PLACE = "row_number() OVER (PARTITION BY dof ORDER BY coalesce(flight, ''), move, {side}row) - 1 AS place"
REPORT_ROWS_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS dataset, {src} AS src, row, coalesce(flight, '') AS flight, {_PLACE.format(side=side)} FROM {rows}"
    for name, src, side, rows in (
        ("Matched", "src", "src, ", "decided WHERE outcome = 'MATCHED'"), ("Need Review", "src", "src, ", "decided WHERE outcome = 'NEED REVIEW'"),
        ("Extra in Stream", "'STREAM'", "", "extra"), ("Duplicate DAT", "src", "src, ", "resolved WHERE NOT selected")))


def ordered_excluded(spark, sf_dir):
    """Excluded rows written in their own order: the place of each within its side and day, as the files have it."""
    folder = scratch(spark, "excluded")
    path, = write_report(reconciled(spark, sf_dir), folder, sheets=["Excluded Non-Billable"])
    within = Window.partitionBy("src", "dof").orderBy("file", "at")
    return _placed_rows(spark, path).select(
        "src", "row", "flight", (F.row_number().over(within) - 1).cast("bigint").alias("place"))


_EXCLUDED_PLACE = "row_number() OVER (PARTITION BY dof ORDER BY flight, row) - 1 AS place"
ORDERED_EXCLUDED = sql("\nUNION ALL ".join(
    f"SELECT {src} AS src, row, flight, {place} FROM {rows} WHERE excluded" for src, place, rows in (
        ("src", _EXCLUDED_PLACE.replace("BY dof", "BY src, dof", 1), "stdm"), ("'STREAM'", _EXCLUDED_PLACE, "bil1"))), 3)


REPORT_CONTENTS_OF = ("Summary", "Validasi", "Missing in Stream", "Audit Detail", "Excluded Non-Billable")


def report_contents(spark, sf_dir):
    """What the files of the other datasets say, and whether their rows are as many as the manifest has."""
    folder = scratch(spark, "report")
    paths = write_report(reconciled(spark, sf_dir), folder, sheets=REPORT_CONTENTS_OF)
    counted = spark.read.parquet(f"{folder}/Manifest").select(F.col("dataset").alias("_dataset"), F.col("rows").alias("_rows"))
    texts = {
        "Summary": ("METRIC", "VALUE"),
        "Validasi": ("FLIGHT NUMBER", "AERODROME", "TO FROM", "D/A/L/O", "VALIDASI", "MATCH_REASON", "STREAM MATCH MODE"),
        "Missing in Stream": ("FLIGHT NUMBER", "AERODROME", "TO FROM", "D/A/L/O", "VALIDASI", "STATUS", "MATCH_REASON", "DAT MOVEMENT DATETIME"),
        "Audit Detail": ("SOURCE DATA", "SOURCE ROW", "STATUS", "MATCH_REASON", "STREAM SOURCE ROW", "STREAM VALIDATION RESULT"),
        "Excluded Non-Billable": ("SOURCE DATA", "SOURCE ROW", "FLIGHT NUMBER", "STATUS", "MATCH_REASON"),
    }
    parts = []
    for path in paths:
        name = path.rsplit("/", 1)[1]
        text = F.concat_ws(" | ", *[F.coalesce(field(c).cast("string"), F.lit("")) for c in texts[name]])
        parts.append(spark.read.parquet(path).groupBy(F.lit(name).alias("dataset"), text.alias("content")).agg(F.count("*").alias("copies")))
    every = reduce(DataFrame.unionByName, parts)
    sums = every.groupBy(F.col("dataset").alias("_of")).agg(F.sum("copies").alias("_sum"))
    checked = counted.join(sums, F.col("_dataset") == F.col("_of")).select("_dataset", (F.col("_rows") == F.col("_sum")).alias("as_in_manifest"))
    return every.join(checked, F.col("dataset") == F.col("_dataset")).drop("_dataset")


def _contents(dataset: str, rows: str, *texts: str) -> str:
    content = " || ' | ' || ".join(f"coalesce(CAST({t} AS VARCHAR), '')" for t in texts)
    return f"SELECT '{dataset}' AS dataset, {content} AS content, count(*) AS copies, true AS as_in_manifest FROM {rows} GROUP BY ALL"


def _report_contents_sql() -> str:
    excluded = "'FLIGHT NUMBER MATCHES INTERNAL/NON-BILLABLE RULE'"
    moved = "strftime(moved, '%Y-%m-%d %H:%M')"
    mode = "coalesce(mode, 'NO STREAM MATCH')"
    return "\nUNION ALL ".join([
        _contents("Summary", f"({SUMMARY_TABLE_SQL})", '"METRIC"', '"VALUE"'),
        _contents("Validasi", "decided WHERE validasi = 'ADA DI DAT TIDAK ADA DI STREAM'", "flight", "adep", "ades", "move", "validasi", "why", mode),
        _contents("Missing in Stream", "decided WHERE outcome = 'MISSING IN STREAM'", "flight", "adep", "ades", "move", "validasi", "outcome", "why", moved),
        _contents("Audit Detail", "decided", "src", "row", "outcome", "why", "rrow", "coalesce(vres, 'STREAM NOT FOUND')"),
        _contents("Audit Detail", "placed p JOIN decided d ON d.src = p.src AND d.row = p.row WHERE p.place > 1", "p.src", "p.row",
                  "'STREAM CANDIDATE NOT SELECTED'", "'LOWER PRIORITY STREAM CANDIDATE'", "p.rrow", "'NOT SELECTED / ' || p.vres"),
        _contents("Audit Detail", "extra", "'STREAM'", "row", "'EXTRA IN STREAM'", "'DAT NOT FOUND'", "''", "'DAT NOT FOUND'"),
        _contents("Audit Detail", "resolved WHERE NOT selected", "src", "row", "'DUPLICATE DAT'", "reason", "''", "'NOT APPLICABLE'"),
        _contents("Excluded Non-Billable", "stdm WHERE excluded", "src", "row", "flight", "'EXCLUDED NON-BILLABLE'", excluded),
        _contents("Excluded Non-Billable", "bil1 WHERE excluded", "'STREAM'", "row", "flight", "'EXCLUDED NON-BILLABLE'", excluded),
    ])


def index_groups(spark, sf_dir):
    """Billing rows per lookup key."""
    _, others = reconciled(spark, sf_dir).sides
    return lookup.indexed(others).groupBy("by", "date", "flight", "adep", "ades", "move").agg(F.count("*").alias("n"))


INDEX_GROUPS = sql("""
SELECT x.by, x.date, b.flight, b.adep, b.ades, b.move, count(*) AS n FROM ridx x JOIN bil b ON b.row = x.row GROUP BY ALL""")


def looked_at(spark, sf_dir):
    return extra_ops.looked_at(*reconciled(spark, sf_dir).sides)


def _outcomes(condition: str) -> str:
    return sql(f"SELECT * FROM ({OUTCOME_SQL}) WHERE {condition}")


def _with_summary(select: str) -> str:
    return sql(f"SELECT * FROM (WITH s AS ({SUMMARY_SQL}) {select})")


QUERIES = {
    "standardize_records": (standardize_records, STANDARDIZE_RECORDS),
    "standardize_billing": (standardize_billing, STANDARDIZE_BILLING),
    "exclude_split": (exclude_split, EXCLUDE_SPLIT),
    "union_sides": (union_sides, UNION_SIDES),
    "recovery_order": (recovery_order, RECOVERY_ORDER),
    "recovery_pairs": (recovery_pairs, RECOVERY_PAIRS),
    "recovery_one_flight": (recovery_one_flight, RECOVERY_ONE_FLIGHT),
    "midnight_recovery": (midnight_recovery, MIDNIGHT_RECOVERY),
    "key_preparation": (key_preparation, KEY_PREPARATION),
    "slot_register": (slot_register, SLOT_REGISTER),
    "movement_instances": (movement_instances, MOVEMENT_INSTANCES),
    "attach_timeless": (attach_timeless, ATTACH_TIMELESS),
    "instance_key": (instance_key, INSTANCE_KEY),
    "completeness": (completeness, COMPLETENESS),
    "dedup_best": (dedup_best, DEDUP_BEST),
    "dedup_selected": (dedup_selected, DEDUP_SELECTED),
    "dedup_losers_reason": (dedup_losers_reason, DEDUP_LOSERS_REASON),
    "search_specs": (search_specs, SEARCH_SPECS),
    "multikey_candidates": (multikey_candidates, MULTIKEY_CANDIDATES),
    "special_band_candidates": (special_band_candidates, SPECIAL_BAND_CANDIDATES),
    "candidate_evaluation": (candidate_evaluation, CANDIDATE_EVALUATION),
    "best_per_pair": (best_per_pair, BEST_PER_PAIR),
    "best_candidate": (best_candidate, BEST_CANDIDATE),
    "best_candidate_dense": (best_candidate_dense, BEST_CANDIDATE_DENSE),
    "classify_outcomes": (classify_outcomes, sql(OUTCOME_SQL)),
    "ingest_outcomes": (ingest_outcomes, sql(OUTCOME_SQL)),
    "matched": (matched, _outcomes("status = 'MATCHED'")),
    "need_review": (need_review, _outcomes("status = 'NEED REVIEW'")),
    "missing": (missing, _outcomes("status = 'MISSING IN STREAM'")),
    "missing_billing": (missing_billing, sql(
        "SELECT src, row, why AS reason FROM decided WHERE outcome = 'MISSING IN STREAM'")),
    "validasi": (validasi, _outcomes("validasi = 'ADA DI DAT TIDAK ADA DI STREAM'")),
    "empty_movement": (empty_movement, sql(
        "SELECT src, row, why AS reason, 'NO STREAM MATCH' AS mode FROM decided WHERE moved IS NULL")),
    "index_groups": (index_groups, INDEX_GROUPS),
    "looked_at": (looked_at, sql("SELECT DISTINCT rrow AS r_row FROM pair0")),
    "report_sink": (report_sink, sql(REPORT_SINK_SQL)),
    "report_rows": (report_rows, sql(REPORT_ROWS_SQL)),
    "ordered_excluded": (ordered_excluded, ORDERED_EXCLUDED),
    "report_contents": (report_contents, _with_summary(_report_contents_sql())),
    "extra_rows": (extra_rows, sql(EXTRA_SQL)),
    "not_selected": (not_selected, sql(NOT_SELECTED_SQL)),
    "audit_union": (audit_union, sql(AUDIT_SQL)),
    "audit_counts": (audit_counts, sql(AUDIT_COUNTS_SQL)),
    "reconcile_summary": (reconcile_summary, sql(SUMMARY_SQL)),
    "summary_table": (summary_table, _with_summary(SUMMARY_TABLE_SQL)),
    "reason_hist": (reason_hist, sql(REASON_SQL)),
    "filter_results": (filter_results, sql(FILTER_SQL)),
    "filter_options": (filter_options, sql(
        "SELECT DISTINCT flight AS value FROM decided WHERE outcome = 'MISSING IN STREAM' AND flight IS NOT NULL")),
    "date_bounds": (date_bounds, sql(
        "SELECT CAST(min(fd) AS VARCHAR) AS min_date, CAST(max(fd) AS VARCHAR) AS max_date FROM decided "
        "WHERE outcome = 'MISSING IN STREAM'")),
    "report_missing": (report_missing, sql(REPORT_MISSING_SQL)),
    "display_columns": (display_columns, sql(
        "SELECT src, row, dof, coalesce(flight, '') AS flight, adep, ades, move, why AS reason, "
        "'BILLING REVIEW' AS category, ikey AS key FROM decided WHERE outcome = 'NEED REVIEW'")),
    "ordered_records": (ordered_records, sql(ORDERED_SQL)),
}

__all__ = ["QUERIES", "forget", "reconciled"]
