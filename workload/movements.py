"""Movement extracts rendered from ``events``: three messy text tables.

Every event becomes one record (a departure or an arrival, by event type) and one
billing row, so both sides cover the whole table. Keys, times and remarks are altered
by the event id, which yields duplicates, missing times, midnight roll-overs, wrong
dates, other registers, special remarks, excluded flights and rows without partner.
The same tables, typed and without any parsing, are the common table expressions of
:data:`SQL`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.sources.rows import spread
from ledgerline.plans.reconcile import Reconciliation, reconcile_dat_vs_stream

DEPARTURE_EVENTS = ("click", "purchase", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, remainder: int = 0) -> Column:
    return F.col("id") % n == remainder


def _text(c: Column, start: int, length: int) -> Column:
    return F.substring(c.cast("string"), start, length)


def _compact(c: Column) -> Column:
    return F.concat(_text(c, 12, 2), _text(c, 15, 2))


def _shift(c: Column, minutes: Column) -> Column:
    zero = F.lit(0)
    return c + F.make_dt_interval(zero, zero, minutes, zero.cast("decimal(18,6)"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz")
    events = spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"), second.alias("t"), F.col("user_id").alias("u"),
        F.col("event_type").alias("et"), F.regexp_extract("props", r"(\d+)", 1).alias("k"),
    )
    day = F.col("t").cast("date")
    rolled = F.when((F.hour("t") == 23) & _every(2), F.date_add(day, 1)).otherwise(day)
    flight = F.when(F.col("u") % 29 == 0, "TEST").otherwise("U")
    return events.select(
        "*", F.concat(flight, (F.col("u") % 20).cast("string")).alias("flight"),
        F.concat(F.lit("H"), (F.col("u") % 2).cast("string")).alias("ades"), rolled.alias("fd0"),
        F.col("et").isin(*DEPARTURE_EVENTS).alias("departs"),
        F.when(_every(5, 0) | _every(5, 1), "").otherwise(
            F.concat(F.lit("PK-"), F.substring(F.lit("ABC"), (F.col("u") % 3 + 1).cast("int"), F.lit(1)))
        ).alias("register"),
        (F.col("id") + 2).alias("row"),
    )


def raw_records(events: DataFrame, departures: bool) -> DataFrame:
    """One of the two record extracts, in the shape their exporter would write it."""
    t, day = F.col("t"), F.col("fd0").cast("string")
    rendered_day = (
        F.when(_every(53), "unknown  day")
        .when(_every(4, 0), F.concat(F.substring(day, 3, 2), F.substring(day, 6, 2), F.substring(day, 9, 2)))
        .when(_every(4, 1), F.concat(F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4)))
        .when(_every(4, 2), F.concat_ws("/", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4)))
        .otherwise(day)
    )
    moved = (
        F.when(_every(7), "")
        .when(_every(3, 0), t.cast("string")).when(_every(3, 1), _text(t, 12, 5)).otherwise(_compact(t))
    )
    left = F.when(_every(5), _text(_shift(t, F.lit(-120)), 12, 5)).otherwise("-")
    gate = F.when(_every(4), "-").otherwise(F.col("k"))
    flight = F.when(_every(41), "").otherwise(F.concat(F.lit(" '"), F.lower("flight"), F.lit(" '")))
    side = "departure" if departures else "arrival"
    return events.where(F.col("departs") if departures else ~F.col("departs")).select(
        "row",
        flight.alias("callsign"), F.col("et").alias("adep"), F.lower("ades").alias("ades"),
        rendered_day.alias("eobd"),
        F.when(_every(6), "").otherwise(_compact(_shift(t, F.lit(-30)))).alias("eobt"),
        (moved if departures else left).alias("atd"), (F.lit("") if departures else moved).alias("ata"),
        F.col("register"), gate.alias(f"{side}Gate"),
        F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias(f"{side}Runway"),
        F.when(_every(9), "").otherwise(_shift(t, F.lit(60)).cast("string")).alias("timeStamp"),
        F.when(_every(8), "").otherwise(F.concat(F.lit("MSG "), F.col("k"))).alias("messageNum"),
    )


def raw_billing(events: DataFrame) -> DataFrame:
    """The billing table, in the shape its exporter would write it."""
    late = (F.col("id") % 5 * 20 + F.when(_every(19), 1440).otherwise(0)).cast("int")
    at = F.when(_every(23), "").otherwise(_text(_shift(F.col("t"), late), 1, 16))
    day = F.when(_every(11), F.date_add("fd0", 1)).otherwise(F.col("fd0")).cast("string")
    flight = F.when(_every(13, 5), F.regexp_replace("flight", "^U", "Z")).otherwise(F.col("flight"))
    return events.select(
        "row", day.alias("DATE OF FLIGHT"),
        F.regexp_replace(flight, r"(\d+)$", " $1").alias("FLIGHT NUMBER"),
        F.when(_every(17), "elsewhere").otherwise(F.col("et")).alias("AERODROME"),
        F.col("ades").alias("TO FROM"),
        F.when(_every(12, 3), "PKZ").otherwise(F.col("register")).alias("AC REGISTER"),
        F.when(_every(37), "L").when(F.col("departs"), "D").otherwise("A").alias("D/A/L/O"),
        F.when(F.col("departs") | _every(37), at).otherwise("").alias("ATD"),
        F.when(F.col("departs") & ~_every(37), "").otherwise(at).alias("ATA"),
        F.when(_every(15), "Other").otherwise("Reguler").alias("STATUS FLIGHT"),
        F.when(_every(17), "diverted due wx").when(_every(31), "return to base").otherwise("").alias("REMARK"),
        F.when(_every(43), "checked").otherwise("FALSE").alias("RTB/RTA"),
        F.col("t").cast("string").alias("TIMESTAMP"), F.col("k").alias("MESSAGE NUM"),
        F.lit("r1").alias("RWY"), F.col("k").alias("PARKING"),
    )


def reconcile_events(spark: SparkSession, sf_dir: str) -> Reconciliation:
    events = base(spark, sf_dir)
    return reconcile_dat_vs_stream(
        raw_records(events, True), raw_records(events, False), raw_billing(events), row_col="row"
    )


def on_one_flight(events: DataFrame) -> DataFrame:
    """The same events, nine of ten on one flight and all to one place."""
    flight = F.when(_every(10), F.col("flight")).otherwise("U7")
    return events.withColumns({"flight": flight, "ades": F.lit("H0")})


def reconcile_one_flight(spark: SparkSession, sf_dir: str) -> Reconciliation:
    events = on_one_flight(base(spark, sf_dir))
    return reconcile_dat_vs_stream(
        raw_records(events, True), raw_records(events, False), raw_billing(events), row_col="row"
    )


# Typed counterparts -----------------------------------------------------------------
SQL_EVENTS = """
ev AS (
  SELECT event_id AS id, date_trunc('second', ts) AS t, user_id AS u, event_type AS et,
         regexp_extract(props, '([0-9]+)', 1) AS k,
         CASE WHEN user_id % 29 = 0 THEN 'TEST' ELSE 'U' END || CAST(user_id % 20 AS VARCHAR) AS flight0,
         'H' || CAST(user_id % 2 AS VARCHAR) AS ades,
         CASE WHEN hour(ts) = 23 AND event_id % 2 = 0 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS fd0,
         event_type IN ('click', 'purchase', 'view') AS departs,
         CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE 'PK' || substr('ABC', CAST(user_id % 3 + 1 AS INTEGER), 1) END AS reg0
  FROM events),
"""

SQL_ONE_FLIGHT = SQL_EVENTS.replace("ev AS (", "spread AS (") + """
ev AS (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN flight0 ELSE 'U7' END AS flight0, 'H0' AS ades) FROM spread),
"""

SQL_RECORDS = """
rec0 AS (
  SELECT id + 2 AS row, CASE WHEN departs THEN 'DAT DEP' ELSE 'DAT ARR' END AS src,
         CASE WHEN departs THEN 'D' ELSE 'A' END AS move,
         CASE WHEN id % 41 = 0 THEN NULL ELSE flight0 END AS flight, upper(et) AS adep, ades,
         CASE WHEN id % 53 = 0 THEN NULL ELSE fd0 END AS fd,
         CASE WHEN id % 53 = 0 THEN 'UNKNOWN DAY' ELSE strftime(fd0, '%Y-%m-%d') END AS dof,
         reg0 AS register, id, t, departs,
         CASE WHEN id % 4 = 0 THEN NULL ELSE k END AS gate, 'R' || CAST(id % 2 AS VARCHAR) AS runway,
         CASE WHEN id % 9 = 0 THEN NULL ELSE t + INTERVAL 60 MINUTE END AS version,
         CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS message,
         date_trunc('minute', t) - date_trunc('day', t) AS tod,
         date_trunc('minute', t - INTERVAL 120 MINUTE) - date_trunc('day', t - INTERVAL 120 MINUTE) AS tod2,
         date_trunc('minute', t - INTERVAL 30 MINUTE) - date_trunc('day', t - INTERVAL 30 MINUTE) AS tod3
  FROM ev),
rec1 AS (
  SELECT *,
         CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(fd AS TIMESTAMP) + tod3 END AS eobt,
         CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN t ELSE CAST(fd AS TIMESTAMP) + tod END AS mt,
         CASE WHEN NOT departs AND id % 5 = 0 THEN CAST(fd AS TIMESTAMP) + tod2 END AS left_at
  FROM rec0),
std AS (
  SELECT src, row, id, move, flight, adep, ades, fd, dof, register, gate, runway, version, message, eobt,
         CASE WHEN departs THEN mt ELSE left_at END AS atd,
         CASE WHEN departs THEN NULL WHEN id % 3 <> 0 AND mt < left_at THEN mt + INTERVAL 1 DAY ELSE mt END AS ata,
         CASE WHEN departs THEN CASE WHEN id % 7 = 0 THEN NULL ELSE strftime(t, '%H:%M') END
              WHEN id % 5 = 0 THEN strftime(t - INTERVAL 120 MINUTE, '%H:%M') END AS atd_text,
         CASE WHEN departs OR id % 7 = 0 THEN NULL ELSE strftime(t, '%H:%M') END AS ata_text
  FROM rec1),
stdm AS (
  SELECT *, CASE WHEN move = 'D' THEN atd ELSE ata END AS moved, coalesce(flight, '') LIKE '%TEST%' AS excluded FROM std),
kept AS (SELECT * FROM stdm WHERE NOT excluded),
"""

SQL_BILLING = """
bil0 AS (
  SELECT id + 2 AS row, id,
         strftime(CASE WHEN id % 11 = 0 THEN fd0 + 1 ELSE fd0 END, '%Y-%m-%d') AS dof,
         CASE WHEN id % 13 = 5 AND flight0 LIKE 'U%' THEN 'Z' || substr(flight0, 2) ELSE flight0 END AS flight,
         CASE WHEN id % 17 = 0 THEN 'ELSEWHERE' ELSE upper(et) END AS adep, ades,
         CASE WHEN id % 12 = 3 THEN 'PKZ' ELSE reg0 END AS register,
         CASE WHEN id % 37 = 0 THEN 'L' WHEN departs THEN 'D' ELSE 'A' END AS move,
         CASE WHEN id % 23 = 0 THEN NULL ELSE date_trunc('minute',
              t + ((id % 5) * 20 + CASE WHEN id % 19 = 0 THEN 1440 ELSE 0 END) * INTERVAL 1 MINUTE) END AS stamp,
         CASE WHEN id % 15 = 0 THEN 'OTHER' ELSE 'REGULER' END AS status,
         CASE WHEN id % 17 = 0 THEN 'DIVERT' WHEN id % 31 = 0 THEN 'RETURN TO BASE' WHEN id % 43 = 0 THEN 'RTB' END AS keyword,
         CASE WHEN id % 17 = 0 THEN 'diverted due wx' WHEN id % 31 = 0 THEN 'return to base' WHEN id % 43 = 0 THEN 'Reguler' END AS remark,
         t AS version, CAST(k AS DOUBLE) AS message, departs, k
  FROM ev),
bil1 AS (
  SELECT *, CASE WHEN move = 'L' THEN NULL ELSE stamp END AS moved, keyword IS NOT NULL AS special,
         flight LIKE '%TEST%' AS excluded FROM bil0),
bil AS (SELECT * REPLACE (CASE WHEN remark = 'Reguler' THEN CASE WHEN id % 15 = 0 THEN 'Other' ELSE 'Reguler' END ELSE remark END AS remark)
        FROM bil1 WHERE NOT excluded),
"""

SQL_RECOVERY = """
tgt AS (
  SELECT src, row, dense_rank() OVER (ORDER BY flight, adep, ades, move, fd) AS gid, flight, adep, ades, move, fd, register,
         row_number() OVER (PARTITION BY flight, adep, ades, move, fd ORDER BY row) AS n,
         greatest(coalesce(eobt, CAST(fd AS TIMESTAMP) + INTERVAL 23 HOUR), CAST(fd AS TIMESTAMP) + INTERVAL 23 HOUR) AS start_at,
         coalesce(eobt, CAST(fd AS TIMESTAMP) + INTERVAL 23 HOUR) AS eo
  FROM kept WHERE moved IS NULL AND fd IS NOT NULL),
cand AS (
  SELECT t.gid, t.n, t.src AS tsrc, t.row AS trow, s.src AS ssrc, s.row AS srow,
         row_number() OVER (PARTITION BY t.src, t.row ORDER BY abs(epoch(s.moved - t.eo)),
           coalesce(s.version, TIMESTAMP '1970-01-01') DESC, s.message DESC NULLS LAST, s.row DESC) AS rk
  FROM tgt t JOIN kept s ON s.fd = t.fd + 1 AND coalesce(s.flight, '') = coalesce(t.flight, '') AND s.adep = t.adep
    AND s.ades = t.ades AND s.move = t.move
   WHERE s.moved IS NOT NULL AND s.moved >= CAST(t.fd AS TIMESTAMP) + INTERVAL 23 HOUR
     AND s.moved <= CAST(t.fd AS TIMESTAMP) + INTERVAL 30 HOUR AND s.moved >= t.eo
     AND (t.register IS NULL OR s.register = t.register)),
turn AS (
  SELECT t.gid, t.n, list({'rk': c.rk, 'srow': c.srow} ORDER BY c.rk) FILTER (WHERE c.srow IS NOT NULL) AS options
  FROM tgt t LEFT JOIN cand c ON c.tsrc = t.src AND c.trow = t.row GROUP BY t.gid, t.n),
greedy AS (
  SELECT gid, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS srow
  FROM (SELECT DISTINCT gid FROM tgt)
  UNION ALL
  SELECT gid, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
  FROM (SELECT g.gid, o.n, g.used,
               list_filter(coalesce(o.options, []), lambda x: NOT list_contains(g.used, x.srow))[1].srow AS pick
        FROM greedy g JOIN turn o ON o.gid = g.gid AND o.n = g.n + 1)),
pairs AS (
  SELECT t.src AS tsrc, t.row AS trow, g.srow FROM greedy g JOIN tgt t ON t.gid = g.gid AND t.n = g.n WHERE g.srow IS NOT NULL),
recd AS (
  SELECT k.src, k.row, k.id, k.move, k.flight, k.adep, k.ades, k.fd, k.dof, coalesce(k.register, s.register) AS register,
         coalesce(k.gate, s.gate) AS gate, coalesce(k.runway, s.runway) AS runway, k.version, k.message, k.eobt,
         coalesce(k.atd, s.atd) AS atd, coalesce(k.ata, s.ata) AS ata,
         coalesce(k.atd_text, s.atd_text) AS atd_text, coalesce(k.ata_text, s.ata_text) AS ata_text,
         CASE WHEN s.row IS NOT NULL THEN s.moved ELSE k.moved END AS moved,
         s.row IS NOT NULL AS recovered, s.dof AS source_date, s.row AS source_row, u.srow IS NOT NULL AS used
  FROM kept k LEFT JOIN pairs p ON p.tsrc = k.src AND p.trow = k.row
  LEFT JOIN kept s ON s.src = p.tsrc AND s.row = p.srow
  LEFT JOIN pairs u ON u.tsrc = k.src AND u.srow = k.row),
"""

SQL_INSTANCES = """
kk AS (
  SELECT *, coalesce(dof, '') || '|' || coalesce(flight, '') || '|' || adep || '|' || ades || '|' || move AS key5,
         CASE WHEN moved IS NULL THEN 'NO-TIME' ELSE lpad(CAST(hour(moved) // 6 * 6 AS VARCHAR), 2, '0') || '-'
              || lpad(CAST(hour(moved) // 6 * 6 + 5 AS VARCHAR), 2, '0') END AS bucket,
         strftime(moved, '%Y-%m-%d') AS moved_on
  FROM recd),
act AS (SELECT * FROM kk WHERE NOT used AND moved IS NOT NULL),
slot AS (
  SELECT key5, moved_on, bucket, CASE WHEN count(DISTINCT register) = 1 THEN max(register) END AS slot_register
  FROM act GROUP BY ALL),
actr AS (
  SELECT a.*, coalesce(a.register, s.slot_register, '') AS settled FROM act a JOIN slot s USING (key5, moved_on, bucket)),
inst AS (
  SELECT key5, moved_on, bucket, settled AS register, min(moved) AS first_at, min(row) AS first_row
  FROM actr GROUP BY key5, moved_on, bucket, settled),
open0 AS (SELECT src, row, key5, register, eobt FROM kk WHERE NOT used AND moved IS NULL),
opts AS (
  SELECT o.src, o.row, i.moved_on, i.bucket, i.register AS ireg, i.first_at, i.first_row, o.eobt,
         o.register IS NOT NULL AND i.register = o.register AS same,
         max(CAST(o.register IS NOT NULL AND i.register = o.register AS INTEGER)) OVER (PARTITION BY o.src, o.row) AS any_same
  FROM open0 o JOIN inst i USING (key5)),
elig AS (
  SELECT *, count(*) OVER (PARTITION BY src, row) AS n,
         row_number() OVER (PARTITION BY src, row ORDER BY abs(epoch(first_at - eobt)), first_row) AS rk
  FROM opts WHERE any_same = 0 OR same),
pickd AS (
  SELECT src, row, n, CASE WHEN n = 1 OR eobt IS NOT NULL THEN 1 ELSE 0 END AS ok, moved_on, bucket, ireg
  FROM elig WHERE rk = 1),
keyed AS (
  SELECT k.*,
    CASE WHEN k.used THEN coalesce(k.moved_on, '') WHEN k.moved IS NOT NULL THEN k.moved_on
         WHEN p.ok = 1 THEN p.moved_on ELSE coalesce(k.dof, '') END AS idate,
    CASE WHEN k.used OR k.moved IS NOT NULL THEN k.bucket WHEN p.ok = 1 THEN p.bucket
         WHEN k.eobt IS NULL THEN 'NO-TIME' ELSE lpad(CAST(hour(k.eobt) // 6 * 6 AS VARCHAR), 2, '0') || '-'
              || lpad(CAST(hour(k.eobt) // 6 * 6 + 5 AS VARCHAR), 2, '0') END AS ibucket,
    CASE WHEN k.used THEN coalesce(k.register, '') WHEN k.moved IS NOT NULL THEN coalesce(k.register, s.slot_register, '')
         WHEN p.ok = 1 AND p.ireg <> '' THEN p.ireg ELSE coalesce(k.register, '') END AS ireg,
    CASE WHEN k.used THEN ' | RECOVERY-SOURCE-' || k.src || '-' || k.row
         WHEN k.moved IS NULL AND p.ok = 0 THEN ' | AMBIGUOUS-' || k.src || '-' || k.row ELSE '' END AS suffix
  FROM kk k LEFT JOIN pickd p ON p.src = k.src AND p.row = k.row
  LEFT JOIN slot s ON s.key5 = k.key5 AND s.moved_on = k.moved_on AND s.bucket = k.bucket),
named AS (
  SELECT *, coalesce(dof, '') || ' | ' || coalesce(flight, '') || ' | ' || adep || ' | ' || ades || ' | ' || move || ' | '
            || ireg || ' | ' || idate || ' | ' || ibucket || suffix AS ikey,
         flight IS NOT NULL AS complete, moved IS NOT NULL AS has_time,
         (register IS NOT NULL)::INT + (atd_text IS NOT NULL)::INT + (ata_text IS NOT NULL)::INT
           + (gate IS NOT NULL)::INT + (runway IS NOT NULL)::INT AS score
  FROM keyed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ikey, used ORDER BY has_time DESC, score DESC,
              version DESC NULLS LAST, message DESC NULLS LAST, row DESC) AS place
  FROM named),
best AS (SELECT * FROM ranked WHERE place = 1 AND NOT used AND complete),
resolved AS (
  SELECT r.*, NOT r.used AND (r.place = 1 OR NOT r.complete) AS selected,
    CASE WHEN NOT r.used AND (r.place = 1 OR NOT r.complete) THEN NULL
         WHEN r.used THEN 'USED FOR ADJACENT DATE MIDNIGHT RECOVERY'
         WHEN b.has_time AND NOT r.has_time THEN 'MOVEMENT TIME EMPTY; BETTER RECORD SELECTED'
         WHEN r.score < b.score THEN 'LOWER COMPLETENESS SCORE'
         WHEN b.version IS NOT NULL AND (r.version IS NULL OR r.version < b.version) THEN 'OLDER TIMESTAMP'
         WHEN b.message IS NOT NULL AND (r.message IS NULL OR r.message < b.message) THEN 'LOWER MESSAGE NUMBER'
         ELSE 'LOWER PRIORITY DUPLICATE; STABLE TIE-BREAK' END AS reason
  FROM ranked r LEFT JOIN best b ON b.ikey = r.ikey),
"""

SQL_MATCH = """
l AS (SELECT * FROM resolved WHERE selected AND moved IS NOT NULL),
spec AS (
  SELECT src, row, 'MOVEMENT DATE' AS by, moved_on AS date, 'ACTUAL MOVEMENT DATE' AS date_used, 'ACTUAL MOVEMENT DATE MATCH' AS mode, 0 AS mrank FROM l
  UNION ALL SELECT src, row, 'DATE OF FLIGHT', dof, 'DATE OF FLIGHT', 'ORIGINAL DATE MATCH', 2 FROM l
  UNION ALL SELECT src, row, 'MOVEMENT DATE', strftime(CAST(moved AS DATE) - 1, '%Y-%m-%d'), 'ACTUAL MOVEMENT DATE -1 DAY', 'ACTUAL MOVEMENT DATE WINDOW MATCH', 3 FROM l
  UNION ALL SELECT src, row, 'MOVEMENT DATE', strftime(CAST(moved AS DATE) + 1, '%Y-%m-%d'), 'ACTUAL MOVEMENT DATE +1 DAY', 'ACTUAL MOVEMENT DATE WINDOW MATCH', 3 FROM l
  UNION ALL SELECT src, row, 'DATE OF FLIGHT', source_date, 'RECOVERED_DAT_DATE', 'RECOVERED DATE MATCH', 1 FROM l WHERE recovered),
ridx AS (
  SELECT row, 'MOVEMENT DATE' AS by, strftime(moved, '%Y-%m-%d') AS date FROM bil WHERE moved IS NOT NULL
  UNION ALL SELECT row, 'DATE OF FLIGHT', dof FROM bil),
pair0 AS (
  SELECT l.src, l.row, b.row AS rrow, s.date_used, s.mode, s.mrank
  FROM l JOIN spec s ON s.src = l.src AND s.row = l.row JOIN ridx x ON x.by = s.by AND x.date = s.date
  JOIN bil b ON b.row = x.row AND b.flight = l.flight AND b.adep = l.adep AND b.ades = l.ades AND b.move = l.move
  UNION ALL
  SELECT l.src, l.row, b.row, 'ACTUAL MOVEMENT DATE ±1 DAY', 'SPECIAL REMARK MATCH', 3
  FROM l JOIN bil b ON b.special AND b.flight = l.flight AND b.move = l.move
   WHERE b.moved IS NOT NULL AND coalesce(b.register = l.register, true) AND abs(epoch(b.moved - l.moved)) / 60.0 <= 30
     AND abs(CAST(b.moved AS DATE) - CAST(l.moved AS DATE)) <= 1),
eval0 AS (
  SELECT p.src, p.row, p.rrow, b.special, b.status, b.keyword, b.remark, b.moved AS rmoved, l.moved AS lmoved, l.move,
         CASE WHEN b.special THEN 'ACTUAL MOVEMENT DATE ±1 DAY' ELSE p.date_used END AS date_used,
         CASE WHEN b.special THEN 'SPECIAL REMARK MATCH' ELSE p.mode END AS mode,
         CASE WHEN b.special THEN 3 ELSE p.mrank END AS mrank,
         b.status = 'OTHER' AS invalid, coalesce(b.register <> l.register, false) AS regmis,
         abs(epoch(b.moved - l.moved)) / 60.0 AS diff,
         CASE WHEN b.moved IS NULL THEN false
              WHEN b.special THEN abs(CAST(b.moved AS DATE) - CAST(l.moved AS DATE)) > 1
              ELSE NOT (CAST(b.moved AS DATE) = CAST(l.moved AS DATE)
                        OR (l.recovered AND strftime(b.moved, '%Y-%m-%d') = l.source_date)) END AS datemis,
         b.version, b.message
  FROM pair0 p JOIN l ON l.src = p.src AND l.row = p.row JOIN bil b ON b.row = p.rrow),
eval1 AS (
  SELECT *, nullif(concat_ws(' / ', CASE WHEN invalid THEN 'STREAM STATUS ' || status END,
      CASE WHEN rmoved IS NULL THEN 'STREAM INVALID MOVEMENT TIME' END,
      CASE WHEN datemis THEN 'STREAM INVALID ' || CASE WHEN move = 'A' THEN 'ATA' ELSE 'ATD' END || ' DATE' END), '') AS bad
  FROM eval0),
eval AS (
  SELECT *, concat_ws(' / ', coalesce(bad, CASE mode
       WHEN 'SPECIAL REMARK MATCH' THEN 'STREAM SPECIAL REMARK FOUND - ROUTE IGNORED FOR VALIDATION'
       WHEN 'RECOVERED DATE MATCH' THEN 'VALID STREAM CANDIDATE BY RECOVERED DATE'
       WHEN 'ACTUAL MOVEMENT DATE MATCH' THEN 'VALID STREAM CANDIDATE BY ACTUAL MOVEMENT DATE'
       ELSE 'VALID STREAM CANDIDATE' END), CASE WHEN regmis THEN 'STREAM AC REGISTER MISMATCH' END) AS vres
  FROM eval1),
one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, row, rrow ORDER BY mrank) AS pl FROM eval) WHERE pl = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src, row ORDER BY invalid, rmoved IS NULL, datemis,
      (diff IS NULL OR diff > 30), special, regmis, diff NULLS LAST, mrank, version DESC NULLS LAST,
      message DESC NULLS LAST, rrow DESC) AS place
  FROM one),
sel AS (SELECT * FROM placed WHERE place = 1),
dec0 AS (
  SELECT r.*, s.rrow, s.special, s.status AS rstatus, s.keyword, s.remark, s.rmoved, s.diff, s.date_used, s.mode, s.vres, s.bad, s.regmis,
    CASE WHEN r.moved IS NULL OR s.rrow IS NULL THEN 'MISSING IN STREAM' WHEN s.special THEN 'NEED REVIEW'
         WHEN s.bad IS NOT NULL OR s.diff IS NULL THEN 'MISSING IN STREAM'
         WHEN s.diff <= 30 THEN CASE WHEN s.regmis THEN 'NEED REVIEW' ELSE 'MATCHED' END
         WHEN s.diff <= 120 THEN 'NEED REVIEW' ELSE 'MISSING IN STREAM' END AS outcome,
    CASE WHEN r.moved IS NULL THEN 'DAT MOVEMENT TIME EMPTY'
         WHEN s.rrow IS NULL THEN CASE WHEN r.recovered
            THEN 'STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW, ORIGINAL, AND RECOVERED DATE SEARCH'
            ELSE 'STREAM NOT FOUND AFTER ACTUAL MOVEMENT WINDOW AND ORIGINAL DATE SEARCH' END
         WHEN s.special THEN 'STREAM SPECIAL REMARK FOUND - ROUTE IGNORED FOR VALIDATION'
         WHEN s.bad IS NOT NULL THEN s.bad
         WHEN s.diff <= 30 THEN CASE WHEN s.regmis THEN 'STREAM AC REGISTER MISMATCH'
            WHEN s.mode = 'RECOVERED DATE MATCH' THEN 'VALID STREAM MATCH BY RECOVERED DATE'
            WHEN s.mode = 'ACTUAL MOVEMENT DATE MATCH' THEN 'VALID STREAM MATCH BY ACTUAL MOVEMENT DATE'
            ELSE 'VALID STREAM MATCH' END
         WHEN s.diff <= 120 THEN CASE WHEN s.regmis THEN 'STREAM TIME DIFFERENCE / STREAM AC REGISTER MISMATCH'
            ELSE 'STREAM TIME DIFFERENCE' END
         ELSE 'STREAM TIME MISMATCH' END AS why
  FROM resolved r LEFT JOIN sel s ON s.src = r.src AND s.row = r.row WHERE r.selected),
decided AS (
  SELECT *, CASE WHEN moved IS NULL THEN 'PERLU REVIEW DAT' WHEN rrow IS NULL THEN 'ADA DI DAT TIDAK ADA DI STREAM'
                 WHEN outcome = 'MATCHED' THEN 'ADA DI STREAM' ELSE 'PERLU REVIEW STREAM' END AS validasi
  FROM dec0),
extra AS (SELECT b.* FROM bil b WHERE NOT EXISTS (SELECT 1 FROM pair0 p WHERE p.rrow = b.row)),
"""

LAYERS = (SQL_EVENTS, SQL_RECORDS, SQL_BILLING, SQL_RECOVERY, SQL_INSTANCES, SQL_MATCH)


def sql(select: str, layers: int = len(LAYERS), events: str = SQL_EVENTS) -> str:
    """A full statement: the first layers of common table expressions, then the select."""
    recursive = "RECURSIVE " if layers > 3 else ""
    return f"WITH {recursive}{''.join([events, *LAYERS[1:layers]]).strip().rstrip(',')}\n{select}"
