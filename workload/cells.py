"""Cell-level queries: texts, codes, dates, times, remarks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions import dates, remarks, text, times, values
from workload.movements import table

# Word lists that occur in the given texts; the library's own lists are its defaults.
DOCUMENT_WORDS = ("THESEN", "HEINANCE", "EAUENEAU", "THE ", "UNG", "DES")
PART_TOKENS = ("RING", "WIDGET", "GEAR")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority",
        "o_totalprice", "o_custkey",
    )


def _part(day: Column, start: int, length: int) -> Column:
    return F.substring(day.cast("string"), start, length)


def clean_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = (
        F.when(F.col("p_size") % 7 == 0, " N/a ").when(F.col("p_size") % 7 == 1, "'-'")
        .when(F.col("p_size") % 7 == 2, F.concat(F.lit(" '"), F.col("p_name"), F.lit("' ")))
        .when(F.col("p_size") % 7 == 3, F.concat(F.lit("\"' "), F.col("p_name"), F.lit(" '\"")))
        .when(F.col("p_size") % 7 == 4, F.concat(F.lit("'\"'\""), F.col("p_name"), F.lit("\"'\"'")))
        .when(F.col("p_size") % 7 == 5, F.concat(F.lit("'"), F.col("p_name")))
        .otherwise(F.concat(F.lit("\t "), F.col("p_name"), F.lit("\n")))
    )
    rows = p.select("p_partkey", raw.alias("raw"))
    return rows.select(
        "p_partkey", text.clean_text(F.col("raw")).alias("cleaned"), text.is_present(F.col("raw")).alias("present"),
        text.clean_scalar_text(F.col("raw")).alias("scalar"), text.is_empty(F.col("raw")).alias("is_empty"),
    )


CLEAN_TEXT = """
SELECT p_partkey, CASE WHEN p_size % 7 < 2 THEN NULL WHEN p_size % 7 = 5 THEN '''' || p_name ELSE p_name END AS cleaned,
       p_size % 7 >= 2 AS present,
       CASE p_size % 7 WHEN 0 THEN 'N/a' WHEN 1 THEN '-' WHEN 5 THEN '''' || p_name ELSE p_name END AS scalar,
       false AS is_empty
FROM part"""


def norm_code(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wide = F.translate(F.col("p_brand"), "BrandX#0123456789", "ＢｒａｎｄＸ＃０１２３４５６７８９")
    return p.select(
        "p_partkey", text.normalize_code(F.col("p_name")).alias("name_code"),
        text.normalize_code(F.concat(F.lit("'"), F.col("p_brand"), F.lit("-é'"))).alias("brand_code"),
        text.normalize_code(wide).alias("wide_code"),
        text.normalize_code(F.concat(F.lit("ﬁ½ "), F.col("p_brand"), F.lit("e\u0301㎏"))).alias("folded_code"),
        text.normalize_code(F.col("p_retailprice")).alias("price_code"),
    )


NORM_CODE = """
SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g') AS name_code,
       regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g') AS brand_code,
       regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g') AS wide_code,
       'FI12' || regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g') || 'KG' AS folded_code,
       regexp_replace(CAST(p_retailprice AS VARCHAR), '[^A-Z0-9]+', '', 'g') AS price_code
FROM part"""


def display_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_quantity").agg(F.count("*").alias("n")).select(
        text.display_text(F.col("l_quantity"), "float").alias("shown"),
        text.prefer(text.clean_text(F.lit(" - ")), text.display_text(F.col("l_quantity") / 4, "float")).alias("preferred"),
        "n",
    )


DISPLAY_TEXT = """
SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS shown,
       CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN CAST(CAST(l_quantity AS BIGINT) // 4 AS VARCHAR)
            ELSE CAST(l_quantity / 4 AS VARCHAR) END AS preferred, count(*) AS n
FROM lineitem GROUP BY l_quantity"""


def msg_number(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", times.parse_message_number(F.col("props")).alias("from_text"),
        times.parse_message_number(F.concat(F.lit(" '"), F.col("value").cast("decimal(12,2)"), F.lit("'"))).alias("from_number"),
        times.parse_message_number(F.concat(F.lit("x-"), F.col("event_id"))).alias("negative"),
        times.parse_message_number(F.col("event_type")).alias("none_found"),
    )


MSG_NUMBER = """
SELECT event_id, CAST(regexp_extract(props, '-?[0-9]+(?:[.][0-9]+)?') AS DOUBLE) AS from_text,
       CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS from_number, CAST(-event_id AS DOUBLE) AS negative,
       CAST(NULL AS DOUBLE) AS none_found FROM events"""


def _rendered_dates(spark, sf_dir):
    day, year, month, dom = F.col("day"), _part(F.col("day"), 1, 4), _part(F.col("day"), 6, 2), _part(F.col("day"), 9, 2)
    name = F.date_format("day", "MMM")
    shapes = [
        F.concat(F.substring(year, 3, 2), month, dom), F.concat(dom, month, year), F.concat(year, month, dom),
        F.concat_ws("/", dom, month, year), F.concat(day.cast("string"), F.lit(" 08:30")),
        F.concat_ws("-", dom, month, F.substring(year, 3, 2)), F.concat_ws(" ", dom, name, year),
        F.concat_ws("/", year, month, dom), F.concat(F.lit("no  date "), F.col("id").cast("string")),
        F.concat_ws(".", dom, month, year),
    ]
    chain = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        chain = F.when(F.col("id") % len(shapes) == i, shape).otherwise(chain)
    return _orders(spark, sf_dir).select("id", "day", chain.alias("raw"))


def date_formats(spark, sf_dir):
    return _rendered_dates(spark, sf_dir).select("id", dates.normalize_date(F.col("raw")).alias("day"))


def date_formats_compare(spark, sf_dir):
    return _rendered_dates(spark, sf_dir).select("id", dates.normalize_compare_date(F.col("raw")).alias("day"))


DATE_FORMATS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 8 THEN 'NO DATE ' || o_orderkey
                              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""

# Eight digits have one reading here: with 19.. or 20.. in front they are year first or nothing.
DATE_FORMATS_COMPARE = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 8 THEN 'NO DATE ' || o_orderkey
         WHEN o_orderkey % 10 = 1 AND day(o_orderdate) IN (19, 20) THEN strftime(o_orderdate, '%d%m%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""


def excel_serial(spark, sf_dir):
    serial = F.datediff(F.col("day"), F.lit("1899-12-30").cast("date"))
    rows = _orders(spark, sf_dir).select("id", serial.alias("n"), (serial + 0.75).alias("f"), serial.cast("string").alias("s"))
    stamp, explicit = times.parse_datetime(F.col("f"), F.lit(None).cast("date"), "float")
    return rows.select(
        "id", dates.normalize_date(F.col("n"), "int").alias("reconcile_day"),
        dates.normalize_compare_date(F.col("f"), "float").alias("compare_day"),
        dates.normalize_compare_date(F.col("s")).alias("text_day"),
        dates.normalize_date(F.col("s")).alias("text_kept"),
        times.format_datetime(stamp).alias("stamp"), explicit.alias("explicit"),
    )


EXCEL_SERIAL = """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS reconcile_day, strftime(o_orderdate, '%Y-%m-%d') AS compare_day,
       strftime(o_orderdate, '%Y-%m-%d') AS text_day,
       CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS VARCHAR) AS text_kept,
       strftime(o_orderdate, '%Y-%m-%d') || ' 18:00' AS stamp, true AS explicit
FROM orders"""


def _events(spark, sf_dir):
    second = F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), second.alias("t"), F.col("ts").cast("date").alias("day"))


def time_formats(spark, sf_dir):
    t = F.col("t").cast("string")
    hour, minute = F.substring(t, 12, 2), F.substring(t, 15, 2)
    number = hour.cast("int") * 100 + minute.cast("int")
    rows = _events(spark, sf_dir).select(
        "id", F.substring(t, 12, 8).alias("clock"), F.concat(hour, F.lit("."), minute).alias("dotted"),
        number.cast("string").alias("digits"), number.alias("number"),
        ((hour.cast("int") * 60 + minute.cast("int")) / 1440.0).alias("fraction"),
        F.concat(F.lit("ETD "), F.substring(t, 12, 5), F.lit(" Z")).alias("inside"),
        F.concat(F.lit("9"), hour, minute).alias("wrong"),
    )
    return rows.select(
        "id", times.time_minutes(F.col("clock")).alias("clock"), times.time_minutes(F.col("dotted")).alias("dotted"),
        times.time_minutes(F.col("digits")).alias("digits"), times.time_minutes(F.col("number"), "int").alias("number"),
        times.time_minutes(F.col("fraction"), "float").alias("fraction"), times.time_minutes(F.col("wrong")).alias("wrong"),
        times.normalize_compare_time(F.col("inside")).alias("inside"),
        times.normalize_compare_time(F.col("wrong")).alias("kept"),
        times.normalize_compare_time(F.col("number"), "int").alias("compare_number"),
        times.fallback_time_display(F.col("digits")).alias("display"),
        times.fallback_time_display(F.col("wrong")).alias("display_kept"),
    )


TIME_FORMATS = """
SELECT event_id AS id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS clock, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS dotted,
       CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS digits, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS number, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS fraction,
       CAST(NULL AS INTEGER) AS wrong, strftime(ts, '%H:%M') AS inside, '9' || strftime(ts, '%H%M') AS kept,
       strftime(ts, '%H:%M') AS compare_number, strftime(ts, '%H:%M') AS display, '9' || strftime(ts, '%H%M') AS display_kept
FROM events"""


def datetime_anchor(spark, sf_dir):
    t = F.col("t").cast("string")
    slashed = F.concat(F.substring(t, 9, 2), F.lit("/"), F.substring(t, 6, 2), F.lit("/"), F.substring(t, 1, 4),
                       F.lit(" "), F.substring(t, 12, 5))
    raw = F.when(F.col("id") % 4 == 0, t).when(F.col("id") % 4 == 1, F.substring(t, 12, 5)).when(
        F.col("id") % 4 == 2, F.concat(F.substring(t, 1, 10), F.lit(" late"))).otherwise(slashed)
    rows = _events(spark, sf_dir).select("id", raw.alias("raw"), F.date_add("day", 1).alias("flight_day"))
    stamp, explicit = times.parse_datetime(F.col("raw"), F.col("flight_day"))
    return rows.select(
        "id", stamp.cast("string").alias("stamp"), explicit.alias("explicit"),
        times.format_date(times.parse_priority_timestamp(F.col("raw"))).alias("version_day"),
        dates.normalize_date(F.col("raw")).alias("day_first"),
    )


DATETIME_ANCHOR = """
WITH e AS (SELECT event_id AS id, date_trunc('second', ts) AS t FROM events),
m AS (SELECT *, CASE WHEN day(t) <= 12 THEN make_date(year(t), day(t), month(t)) ELSE CAST(t AS DATE) END AS md FROM e)
SELECT id, CASE id % 4 WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
                WHEN 1 THEN strftime(CAST(t AS DATE) + 1, '%Y-%m-%d') || ' ' || strftime(t, '%H:%M:00')
                WHEN 2 THEN NULL ELSE strftime(md, '%Y-%m-%d') || ' ' || strftime(t, '%H:%M:00') END AS stamp,
       id % 4 <> 1 AS explicit,
       CASE id % 4 WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 3 THEN strftime(md, '%Y-%m-%d') END AS version_day,
       CASE id % 4 WHEN 1 THEN strftime(t, '%H:%M') ELSE strftime(t, '%Y-%m-%d') END AS day_first
FROM m"""


def overnight(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        "id", "day", F.substring(F.col("t").cast("string"), 12, 5).alias("ata"),
        F.substring((F.col("t") - F.expr("INTERVAL 3 HOUR")).cast("string"), 12, 5).alias("atd"),
        F.when(F.col("id") % 2 == 0, "A").when(F.col("id") % 3 == 0, "D").otherwise("O").alias("move"),
    )
    stamped = rows.select("*", times.parse_datetime(F.col("atd"), F.col("day"))[0].alias("atd_at"),
                          times.parse_datetime(F.col("ata"), F.col("day"))[0].alias("ata_at"))
    settled = stamped.withColumn("ata_at", times.overnight_arrival(F.col("atd_at"), F.col("ata_at"), F.lit(False)))
    return settled.select(
        "id", times.format_datetime(F.col("atd_at")).alias("atd"), times.format_datetime(F.col("ata_at")).alias("ata"),
        times.format_datetime(times.movement_datetime(F.col("move"), F.col("atd_at"), F.col("ata_at"))).alias("moved"),
    )


OVERNIGHT = """
WITH e AS (SELECT event_id AS id, date_trunc('minute', ts) AS t, date_trunc('minute', ts) - INTERVAL 3 HOUR AS d FROM events),
m AS (SELECT id, t + CASE WHEN hour(t) < 3 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ata,
             d + CASE WHEN hour(t) < 3 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS atd FROM e)
SELECT id, strftime(atd, '%Y-%m-%d %H:%M') AS atd, strftime(ata, '%Y-%m-%d %H:%M') AS ata,
       CASE WHEN id % 2 = 0 THEN strftime(ata, '%Y-%m-%d %H:%M') WHEN id % 3 = 0 THEN strftime(atd, '%Y-%m-%d %H:%M') END AS moved
FROM m"""


def time_bucket(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("t", F.when(F.col("id") % 9 > 0, F.col("t")))
    return rows.groupBy(times.time_bucket(F.col("t")).alias("bucket"), times.time_bucket(F.col("t"), 4).alias("four")).agg(
        F.count("*").alias("n")
    )


TIME_BUCKET = """
WITH e AS (SELECT CASE WHEN event_id % 9 > 0 THEN hour(ts) END AS h FROM events)
SELECT CASE WHEN h IS NULL THEN 'NO-TIME' ELSE printf('%02d-%02d', h // 6 * 6, h // 6 * 6 + 5) END AS bucket,
       CASE WHEN h IS NULL THEN 'NO-TIME' ELSE printf('%02d-%02d', h // 4 * 4, h // 4 * 4 + 3) END AS four, count(*) AS n
FROM e GROUP BY ALL"""


def time_difference(spark, sf_dir):
    rows = _events(spark, sf_dir).select("id", "t", F.col("day").cast("timestamp_ntz").alias("midnight"))
    apart = times.minutes_apart(F.col("midnight"), F.col("t"))
    return rows.select("id", apart.alias("minutes"), times.round_tenth(apart).alias("rounded"))


TIME_DIFFERENCE = """
SELECT event_id AS id, epoch(date_trunc('second', ts) - date_trunc('day', ts)) / 60.0 AS minutes,
       round_even(epoch(date_trunc('second', ts) - date_trunc('day', ts)) / 60.0, 1) AS rounded FROM events"""


def keyword_flag(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("REMARK"))
    return d.select("doc_id", remarks.special_remark_keyword(d.columns, DOCUMENT_WORDS).alias("keyword"))


KEYWORD_FLAG = "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(upper(text), '{w}') THEN '{w}'" for w in DOCUMENT_WORDS
) + " END AS keyword FROM documents"


def remark_display(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("REMARK"),
        F.when(F.col("o_orderkey") % 6 == 0, "").when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority"))
        .otherwise("note").alias("Note"),
        F.when(F.col("o_orderkey") % 5 == 0, "Diversion").otherwise(F.col("o_orderstatus")).alias("STATUS FLIGHT"),
        F.when(F.col("o_orderkey") % 7 == 0, "yes").otherwise("no").alias("RTB/RTA"),
    )
    names = [n for n in c.columns if n != "o_orderkey"]
    found = c.withColumn("_keyword", remarks.special_remark_keyword(names))
    return found.select(
        "o_orderkey", F.col("_keyword").alias("keyword"), F.col("_keyword").isNotNull().alias("special"),
        remarks.remark_display(names, F.col("_keyword")).alias("shown"),
    )


REMARK_DISPLAY = """
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS remark,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE 'note' END AS note,
         CASE WHEN o_orderkey % 5 = 0 THEN 'DIVERSION' WHEN o_orderkey % 7 = 0 THEN 'RTB' END AS keyword,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Diversion' ELSE o_orderstatus END AS status FROM orders),
p AS (SELECT *, nullif(concat_ws(' / ', remark, CASE WHEN remark IS NOT NULL AND upper(note) = upper(remark) THEN NULL ELSE note END), '') AS texts FROM o)
SELECT o_orderkey, keyword, keyword IS NOT NULL AS special,
       coalesce(texts, CASE WHEN keyword IS NOT NULL THEN status END, keyword) AS shown FROM p"""


def excluded_flights(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(remarks.is_excluded_flight_number(F.col("p_name"), PART_TOKENS).alias("excluded"), "p_brand").agg(
        F.count("*").alias("n")
    )


EXCLUDED_FLIGHTS = """
SELECT regexp_matches(regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g'), 'RING|WIDGET|GEAR') AS excluded, p_brand, count(*) AS n
FROM part GROUP BY ALL"""


def field_values(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        "id", F.concat(F.lit("'"), F.lower("o_orderpriority"), F.lit(" '")).alias("code"),
        F.when(F.col("id") % 3 == 0, F.concat(F.col("day").cast("string"), F.lit(" -"))).otherwise(F.lit("08.15")).alias("time"),
        F.col("o_totalprice").alias("price"),
    )
    return o.select(
        "id", values.normalize_value(F.col("code"), "flight").alias("code"),
        values.normalize_value(F.col("code"), "parking").alias("parking"),
        values.normalize_value(F.concat(F.lit("stand／ﬂ½e\u0301 "), F.col("id").cast("string")), "parking").alias("folded"),
        values.display_value(F.col("code"), "flight").alias("shown"),
        values.display_value(F.col("time"), "atd").alias("time"),
        values.display_value(F.floor(F.col("price")).cast("double"), "parking", "float").alias("price"),
    )


FIELD_VALUES = """
SELECT o_orderkey AS id, regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '', 'g') AS code, upper(o_orderpriority) AS parking,
       'STAND/FL1⁄2É ' || o_orderkey AS folded,
       lower(o_orderpriority) AS shown, CASE WHEN o_orderkey % 3 <> 0 THEN '08:15' END AS time,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders"""

QUERIES = {
    "clean_text": (clean_text, CLEAN_TEXT),
    "norm_code": (norm_code, NORM_CODE),
    "display_text": (display_text, DISPLAY_TEXT),
    "msg_number": (msg_number, MSG_NUMBER),
    "date_formats": (date_formats, DATE_FORMATS),
    "date_formats_compare": (date_formats_compare, DATE_FORMATS_COMPARE),
    "excel_serial": (excel_serial, EXCEL_SERIAL),
    "time_formats": (time_formats, TIME_FORMATS),
    "datetime_anchor": (datetime_anchor, DATETIME_ANCHOR),
    "overnight": (overnight, OVERNIGHT),
    "time_bucket": (time_bucket, TIME_BUCKET),
    "time_difference": (time_difference, TIME_DIFFERENCE),
    "keyword_flag": (keyword_flag, KEYWORD_FLAG),
    "remark_display": (remark_display, REMARK_DISPLAY),
    "excluded_flights": (excluded_flights, EXCLUDED_FLIGHTS),
    "field_values": (field_values, FIELD_VALUES),
}
