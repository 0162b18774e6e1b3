"""Times of day and movement timestamps as column expressions.

Timestamps are TIMESTAMP_NTZ: the wall clock of the extract, no zone. Formatting
goes through the string cast so the session zone never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.constants import BUCKET_HOURS
from ledgerline.functions.dates import (
    CENTURY_DIGITS, DAY_FIRST, MONTH_FIRST, MONTH_NAME, NAME_AHEAD, NAME_BETWEEN, SERIAL_EPOCH,
    SPACED, iso_day, rewrite,
)
from ledgerline.functions.text import clean_scalar_text, clean_text, collapse_upper

# --- fixed values: time and date-time shapes ----------------------------------------
CLOCK = r"^(\d{1,2}):(\d{2})(?::\d{2})?$"
COMPACT_CLOCK = r"^\d{1,4}$"
EMBEDDED_CLOCK = r"(?:^|\s)(\d{1,2}):(\d{2})(?::\d{2})?(?:\s|$)"
LEADING_CLOCK = r"^(\d{1,2}):(\d{2})"
EXPLICIT_DATE = (
    r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"^(?:19|20)\d{6}(?:\D|$)",
)
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
DATE_AHEAD = r"^\d+[-/.]\d+[-/.]\d+|^(?:19|20)\d{6}(?:\D|$)"
ZONE = (r"(\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:Z|UTC|[+-]\d{2}:?\d{2})$", "$1")
HALF_DAY_PATTERNS = ("M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a")
NAMED_PATTERN = "d MMM yyyy[ H:mm[:ss]]"
NUMBER_IN_TEXT = r"-?\d+(?:\.\d+)?"
MINUTES_PER_DAY = 24 * 60
FIRST_SERIAL = 2400
LAST_SERIAL = 132305  # the last whole day of a nanosecond timestamp
ONE_DAY = "INTERVAL 1 DAY"


def _clock_minutes(text: Column, shape: str) -> Column:
    hour = F.regexp_extract(text, shape, 1).try_cast("int")
    minute = F.regexp_extract(text, shape, 2).try_cast("int")
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def _compact_minutes(digits: Column) -> Column:
    number = digits.try_cast("int")
    hour, minute = F.floor(number / 100).cast("int"), number % 100
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def _number_minutes(number: Column) -> Column:
    """Fraction of a day, or a whole HHMM number."""
    fraction = (F.bround(number * MINUTES_PER_DAY, 0) % MINUTES_PER_DAY).cast("int")
    whole = (number == F.floor(number)) & number.between(0, 2359)
    return F.when((number >= 0) & (number < 1), fraction).when(whole, _compact_minutes(number.cast("int")))


def _interval_minutes(c: Column) -> Column:
    seconds = c.cast("interval second").cast("decimal(24,6)")
    return (F.pmod(F.floor(seconds / 60), F.lit(MINUTES_PER_DAY))).cast("int")


def text_minutes(text: Column) -> Column:
    """Minutes of the day in a cleaned text (reconcile profile), NULL if none."""
    dotted = F.replace(text, F.lit("."), F.lit(":"))
    hour = F.split_part(dotted, F.lit(":"), F.lit(1)).try_cast("int")
    minute = F.split_part(dotted, F.lit(":"), F.lit(2)).try_cast("int")
    return (
        F.when(dotted.rlike(CLOCK), F.when((hour < 24) & (minute < 60), hour * 60 + minute))
        .when(dotted.rlike(COMPACT_CLOCK), _compact_minutes(dotted))
    )


def _timestamp_minutes(c: Column) -> Column:
    return F.hour(c) * 60 + F.minute(c)


def time_minutes(c: Column, kind: str = "text") -> Column:
    """Minutes of the day of a raw cell (reconcile profile)."""
    if kind == "timestamp":
        return _timestamp_minutes(c)
    if kind == "interval":
        return _interval_minutes(c)
    parsed = text_minutes(clean_text(c))
    if kind in ("int", "float"):
        return F.coalesce(_number_minutes(c.cast("double")), parsed)
    return parsed


def clock(minutes: Column) -> Column:
    """``HH:MM`` of a minute of the day; NULL where there is none."""
    return format_time(F.lit("1970-01-01").cast("timestamp_ntz") + _minutes(minutes))


def compare_text_minutes(text: Column) -> Column:
    """Minutes of the day in an unquoted text (table-diff profile), NULL if none."""
    dotted = F.replace(text, F.lit("."), F.lit(":"))
    return F.coalesce(
        _clock_minutes(text, EMBEDDED_CLOCK),
        F.when(dotted.rlike(COMPACT_CLOCK), _compact_minutes(dotted)),
        _clock_minutes(dotted, LEADING_CLOCK),
    )


def compare_cell_time(c: Column, text: Column, kind: str = "text") -> Column:
    """``HH:MM`` of a raw cell (``text`` is its unquoted text), table-diff profile."""
    if kind == "timestamp":
        return clock(_timestamp_minutes(c))
    if kind == "interval":
        return clock(_interval_minutes(c))
    minutes = compare_text_minutes(text)
    if kind in ("int", "float"):
        minutes = F.coalesce(_number_minutes(c.cast("double")), minutes)
    unread = collapse_upper(F.replace(text, F.lit("."), F.lit(":")))
    return F.coalesce(clock(minutes), unread)


def normalize_compare_time(c: Column, kind: str = "text") -> Column:
    """``HH:MM`` under the table-diff profile; an unreadable text stays, upper-cased."""
    return compare_cell_time(c, clean_scalar_text(c), kind)


def text_has_date(text: Column) -> Column:
    found = text.rlike(EXPLICIT_DATE[0]) | text.rlike(EXPLICIT_DATE[1]) | text.rlike(EXPLICIT_DATE[2])
    return F.coalesce(found, F.lit(False))


def has_explicit_date(c: Column, kind: str = "text") -> Column:
    if kind in ("date", "timestamp"):
        return c.isNotNull()
    if kind in ("int", "float"):
        return F.coalesce(c.cast("double") >= FIRST_SERIAL, F.lit(False))
    return text_has_date(clean_text(c))


def _minutes(minutes: Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, minutes, zero.cast("decimal(18,6)"))


def _midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def at_minute(date: Column, minutes: Column) -> Column:
    return _midnight(date) + _minutes(minutes)


def text_timestamp(text: Column) -> Column:
    """Timestamp of a cleaned text that carries a date: month first, then day first."""
    plain = rewrite(text, (ZONE, CENTURY_DIGITS, *SPACED))
    loose = F.coalesce(
        rewrite(plain, (MONTH_FIRST,)).try_cast("timestamp_ntz"),
        rewrite(plain, (DAY_FIRST,)).try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in HALF_DAY_PATTERNS],
    )
    written = F.try_to_timestamp(rewrite(text, (NAME_BETWEEN, NAME_AHEAD)), F.lit(NAMED_PATTERN))
    return (
        F.when(text.rlike(ISO_DATE_TIME), text.try_cast("timestamp_ntz"))
        .when(text.rlike(DATE_AHEAD), loose)
        .when(text.rlike(MONTH_NAME), written.cast("timestamp_ntz"))
    )


def serial_timestamp(days: Column) -> Column:
    seconds = (F.when(days.between(FIRST_SERIAL, LAST_SERIAL), days) * 86400).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit(SERIAL_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def parse_datetime(c: Column, flight_date: Column, kind: str = "text") -> tuple[Column, Column]:
    """Timestamp of a raw cell plus whether the cell itself named the date.

    ``flight_date`` is a DATE; a bare time of day is anchored to it.
    """
    if kind == "timestamp":
        return c.cast("timestamp_ntz"), c.isNotNull()
    if kind == "date":
        return _midnight(c), c.isNotNull()
    anchored = at_minute(flight_date, time_minutes(c, kind))
    if kind in ("int", "float"):
        number = c.cast("double")
        serial = F.coalesce(number >= FIRST_SERIAL, F.lit(False))
        dated = F.coalesce(serial_timestamp(number), text_timestamp(clean_text(c)))
        return F.when(serial, dated).otherwise(anchored), serial
    if kind == "interval":
        return anchored, F.lit(False)
    text = clean_text(c)
    explicit = text_has_date(text)
    return F.when(explicit, text_timestamp(text)).otherwise(anchored), explicit


def parse_datetime_value(c: Column, flight_date: Column, kind: str = "text") -> Column:
    """Timestamp only; ``flight_date`` is the normalized text of the flight date."""
    return parse_datetime(c, iso_day(flight_date), kind)[0]


def overnight_arrival(atd: Column, ata: Column, ata_explicit: Column) -> Column:
    """An arrival clock time before the departure belongs to the next day."""
    return F.when(~ata_explicit & (ata < atd), ata + F.expr(ONE_DAY)).otherwise(ata)


def format_time(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 12, 5)


def format_datetime(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 16)


def format_date(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def fallback_time_display(c: Column, kind: str = "text") -> Column:
    """``HH:MM`` if the cell reads as a time, else the cell text."""
    return F.coalesce(clock(time_minutes(c, kind)), clean_text(c))


def movement_datetime(move: Column, atd: Column, ata: Column) -> Column:
    return F.when(move == "A", ata).when(move == "D", atd)


def priority_timestamp(text: Column) -> Column:
    """Version timestamp of a cleaned text."""
    return text_timestamp(text)


def parse_priority_timestamp(c: Column, kind: str = "text") -> Column:
    if kind in ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    return priority_timestamp(clean_text(c))


def message_number(text: Column) -> Column:
    """Number of a cleaned text; NULL stands for minus infinity."""
    return F.coalesce(
        text.try_cast("double"), F.regexp_extract(text, f"({NUMBER_IN_TEXT})", 1).try_cast("double")
    )


def parse_message_number(c: Column) -> Column:
    return message_number(clean_text(c))


def time_bucket(ts: Column, hours: int = BUCKET_HOURS) -> Column:
    first = (F.floor(F.hour(ts) / hours) * hours).cast("int")
    label = F.concat_ws(
        "-", F.lpad(first.cast("string"), 2, "0"), F.lpad((first + (hours - 1)).cast("string"), 2, "0")
    )
    return F.when(ts.isNotNull(), label).otherwise(F.lit("NO-TIME"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed seconds between two wall-clock timestamps, exact to the microsecond."""
    return (later - earlier).cast("interval second").cast("decimal(24,6)")


def minutes_apart(a: Column, b: Column) -> Column:
    """Minutes between two wall-clock timestamps, exact to the microsecond. Whole seconds and the rest are counted as
    numbers: listed pairs call it for each pair, and a decimal apiece costs more than everything else it does."""
    apart = a - b
    seconds = apart.cast("interval second").cast("bigint")
    rest = (apart - seconds * F.expr("INTERVAL '1' SECOND")) * 1000000
    micros = seconds * 1000000 + rest.cast("interval second").cast("bigint")
    return F.abs(micros).cast("double") / F.lit(1000000.0) / F.lit(60.0)


def round_tenth(minutes: Column) -> Column:
    """One decimal, ties to even."""
    return F.bround(minutes, 1)

