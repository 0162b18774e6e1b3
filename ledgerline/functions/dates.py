"""Calendar dates out of messy cells: a reconcile profile and a table-diff profile.

The two profiles disagree on purpose (serial range, compact digits, ISO prefix).
Free-form date guessing has no Spark equivalent, so the accepted shapes are listed
here; any other text stays as it is, upper-cased.

A reading is a list of rewrites that turn each shape into ``year-month-day``. Rewrites
chain, so an expression grows with the number of shapes and not with their product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ledgerline.functions.text import clean_scalar_text, clean_text, collapse_upper

# --- fixed values: date shapes and their year-month-day rewrites --------------------
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
LOOSE_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
SIX_DIGITS = r"^\d{6}$"
EIGHT_DIGITS = r"^\d{8}$"
SERIAL_TEXT = r"^\d{5}(?:\.0+)?$"
TIME_TAIL = r"[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?$"
SEP = r"[-/.]"

ISO_PREFIX = (r"^(\d{4}-\d{2}-\d{2}).*$", "$1")
ISO_WHOLE = (r"^(\d{4}-\d{2}-\d{2})[ T].*$", "$1")
DROP_TIME = (TIME_TAIL, "")
YEAR_2000S = (r"^([0-5]\d|6[0-8])(\d{2})(\d{2})$", "20$1-$2-$3")
YEAR_1900S = (r"^(69|[7-9]\d)(\d{2})(\d{2})$", "19$1-$2-$3")
WIDEN_2000S = (rf"^(\d{{1,2}}{SEP}\d{{1,2}}{SEP})([0-5]\d|6[0-8])(?!\d)", "$120$2")
WIDEN_1900S = (rf"^(\d{{1,2}}{SEP}\d{{1,2}}{SEP})(69|[7-9]\d)(?!\d)", "$119$2")
YEAR_FIRST = (rf"^(\d{{4}}){SEP}(\d{{1,2}}){SEP}(\d{{1,2}})", "$1-$2-$3")
DAY_FIRST = (rf"^(\d{{1,2}}){SEP}(\d{{1,2}}){SEP}(\d{{4}})", "$3-$2-$1")
MONTH_FIRST = (rf"^(\d{{1,2}}){SEP}(\d{{1,2}}){SEP}(\d{{4}})", "$3-$1-$2")
CENTURY_DIGITS = (r"^((?:19|20)\d{2})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3")
DAY_DIGITS = (r"^(\d{2})(\d{2})(\d{4})$", "$3-$2-$1")
YEAR_DIGITS = (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
MONTH_NAME = r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
NAME_BETWEEN = (rf"^(\d{{1,2}}){SEP}?\s*({MONTH_NAME}){SEP}?,?\s*(\d{{4}})", "$1 $2 $3")
NAME_AHEAD = (rf"^({MONTH_NAME})\s*(\d{{1,2}}),?\s+(\d{{4}})", "$2 $1 $3")

SPACED = (WIDEN_2000S, WIDEN_1900S, YEAR_FIRST)
SHORT = (YEAR_2000S, YEAR_1900S)
SERIAL_EPOCH = "1899-12-30"

Rewrite = tuple[str, str]


def rewrite(text: Column, rules: Sequence[Rewrite]) -> Column:
    for shape, replacement in rules:
        text = F.regexp_replace(text, shape, replacement)
    return text


def parse_as(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def _read(text: Column, rules: Sequence[Rewrite]) -> Column:
    return F.regexp_extract(rewrite(text, rules), LOOSE_ISO_DATE, 0).try_cast("date")


def named_month(text: Column) -> Column:
    """Spelled-out months; two patterns cover the short and the full name."""
    plain = rewrite(text, (DROP_TIME, NAME_BETWEEN, NAME_AHEAD))
    return F.when(
        text.rlike(MONTH_NAME), F.coalesce(parse_as(plain, "d MMM yyyy"), parse_as(plain, "d MMMM yyyy"))
    )


def _first_reading(text: Column, prefix: Rewrite, compact: Sequence[Sequence[Rewrite]]) -> Column:
    """Shape decides the reading; separated dates are day first, or month first if that is none."""
    separated = [_read(text, (prefix, DROP_TIME, *SPACED, order)) for order in (DAY_FIRST, MONTH_FIRST)]
    with_time = _read(text, (DROP_TIME, CENTURY_DIGITS))
    return (
        F.when(text.rlike(ISO_DATE), text.try_cast("date"))
        .when(text.rlike(SIX_DIGITS), _read(text, SHORT))
        .when(text.rlike(EIGHT_DIGITS), F.coalesce(*[_read(text, rules) for rules in compact]))
        .otherwise(F.coalesce(*separated, with_time, named_month(text)))
    )


def serial_date(days: Column) -> Column:
    """Spreadsheet serial number to a date."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(days).cast("int"))


def reconcile_date(text: Column) -> Column:
    """DateType of a cleaned text under the reconcile profile; NULL if no date."""
    return _first_reading(text, ISO_PREFIX, ((CENTURY_DIGITS, DAY_DIGITS), (DAY_DIGITS, YEAR_DIGITS)))


def compare_date(text: Column) -> Column:
    """DateType of an unquoted text under the table-diff profile; NULL if no date."""
    serial = serial_date(F.when(text.rlike(SERIAL_TEXT), text.try_cast("double")))
    return F.coalesce(serial, _first_reading(text, ISO_WHOLE, ((CENTURY_DIGITS, DAY_DIGITS),)))


def iso(date: Column) -> Column:
    return date.cast("string")


def iso_day(text: Column) -> Column:
    """DateType of a text that is an ISO date already, else NULL."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def date_text(text: Column) -> Column:
    """ISO date of a cleaned text, or the text itself upper-cased."""
    return F.coalesce(iso(reconcile_date(text)), collapse_upper(text))


def compare_date_text(text: Column) -> Column:
    return F.coalesce(iso(compare_date(text)), collapse_upper(text))


def cell_date(c: Column, text: Column, kind: str = "text") -> Column:
    """DateType of a raw cell (``text`` is its cleaned text), reconcile profile."""
    if kind in ("date", "timestamp"):
        return c.cast("date")
    if kind not in ("int", "float"):
        return reconcile_date(text)
    number = c.cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string"))
    return F.coalesce(
        _read(F.when(whole.rlike(SIX_DIGITS), whole), SHORT),
        F.when(number.between(2400, 100000), serial_date(number)),
        reconcile_date(text),
    )


def normalize_date(c: Column, kind: str = "text") -> Column:
    """ISO text of a raw cell, reconcile profile; an unreadable text stays, upper-cased."""
    text = clean_text(c)
    return F.coalesce(iso(cell_date(c, text, kind)), collapse_upper(text))


def compare_cell_date(c: Column, text: Column, kind: str = "text") -> Column:
    """ISO text of a raw cell (``text`` is its unquoted text), table-diff profile."""
    if kind in ("date", "timestamp"):
        return iso(c.cast("date"))
    if kind not in ("int", "float"):
        return compare_date_text(text)
    number = c.cast("double")
    serial = F.when(number.between(1, 100000), serial_date(number))
    return F.coalesce(iso(serial), compare_date_text(text))


def normalize_compare_date(c: Column, kind: str = "text") -> Column:
    return compare_cell_date(c, clean_scalar_text(c), kind)
