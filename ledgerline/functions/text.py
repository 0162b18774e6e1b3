"""Text clean-up as column expressions. Blank is NULL inside the engine."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerline.constants import EMPTY_TOKENS

# Every character that counts as white space at the ends of a cell.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
QUOTED = r"(?s)^(['\"])(.*)\1$"


def field(name: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    """The parsing branch a column of this type takes: cells of one column share one type."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "interval"
    return "text"


def as_text(c: Column, kind: str = "text") -> Column:
    """Text of a raw cell; large floating numbers are written out, not in E notation."""
    if kind != "float":
        return c
    written = c.cast("string")
    plain = F.regexp_replace(written.try_cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(written.contains("E") & F.abs(c).between(1e-4, 1e16), plain).otherwise(written)


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def _peel(c: Column) -> Column:
    return strip(F.regexp_replace(c, QUOTED, "$2"))


def _unquoted(text: Column) -> Column:
    """Plain cells pass; two layers of quotes come off directly, deeper ones by a fold
    bounded by the length of the cell itself."""
    twice = _peel(_peel(text))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(text)), twice, lambda acc, _: _peel(acc))
    quoted = text.startswith("'") | text.startswith('"')
    return F.when(quoted, F.when(twice.rlike(QUOTED), rest).otherwise(twice)).otherwise(text)


def _settled(c: Column, finish: Callable[[Column], Column]) -> Column:
    """Trim and unquote, then apply ``finish``.

    The lambdas bind their text, so it can be looked at several times while ``c`` is
    named only once: expressions built on top of each other stay small.
    """
    return F.element_at(F.transform(F.transform(F.array(strip(c)), _unquoted), finish), 1)


def unquote(c: Column) -> Column:
    """Trim, then take matching outer quotes off until none is left."""
    return _settled(c, lambda text: text)


def without(c: Column, tokens: Sequence[str]) -> Column:
    """Unquoted text, NULL where it is one of the tokens."""
    return _settled(c, lambda text: F.when(~F.upper(text).isin(*tokens), text))


def clean_scalar_text(c: Column) -> Column:
    """Unquoted text; an empty cell becomes NULL, placeholder words stay."""
    return without(c, ("",))


def clean_text(c: Column) -> Column:
    """Unquoted text; empty cells and placeholder words become NULL."""
    return without(c, EMPTY_TOKENS)


def is_present(c: Column) -> Column:
    return clean_text(c).isNotNull()


def is_empty(c: Column) -> Column:
    """Presence test of the table diff: placeholder words count as content."""
    return clean_scalar_text(c).isNull()


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


_folded = F.pandas_udf(_nfkc, T.StringType())


def fold_compatibility(c: Column) -> Column:
    """Compatibility folding (NFKC): full-width and styled letters, ligatures, fractions, combining
    sequences. Spark has no expression for it, so cells beyond ASCII take one Arrow pass;
    the others enter that pass as NULL and keep their text.
    """
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _folded(F.when(odd, c))).otherwise(c)


def code_of(text: Column) -> Column:
    """Code of an already cleaned text: upper-case letters and digits only."""
    reduced = F.regexp_replace(F.upper(fold_compatibility(text)), "[^A-Z0-9]+", "")
    return F.nullif(F.when(text.rlike("^[A-Z0-9]+$"), text).otherwise(reduced), F.lit(""))


def normalize_code(c: Column) -> Column:
    return code_of(clean_text(c))


def display_text(c: Column, kind: str = "text") -> Column:
    """Cell text for display; a whole-valued floating number shows as an integer."""
    if kind == "float":
        as_double = c.cast("double")
        whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < F.lit(1e18))
        return F.when(whole, as_double.cast("bigint").cast("string")).otherwise(clean_text(as_text(c, kind)))
    return clean_text(c)


def prefer(primary: Column, fallback: Column) -> Column:
    """First non-blank of two cleaned values."""
    return F.coalesce(primary, fallback)


def collapse_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """NULL back to the empty string, for output only."""
    return F.coalesce(c, F.lit(""))


def duplicate_group_key(*columns: Column) -> Column:
    return F.concat_ws(" | ", *[blank(c) for c in columns])
