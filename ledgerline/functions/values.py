"""Per-field display and comparison values of the table diff."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.constants import CODE_FIELDS, COMPARE_EMPTY_TOKENS, TIME_FIELDS
from ledgerline.functions.dates import compare_cell_date
from ledgerline.functions.text import collapse_upper, display_text, fold_compatibility, strip, without
from ledgerline.functions.times import compare_cell_time

DANGLING_DATE = r"^\d{4}-\d{2}-\d{2}\s*[-—]$"  # fixed value: a date whose time is only a dash


def content(c: Column) -> Column:
    """Unquoted text, NULL for empty cells and placeholder words."""
    return without(c, COMPARE_EMPTY_TOKENS)


def normalized(c: Column, text: Column, field_name: str, kind: str = "text") -> Column:
    """Comparison form of a raw cell whose :func:`content` is ``text``."""
    if field_name == "eobd":
        return F.when(text.isNotNull(), compare_cell_date(c, text, kind))
    if field_name in TIME_FIELDS:
        return F.when(text.isNotNull(), compare_cell_time(c, text, kind))
    folded = F.upper(strip(fold_compatibility(text)))
    if field_name in CODE_FIELDS:
        return F.nullif(F.regexp_replace(folded, "[^A-Z0-9]+", ""), F.lit(""))
    return F.nullif(collapse_upper(folded), F.lit(""))


def displayed(c: Column, text: Column, field_name: str, kind: str = "text") -> Column:
    """Report form of a raw cell whose :func:`content` is ``text``."""
    whole = F.when(~text.rlike(DANGLING_DATE), text)
    if field_name == "eobd" or field_name in TIME_FIELDS:
        return F.when(whole.isNotNull(), F.coalesce(normalized(c, text, field_name, kind), text))
    if kind == "float":
        return F.when(whole.isNotNull(), F.coalesce(display_text(c, kind), text))
    return whole


def normalize_value(c: Column, field_name: str, kind: str = "text") -> Column:
    """Comparison form of a cell, chosen by field class; NULL when blank."""
    return normalized(c, content(c), field_name, kind)


def display_value(c: Column, field_name: str, kind: str = "text") -> Column:
    """What a report shows for a cell; NULL when blank."""
    return displayed(c, content(c), field_name, kind)
