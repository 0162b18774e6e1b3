"""Flight exclusion and special-operation remarks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from ledgerline.constants import (
    NON_BILLABLE_TOKENS, REMARK_FLAG_HEADERS, REMARK_STATUS_HEADER, REMARK_TEXT_HEADERS,
    SPECIAL_REMARK_KEYWORDS, UNCHECKED_VALUES,
)
from ledgerline.functions.text import clean_text, field, normalize_code
from ledgerline.plans.mapping import normalize_header


def is_excluded_flight_number(c: Column, tokens: Sequence[str] = NON_BILLABLE_TOKENS) -> Column:
    """Internal or non-billable movement: the code contains any of the tokens."""
    return code_is_excluded(normalize_code(c), tokens)


def code_is_excluded(code: Column, tokens: Sequence[str] = NON_BILLABLE_TOKENS) -> Column:
    pattern = "|".join(re.escape(token) for token in tokens)
    return F.coalesce(code.rlike(pattern), F.lit(False))


is_non_billable_flight = is_excluded_flight_number


def distinct_parts(parts: Sequence[Column]) -> list[Column]:
    """Parts with later case-insensitive repeats turned to NULL; order kept."""
    kept: list[Column] = []
    for position, part in enumerate(parts):
        fresh = F.lit(True)
        for earlier in parts[:position]:
            fresh = fresh & ~F.upper(part).eqNullSafe(F.upper(earlier))
        kept.append(F.when(fresh, part) if position else part)
    return kept


def first_keyword(text: Column, keywords: Sequence[str] = SPECIAL_REMARK_KEYWORDS) -> Column:
    """First keyword of the list, in list order, that the upper-cased text contains."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in keywords])


def remark_columns(columns: Iterable[str]) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Plan-time choice: all remark columns, text-only remark columns, flag columns."""
    text_heads = {normalize_header(h) for h in REMARK_TEXT_HEADERS}
    flag_heads = {normalize_header(h): k for h, k in REMARK_FLAG_HEADERS.items()}
    every, text_only, flags = [], [], []
    for name in columns:
        head = normalize_header(name)
        standardized = name == "STREAM REMARK"
        if standardized or head in text_heads:
            text_only.append(name)
            every.append(name)
        elif head == normalize_header(REMARK_STATUS_HEADER):
            every.append(name)
        if head in flag_heads:
            flags.append((name, flag_heads[head]))
    return every, text_only, flags


def special_remark_keyword(
    columns: Iterable[str], keywords: Sequence[str] = SPECIAL_REMARK_KEYWORDS
) -> Column:
    """Keyword found in the remark texts, else the keyword of the first checked flag."""
    every, _, flags = remark_columns(columns)
    choices: list[Column] = []
    if every:
        parts = distinct_parts([clean_text(field(n)) for n in every])
        choices.append(first_keyword(F.upper(F.concat_ws(" ", *parts)), keywords))
    for name, keyword in flags:
        value = F.upper(clean_text(field(name)))
        choices.append(F.when(~value.isin(*UNCHECKED_VALUES), F.lit(keyword)))
    return F.coalesce(*choices) if choices else F.lit(None).cast("string")


special_stream_remark_keyword = special_remark_keyword


def has_special_stream_remark(columns: Iterable[str]) -> Column:
    return special_remark_keyword(columns).isNotNull()


def remark_display(columns: Iterable[str], keyword: Column) -> Column:
    """Distinct remark texts joined for display; status text only for special rows."""
    every, text_only, _ = remark_columns(columns)

    def joined(names: list[str]) -> Column:
        if not names:
            return F.lit(None).cast("string")
        parts = distinct_parts([clean_text(field(n)) for n in names])
        return F.nullif(F.concat_ws(" / ", *parts), F.lit(""))

    return F.coalesce(joined(text_only), F.when(keyword.isNotNull(), joined(every)), keyword)
