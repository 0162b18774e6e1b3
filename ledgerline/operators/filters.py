"""Filters a reader of a result table can apply, and the values they can choose from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.text import field
from ledgerline.operators.recovery import flight_date


def filter_results(
    df: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    flight_contains: str = "",
    aerodromes: Sequence[str] = (),
    destinations: Sequence[str] = (),
    movements: Sequence[str] = (),
) -> DataFrame:
    """Inclusive date range, literal case-insensitive search, and value lists.

    An option that is left empty does not filter.
    """
    out = df
    if date_from is not None and date_to is not None:
        out = out.where(flight_date().between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    if flight_contains.strip():
        out = out.where(F.upper("FLIGHT NUMBER").contains(flight_contains.strip().upper()))
    for column, allowed in (
        ("AERODROME", aerodromes), ("TO FROM", destinations), ("D/A/L/O", movements),
    ):
        if allowed:
            out = out.where(field(column).isin(*allowed))
    return out


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column, sorted."""
    value = field(column).cast("string")
    return df.select(value.alias("value")).where(F.col("value") != "").distinct().orderBy("value")


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min(flight_date()).alias("min_date"), F.max(flight_date()).alias("max_date"))
