"""Raw extract to the standardized 41-column table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import (
    FIELDS, SPECIAL_REMARK_KEYWORDS, STANDARDIZED_COLUMNS, STREAM, TIME_FIELDS,
)
from ledgerline.functions import times
from ledgerline.functions.dates import cell_date, iso
from ledgerline.functions.remarks import remark_display, special_remark_keyword
from ledgerline.functions.text import (
    as_text, clean_text, code_of, collapse_upper, display_text, field, kind_of, prefer,
)
from ledgerline.sources.rows import with_row_numbers



def raw_value(df: DataFrame, mapping: Mapping[str, str | None], name: str) -> tuple[Column, str]:
    """Mapped column and its cell kind; an unmapped field is NULL of kind ``none``."""
    column = mapping.get(name)
    if column and column in df.columns:
        return field(column), kind_of(df.schema[column].dataType)
    return F.lit(None).cast("string"), "none"


def standardize_dataset(
    df: DataFrame,
    mapping: Mapping[str, str | None],
    source_name: str,
    default_movement: str | None = None,
    row_col: str | None = None,
    keywords: Sequence[str] = SPECIAL_REMARK_KEYWORDS,
) -> DataFrame:
    """Project one extract to the standardized columns.

    The work is layered into a handful of projections so that every cleaned cell and
    parsed time is computed once and referenced by name afterwards; all layers fuse
    into one code-generated stage. ``row_col`` names the source-row ordinal; without
    it one is derived from the scan order.
    """
    if row_col is None:
        row_col = "_row"
        df = with_row_numbers(df, row_col)
    is_stream = source_name == STREAM
    data_columns = [c for c in df.columns if c != row_col]
    raw = {name: raw_value(df, mapping, name) for name in FIELDS}

    keyword = special_remark_keyword(data_columns, keywords) if is_stream else F.lit(None).cast("string")
    keyed = df.withColumn("_keyword", keyword)
    remark = remark_display(data_columns, F.col("_keyword")) if is_stream else F.lit(None).cast("string")
    cells = keyed.select(
        field(row_col).cast("bigint").alias("SOURCE ROW"),
        "_keyword",
        remark.alias("_remark"),
        *[(c if kind == "none" else clean_text(as_text(c, kind))).alias(f"_{n}") for n, (c, kind) in raw.items()],
        *[c.alias(f"_raw_{n}") for n, (c, kind) in raw.items() if kind not in ("text", "none")],
    )

    def original(name: str) -> Column:
        return F.col(f"_{name}") if raw[name][1] in ("text", "none") else F.col(f"_raw_{name}")

    def shown(name: str) -> Column:
        return display_text(original(name), "float") if raw[name][1] == "float" else F.col(f"_{name}")

    move = code_of(F.coalesce(F.lit(default_movement), F.col("_movement")))
    dated = cells.select(
        "*",
        move.alias("D/A/L/O"),
        cell_date(original("eobd"), F.col("_eobd"), raw["eobd"][1]).alias("_flight_date"),
        *[_explicit(original(n), raw[n][1]).alias(f"_{n}_explicit") for n in TIME_FIELDS],
        *[_minutes(original(n), raw[n][1]).alias(f"_{n}_minutes") for n in TIME_FIELDS],
    )
    timed = dated.select(
        "*",
        F.coalesce(iso(F.col("_flight_date")), collapse_upper(F.col("_eobd"))).alias("DATE OF FLIGHT"),
        *[_timestamp(n, original(n), raw[n][1]).alias(f"_{n}_ts") for n in TIME_FIELDS],
    )
    settled = timed.withColumns({
        "ATD_DATETIME": F.col("_atd_ts"),
        "ATA_DATETIME": times.overnight_arrival(
            F.col("_atd_ts"), F.col("_ata_ts"), F.col("_ata_explicit")
        ),
        "EOBT_DATETIME": F.col("_eobt_ts"),
    })
    placed = settled.withColumns({
        "MOVEMENT_DATETIME": times.movement_datetime(
            F.col("D/A/L/O"), F.col("ATD_DATETIME"), F.col("ATA_DATETIME")
        ),
        **{
            n.upper(): F.coalesce(
                times.format_time(F.col(f"{n.upper()}_DATETIME")),
                times.clock(F.col(f"_{n}_minutes")),
                F.col(f"_{n}"),
            )
            for n in ("atd", "ata")
        },
    })
    moved = F.col("MOVEMENT_DATETIME")
    arrival, departure = F.col("D/A/L/O") == "A", F.col("D/A/L/O") == "D"
    arrives, departs = F.coalesce(arrival, F.lit(False)), F.coalesce(departure, F.lit(False))
    movement_display = F.when(arrives, F.col("ATA")).otherwise(F.col("ATD"))
    none_text, none_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")

    def gate(side: str, applies: Column) -> Column:
        return F.when(applies, prefer(shown(f"{side}_gate"), shown("parking"))).otherwise(shown(f"{side}_gate"))

    def runway(side: str, applies: Column) -> Column:
        return code_of(
            F.when(applies, prefer(F.col(f"_{side}_runway"), F.col("_runway"))).otherwise(F.col(f"_{side}_runway"))
        )

    columns = {
        "DATE OF FLIGHT": F.col("DATE OF FLIGHT"),
        "ACTUAL MOVEMENT DATE": times.format_date(moved),
        "FLIGHT NUMBER": code_of(F.col("_flight")),
        "AERODROME": code_of(F.col("_adep")),
        "TO FROM": code_of(F.col("_ades")),
        "AC REGISTER": code_of(F.col("_register")),
        "ATD": F.col("ATD"),
        "ATA": F.col("ATA"),
        "D/A/L/O": F.col("D/A/L/O"),
        "ARRIVAL GATE": gate("arrival", arrives),
        "DEPARTURE GATE": gate("departure", departs),
        "DEPARTURE RUNWAY": runway("departure", departs),
        "ARRIVAL RUNWAY": runway("arrival", arrives),
        "SOURCE DATA": F.lit(source_name),
        "SOURCE ROW": F.col("SOURCE ROW"),
        "STREAM STATUS FLIGHT": code_of(F.col("_status_flight")),
        "STREAM REMARK": F.col("_remark"),
        "STREAM SPECIAL REMARK FLAG": F.col("_keyword").isNotNull(),
        "SPECIAL REMARK KEYWORD FOUND": F.col("_keyword"),
        "TIMESTAMP": shown("timestamp"),
        "MESSAGE NUM": shown("message_num"),
        "EOBT": F.coalesce(times.format_time(F.col("EOBT_DATETIME")), shown("eobt")),
        "EOBT_DATETIME": F.col("EOBT_DATETIME"),
        "ATD_DATETIME": F.col("ATD_DATETIME"),
        "ATA_DATETIME": F.col("ATA_DATETIME"),
        "MOVEMENT_DATETIME": moved,
        "MOVEMENT_TIME_DISPLAY": movement_display,
        "MOVEMENT_DATE_DIFFERS_FROM_FLIGHT_DATE": F.coalesce(
            moved.cast("date") != F.col("_flight_date"), F.lit(False)
        ),
        "RAW ATD": F.col("_atd"),
        "RAW ATA": F.col("_ata"),
        "DAT_MOVEMENT_DATETIME": none_time if is_stream else moved,
        "DAT_MOVEMENT_TIME_DISPLAY": none_text if is_stream else movement_display,
        "STREAM_MOVEMENT_DATETIME": moved if is_stream else none_time,
        "STREAM_MOVEMENT_TIME_DISPLAY": movement_display if is_stream else none_text,
        **recovery_defaults(),
    }
    return placed.select(*[columns[name].alias(name) for name in STANDARDIZED_COLUMNS])


def recovery_defaults() -> dict[str, Column]:
    none_text = F.lit(None).cast("string")
    return {
        "DAT_RECOVERY_USED": F.lit(False),
        "DAT_RECOVERY_REASON": none_text,
        "DAT_RECOVERY_SOURCE_DATE": none_text,
        "DAT_RECOVERY_SOURCE_ROW": F.lit(None).cast("bigint"),
        "ORIGINAL_DAT_DATE": none_text,
        "RECOVERED_DAT_DATE": none_text,
        "USED_FOR_RECOVERY": F.lit(False),
    }


def _explicit(c: Column, kind: str) -> Column:
    if kind == "none":
        return F.lit(False)
    return times.text_has_date(c) if kind == "text" else times.has_explicit_date(c, kind)


def _minutes(c: Column, kind: str) -> Column:
    if kind == "none":
        return F.lit(None).cast("int")
    return times.text_minutes(c) if kind == "text" else times.time_minutes(c, kind)


def _timestamp(name: str, c: Column, kind: str) -> Column:
    if kind == "none":
        return F.lit(None).cast("timestamp_ntz")
    if kind != "text":
        return times.parse_datetime(c, F.col("_flight_date"), kind)[0]
    anchored = times.at_minute(F.col("_flight_date"), F.col(f"_{name}_minutes"))
    return F.when(F.col(f"_{name}_explicit"), times.text_timestamp(c)).otherwise(anchored)


def split_excluded(standard: DataFrame, excluded: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows excluded by one predicate."""
    return standard.where(~excluded), standard.where(excluded)


def empty_text_to_blank(df: DataFrame) -> DataFrame:
    """Show NULL texts as empty strings; for result tables only."""
    texts = {name: F.coalesce(field(name), F.lit("")) for name, t in df.dtypes if t == "string"}
    return df.withColumns(texts) if texts else df


__all__ = [
    "empty_text_to_blank", "raw_value", "recovery_defaults", "split_excluded",
    "standardize_dataset",
]
