"""Keyed multiset diff of two tables with field-level differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.constants import FIELD_LABELS, FIELDS
from ledgerline.functions.text import as_text, blank, field, kind_of
from ledgerline.functions.values import content, displayed, normalized
from ledgerline.operators.keys import all_present
from ledgerline.operators.occurrence import BLOCK_ROWS, occurrence_number
from ledgerline.sources.rows import with_row_numbers

# fixed values: wording of the diff tables
SAME, DIFFERENT = "Sama", "Ada Perbedaan"
SOURCE_ORIGIN, ACTUAL_ORIGIN = "Data Sumber", "Data Aktual"
SOURCE_ONLY_NOTE = "Hanya ada di Data Sumber; tidak ditemukan di Data Aktual"
ACTUAL_ONLY_NOTE = "Hanya ada di Data Aktual; tidak ditemukan di Data Sumber"
ROW = "__row"


def canonicalize(df: DataFrame, mapping: Mapping[str, str | None], row_col: str | None = None) -> DataFrame:
    """Project to the 18 canonical display texts and the source-row ordinal."""
    if row_col is None:
        row_col = ROW
        df = with_row_numbers(df, ROW)
    mapped = {f: mapping[f] for f in FIELDS if mapping.get(f) in df.columns}
    kinds = {f: kind_of(df.schema[c].dataType) for f, c in mapped.items()}
    cells = df.select(
        field(row_col).cast("bigint").alias(ROW),
        *[content(as_text(field(c), kinds[f])).alias(f) for f, c in mapped.items()],
        *[field(c).alias(f"_raw_{f}") for f, c in mapped.items() if kinds[f] != "text"],
    )

    def original(f: str) -> Column:
        return F.col(f) if kinds[f] == "text" else F.col(f"_raw_{f}")

    return cells.select(
        *[
            (displayed(original(f), F.col(f), f, kinds[f]) if f in mapped else F.lit(None).cast("string")).alias(f)
            for f in FIELDS
        ],
        ROW,
    )


def comparison_value(column: str, name: str) -> Column:
    """Comparison form of a canonical column: its text is clean and its dates are ISO."""
    shown = F.col(column)
    return shown if name == "eobd" else normalized(shown, shown, name)


def prepare_for_matching(
    canonical: DataFrame, keys: Sequence[str], side: str, allow_incomplete_keys: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add normalized keys, completeness and the occurrence inside the key.

    ``_scope`` and ``occurrence`` make the pairing id: complete keys (or all, if
    incomplete ones may match) share scope 0 and count occurrences; an incomplete row
    keeps to its own side under its own row number, so blanks neither meet nor pile up.
    """
    names = [f"key_{k}" for k in keys]
    keyed = canonical.withColumns({n: comparison_value(k, k) for n, k in zip(names, keys)})
    keyed = keyed.withColumn("complete_key", all_present([F.col(n) for n in names]))
    counted = occurrence_number(keyed, names, [ROW], block=F.floor(F.col(ROW) / block_rows))
    pairs_up = F.lit(True) if allow_incomplete_keys else F.col("complete_key")
    own_scope = 1 if side == "SOURCE" else 2
    return counted.withColumns({
        "_scope": F.when(pairs_up, 0).otherwise(own_scope),
        "occurrence": F.when(pairs_up, F.col("occurrence")).otherwise(F.col(ROW)),
    })


def align(source: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One full outer equi-join on key, occurrence and scope: every row exactly once.

    Columns are prefixed ``source_`` / ``actual_``. The occurrence in the key spreads a
    hot key over the cluster.
    """
    names = [f"key_{k}" for k in keys]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        ids = [F.coalesce(F.col(n), F.lit("")).alias(f"_{n}") for n in names]
        rest = [F.col(c).alias(f"{prefix}_{c}") for c in [*FIELDS, ROW, "complete_key"]]
        return df.select(*ids, "_scope", "occurrence", *rest)

    return side(source, "source").join(
        side(actual, "actual"), [*[f"_{n}" for n in names], "_scope", "occurrence"], "full_outer"
    )


def shared_rows(prepared: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``prepared`` whose key and occurrence the other prepared side has as well, as they are."""
    names = [f"key_{k}" for k in keys]
    ids = other.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_scope").alias("_other"), F.col("occurrence").alias("_nth"))
    same = (F.col("_scope") == F.col("_other")) & (F.col("occurrence") == F.col("_nth"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return prepared.join(ids, same, "left_semi")


def matched_rows(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.col(f"source_{ROW}").isNotNull() & F.col(f"actual_{ROW}").isNotNull())


def one_sided_rows(aligned: DataFrame, side: str) -> DataFrame:
    other = "actual" if side == "source" else "source"
    return aligned.where(F.col(f"{side}_{ROW}").isNotNull() & F.col(f"{other}_{ROW}").isNull())


def matched_output(matches: DataFrame, comparable: Sequence[str]) -> DataFrame:
    """Pairs side by side with the labels of the fields whose normalized values differ."""
    normal = matches.withColumns({
        f"_{side}_{f}": comparison_value(f"{side}_{f}", f)
        for f in comparable for side in ("source", "actual")
    })
    unequal = [
        F.when(~F.col(f"_source_{f}").eqNullSafe(F.col(f"_actual_{f}")), F.lit(FIELD_LABELS[f]))
        for f in comparable
    ]
    different = normal.withColumn("_different", F.concat_ws(", ", *unequal) if unequal else F.lit(""))
    return different.select(
        F.when(F.col("_different") == "", SAME).otherwise(DIFFERENT).alias("Status Perbandingan"),
        F.col("_different").alias("Field Berbeda"),
        F.col(f"source_{ROW}").alias("Baris Sumber"),
        F.col(f"actual_{ROW}").alias("Baris Aktual"),
        *[
            blank(F.col(f"{side}_{f}")).alias(f"{label} ({title})")
            for f, label in FIELD_LABELS.items()
            for side, title in (("source", "Sumber"), ("actual", "Aktual"))
        ],
    )


def unmatched_output(rows: DataFrame, side: str) -> DataFrame:
    origin, note = (
        (SOURCE_ORIGIN, SOURCE_ONLY_NOTE) if side == "source" else (ACTUAL_ORIGIN, ACTUAL_ONLY_NOTE)
    )
    return rows.select(
        F.lit(note).alias("Keterangan"), F.lit(origin).alias("Asal Data"),
        F.col(f"{side}_{ROW}").alias("Baris Asli"),
        *[blank(F.col(f"{side}_{f}")).alias(label) for f, label in FIELD_LABELS.items()],
    )


def differences(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("Status Perbandingan") == DIFFERENT)


def compare_summary(aligned: DataFrame, comparable: Sequence[str]) -> DataFrame:
    """The eight counters in one pass over the aligned rows."""
    has_source, has_actual = F.col(f"source_{ROW}").isNotNull(), F.col(f"actual_{ROW}").isNotNull()
    pairs = aligned.withColumns({
        f"_{side}_{f}": comparison_value(f"{side}_{f}", f)
        for f in comparable for side in ("source", "actual")
    })
    differs = reduce(
        Column.__or__,
        [~F.col(f"_source_{f}").eqNullSafe(F.col(f"_actual_{f}")) for f in comparable], F.lit(False),
    )
    return pairs.agg(
        F.count_if(has_source).alias("source_total"),
        F.count_if(has_actual).alias("actual_total"),
        F.count_if(has_source & has_actual).alias("matched_total"),
        F.count_if(has_source & ~has_actual).alias("source_only_total"),
        F.count_if(has_actual & ~has_source).alias("actual_only_total"),
        F.count_if(has_source & has_actual & differs).alias("differences_total"),
        F.count_if(~F.col("source_complete_key")).alias("source_incomplete_keys"),
        F.count_if(~F.col("actual_complete_key")).alias("actual_incomplete_keys"),
    )
