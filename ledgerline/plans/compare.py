"""The generic two-table comparison, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ledgerline.constants import FIELDS
from ledgerline.operators import compare as ops
from ledgerline.operators.occurrence import BLOCK_ROWS
from ledgerline.plans.mapping import check_keys
from ledgerline.plans.staging import TABLE, Run


@dataclass(frozen=True)
class Comparison:
    """Lazy results of one comparison; ``aligned`` holds every row of both sides once."""

    aligned: DataFrame
    comparable: tuple[str, ...]
    run: Run

    @cached_property
    def matched(self) -> DataFrame:
        return ops.matched_output(ops.matched_rows(self.aligned), self.comparable)

    @cached_property
    def differences(self) -> DataFrame:
        return ops.differences(self.matched)

    @cached_property
    def source_only(self) -> DataFrame:
        return ops.unmatched_output(ops.one_sided_rows(self.aligned, "source"), "source")

    @cached_property
    def actual_only(self) -> DataFrame:
        return ops.unmatched_output(ops.one_sided_rows(self.aligned, "actual"), "actual")

    @cached_property
    def unmatched(self) -> DataFrame:
        return self.source_only.unionByName(self.actual_only)

    @cached_property
    def summary(self) -> DataFrame:
        return ops.compare_summary(self.aligned, self.comparable)

    def summary_values(self) -> dict[str, int]:
        return self.summary.first().asDict()

    def tables(self) -> dict[str, DataFrame]:
        return {
            "summary": self.summary,
            "source_only": self.source_only,
            "actual_only": self.actual_only,
            "unmatched": self.unmatched,
            "matched": self.matched,
            "differences": self.differences,
        }

    def close(self) -> None:
        """Give back the staged tables of this run; its results cannot be used after, those of other runs can."""
        self.run.release()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables()[name]


def compare_datasets(
    source_frame: DataFrame,
    actual_frame: DataFrame,
    source_mapping: Mapping[str, str | None],
    actual_mapping: Mapping[str, str | None],
    key_fields: Iterable[str],
    allow_incomplete_keys: bool = False,
    row_col: str | None = None,
    block_rows: int = BLOCK_ROWS,
    mode: str | Run = TABLE,
) -> Comparison:
    """Pair rows by key and occurrence.

    Counting occurrences reads a side twice and every result reads the aligned rows, so
    both are kept: ``mode`` is "table" (written to the cluster's shared folder),
    "persist" or "none", or a run that others hold as well.
    """
    run = Run.of(mode)
    keys = check_keys(key_fields, source_mapping, actual_mapping)
    sides = []
    for df, mapping, side in (
        (source_frame, source_mapping, "SOURCE"), (actual_frame, actual_mapping, "ACTUAL"),
    ):
        canonical = run.stage(ops.canonicalize(df, mapping, row_col), f"canonical-{side.lower()}")
        sides.append(ops.prepare_for_matching(canonical, keys, side, allow_incomplete_keys, block_rows))
    comparable = tuple(
        f for f in FIELDS if f not in keys and source_mapping.get(f) and actual_mapping.get(f)
    )
    return Comparison(run.stage(ops.align(*sides, keys), "aligned-rows"), comparable, run)
