"""The two-sided reconciliation, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ledgerline.constants import (
    DAT_ARR, DAT_DEP, MATCHED, MISSING, NEED_REVIEW, NON_BILLABLE_TOKENS, SPECIAL_REMARK_KEYWORDS, STREAM,
)
from ledgerline.functions.remarks import code_is_excluded
from ledgerline.operators import outputs, summary as counters
from ledgerline.operators.auditcounts import audit_counts
from ledgerline.operators.best import best_candidates
from ledgerline.operators.dedup import assign_flight_instance_keys, duplicate_output, select_best
from ledgerline.operators.evaluate import MatchRules, evaluate
from ledgerline.operators.extra import extra_rows
from ledgerline.operators.keys import prepare_keys
from ledgerline.operators.lookup import (
    candidate_blocks, candidate_pairs, listed_blocks, other_side, preferred_lookup, record_side,
)
from ledgerline.operators.recovery import recover_adjacent_date_movements
from ledgerline.operators.standardize import empty_text_to_blank, split_excluded, standardize_dataset
from ledgerline.plans.mapping import detected_mapping, require_columns
from ledgerline.plans.staging import TABLE, Run


@dataclass(frozen=True)
class Reconciliation:
    """Results as DataFrames. Building one stages both standardized sides; a result table runs, and
    stages the steps it shares with others, when it is first asked for.

    ``combined`` and ``billing`` are the standardized, non-excluded sides. Results can
    be read as attributes or by the names of :meth:`tables`.
    """

    combined: DataFrame
    billing: DataFrame
    excluded_records: DataFrame
    excluded_billing: DataFrame
    rules: MatchRules
    run: Run

    # --- records ---------------------------------------------------------------
    @cached_property
    def recovered(self) -> DataFrame:
        return recover_adjacent_date_movements(self.combined, self.run)

    @cached_property
    def resolved(self) -> DataFrame:
        keyed = self.run.stage(prepare_keys(self.recovered), "keyed-records")
        return self.run.stage(select_best(assign_flight_instance_keys(keyed)), "resolved-records")

    @cached_property
    def unique(self) -> DataFrame:
        return self.resolved.where("SELECTED_RECORD_FLAG")

    @cached_property
    def duplicate_records(self) -> DataFrame:
        return self.resolved.where(~F.col("SELECTED_RECORD_FLAG")).withColumns({
            "STATUS": F.lit("DUPLICATE DAT"), "MATCH_REASON": F.col("DUPLICATE_REASON"),
        })

    # --- candidates ------------------------------------------------------------
    @cached_property
    def prepared_billing(self) -> DataFrame:
        return prepare_keys(self.billing)

    @cached_property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        return record_side(self.unique), other_side(self.prepared_billing)

    @cached_property
    def candidates(self) -> DataFrame:
        """Every evaluated candidate of every record: the audit detail, listed in full."""
        return self._evaluated(*self.sides)

    def _evaluated(self, records: DataFrame, others: DataFrame) -> DataFrame:
        pairs = candidate_pairs(records, others, self.rules.tolerance_minutes)
        return evaluate(preferred_lookup(pairs), self.rules)

    @cached_property
    def audit_counts(self) -> DataFrame:
        """How many candidates of every kind each record has: the audit without listing it."""
        return audit_counts(*self.sides, self.rules)

    @cached_property
    def best(self) -> DataFrame:
        """The selected candidate of each record."""
        return best_candidates(*self.sides, self.rules)

    @cached_property
    def decided(self) -> DataFrame:
        decided = outputs.decide(self.unique, self.best, self.rules)
        return self.run.stage(decided, "decided-records")

    # --- result tables ---------------------------------------------------------
    @cached_property
    def records(self) -> DataFrame:
        return outputs.record_results(self.decided)

    @cached_property
    def matched(self) -> DataFrame:
        return outputs.record_results(self.decided.where(F.col("STATUS") == MATCHED))

    @cached_property
    def need_review(self) -> DataFrame:
        return outputs.record_results(self.decided.where(F.col("STATUS") == NEED_REVIEW))

    @cached_property
    def missing(self) -> DataFrame:
        return outputs.record_results(self.decided.where(F.col("STATUS") == MISSING))

    @property
    def missing_billing(self) -> DataFrame:
        return self.missing

    @property
    def missing_non_billable(self) -> DataFrame:
        """Always empty: internal movements are excluded before anything else."""
        return self.missing.limit(0)

    @cached_property
    def validasi(self) -> DataFrame:
        return outputs.not_found_only(self.missing)

    @cached_property
    def extra_billing(self) -> DataFrame:
        extra = extra_rows(self.prepared_billing, *self.sides, self.rules.tolerance_minutes)
        return self.run.stage(extra, "extra-billing")

    @cached_property
    def extra(self) -> DataFrame:
        return outputs.extra_results(self.extra_billing)

    @cached_property
    def duplicates(self) -> DataFrame:
        return empty_text_to_blank(duplicate_output(self.duplicate_records))

    @cached_property
    def not_selected(self) -> DataFrame:
        records, others = self.sides
        return outputs.not_selected_results(self._evaluated(outputs.decided_side(records, self.decided), others))

    @cached_property
    def audit_detail(self) -> DataFrame:
        return outputs.audit_union(
            self.records, self.not_selected, self.extra,
            outputs.duplicate_audit_results(self.duplicate_records),
        )

    @cached_property
    def audit_blocks(self) -> DataFrame:
        """``audit_detail`` with the other candidates of a record still in blocks: small enough to be put in order."""
        records, others = self.sides
        packed = candidate_blocks(outputs.decided_side(records, self.decided), others, self.rules.tolerance_minutes)
        return outputs.audit_blocks(
            self.records, packed, self.extra, outputs.duplicate_audit_results(self.duplicate_records))

    def audit_listed(self, blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``columns`` of ``audit_detail`` from its blocks, rows in their order."""
        listed = evaluate(listed_blocks(blocks, self.rules.tolerance_minutes), self.rules)
        return outputs.audit_listed(listed, columns)

    @cached_property
    def excluded_non_billable(self) -> DataFrame:
        return outputs.excluded_output(self.excluded_records, self.excluded_billing)

    @cached_property
    def summary(self) -> DataFrame:
        return counters.summary(
            self.combined, self.decided, self.prepared_billing, self.extra_billing,
            self.duplicate_records, self.excluded_non_billable,
        )

    @cached_property
    def summary_table(self) -> DataFrame:
        return counters.summary_table(self.summary)

    def summary_values(self) -> dict[str, object]:
        """The single summary row as a dict."""
        return self.summary.first().asDict()

    @property
    def settings(self) -> dict[str, object]:
        return {
            "time_tolerance_minutes": self.rules.tolerance_minutes,
            "invalid_stream_statuses": list(self.rules.invalid_statuses),
            "treat_invalid_stream_status_as_missing": self.rules.invalid_status_is_missing,
        }

    def tables(self) -> dict[str, DataFrame]:
        side = F.col("SOURCE DATA")
        return {
            "summary": self.summary,
            "summary_table": self.summary_table,
            "missing": self.missing,
            "missing_billing": self.missing_billing,
            "missing_non_billable": self.missing_non_billable,
            "validasi": self.validasi,
            "matched": self.matched,
            "need_review": self.need_review,
            "extra": self.extra,
            "duplicates": self.duplicates,
            "audit_detail": self.audit_detail,
            "excluded_non_billable": self.excluded_non_billable,
            "dat_unique": empty_text_to_blank(self.unique),
            "dat_dep": empty_text_to_blank(self.combined.where(side == DAT_DEP)),
            "dat_arr": empty_text_to_blank(self.combined.where(side == DAT_ARR)),
            "stream": empty_text_to_blank(self.billing),
            "raw_dat_normalized": empty_text_to_blank(self.combined),
            "dat_recovered": empty_text_to_blank(self.recovered),
        }

    def close(self) -> None:
        """Give back the staged tables of this run; its results cannot be used after, those of other runs can."""
        self.run.release()

    def __getitem__(self, name: str) -> object:
        return self.settings if name == "settings" else self.tables()[name]


def reconcile_dat_vs_stream(
    dat_dep: DataFrame,
    dat_arr: DataFrame,
    stream: DataFrame,
    dep_mapping: Mapping[str, str | None] | None = None,
    arr_mapping: Mapping[str, str | None] | None = None,
    stream_mapping: Mapping[str, str | None] | None = None,
    time_tolerance_minutes: float = 30,
    invalid_stream_statuses: Iterable[str] | None = None,
    treat_invalid_stream_status_as_missing: bool = True,
    row_col: str | None = None,
    excluded_tokens: Sequence[str] = NON_BILLABLE_TOKENS,
    remark_keywords: Sequence[str] = SPECIAL_REMARK_KEYWORDS,
    mode: str | Run = TABLE,
) -> Reconciliation:
    """Reconcile departures and arrivals against the billing table.

    ``row_col`` names a source-row ordinal present in all three inputs; without it the
    scan order is numbered. The standardized sides and the resolved records feed several
    steps, so they are kept: ``mode`` is "table" (written to the cluster's shared
    folder), "persist" or "none", or a run that others hold as well.
    """
    run = Run.of(mode)
    inputs = (dat_dep, dat_arr, stream)
    given = (dep_mapping, arr_mapping, stream_mapping)
    mappings = [dict(m) if m else detected_mapping(df) for df, m in zip(inputs, given)]
    require_columns(*mappings)
    rules = MatchRules.of(
        time_tolerance_minutes, invalid_stream_statuses, treat_invalid_stream_status_as_missing
    )
    names, moves = (DAT_DEP, DAT_ARR, STREAM), ("D", "A", None)
    departures, arrivals, billing = (
        standardize_dataset(df, mapping, name, move, row_col, remark_keywords)
        for df, mapping, name, move in zip(inputs, mappings, names, moves)
    )
    excluded = code_is_excluded(F.col("FLIGHT NUMBER"), excluded_tokens)
    all_records = run.stage(departures.unionByName(arrivals), "standard-records")
    combined, excluded_records = split_excluded(all_records, excluded)
    kept_billing, excluded_billing = split_excluded(run.stage(billing, "standard-billing"), excluded)
    return Reconciliation(combined, kept_billing, excluded_records, excluded_billing, rules, run)
