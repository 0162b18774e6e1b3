"""The best candidate of every record, without pairing up the sides of a hot key.

All lookups of a record (by movement date, by flight date, by remark and time cell) are
rows of one probe table, and a billing row is entered under each of its keys. Records and
billing rows of a key are never paired up: only the rows that can win are looked at. Within
one (status validity, special remark) class the order of preference is register
contradiction, then nearness in time, then version, message and row. The winner of a class
is therefore the nearest row of the whole class, or the nearest row with the record's
register, or the nearest row without a register; rows without a time are ranked by version,
message and row alone.

A sweep forward and one backward over the instants of a key find them for all classes together:
the billing rows of an instant are folded to one row that holds the best of every class, with any
and without a register, and the latest of each that the sweep has passed is carried along. Two more
sweeps do the same by register. Both sides are folded to the distinct times of a key before they
meet, so a key that most rows share costs as many rows as it has times, and records pick the
answer of their time up in a join.

A flight-date group mixes movement dates, and a date the record does not allow ranks
behind an allowed one. Rows of the record's own date win through the movement-date lookup,
rows special and within a day likewise, and a recovered record also asks for its recovered
date separately, under both dates; the nearest row of the group covers the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.times import format_date, minutes_apart
from ledgerline.operators.evaluate import (
    MatchRules, evaluation, findings, invalid_status, selection_order, worded,
)
from ledgerline.operators.lookup import (
    BY_FLIGHT_DATE, BY_MOVEMENT, SPECIAL, register_compatible, search_specs, time_cell,
)

BY_REMARK, BY_BOTH = "REMARK", "BOTH DATES"
GROUP = ["flight", "move", "adep", "ades", "by", "date"]
RANK = ["r_version", "r_message", "r_row"]
CARRIED = ["r_at", "r_register", "r_special", "invalid_status"]
RECORD = ["l_data", "l_row", "l_register", "l_at", "l_moved_on", "l_recovered", "l_recovered_on"]
CLASSES = [(invalid, special) for invalid in (False, True) for special in (False, True)]
TOPS = [f"top{n}" for n in range(len(CLASSES))]
NAMELESS = ""


def _entry(adep: Column, ades: Column, by: str, date: Column, *more: Column) -> Column:
    return F.struct(adep.alias("adep"), ades.alias("ades"), F.lit(by).alias("by"), date.alias("date"), *more)


def _entered(df: DataFrame, entries: Column) -> DataFrame:
    kept = [c for c in df.columns if c not in ("adep", "ades")]
    exploded = df.withColumn("_entry", F.explode(F.array_compact(entries)))
    rows = exploded.select(*kept, "_entry.*")
    return rows.where(F.col("flight").isNotNull() & F.col("move").isNotNull() & F.col("date").isNotNull())


def _both_dates(flight_date: Column, moved_on: Column) -> Column:
    return F.concat(flight_date, F.lit(" "), moved_on)


def index_entries(others: DataFrame, tolerance: float) -> DataFrame:
    """Billing rows under every key a record may ask for."""
    adep, ades, none = F.col("adep"), F.col("ades"), F.lit("")
    routed = adep.isNotNull() & ades.isNotNull()
    cell = time_cell(F.col("r_at"), tolerance).cast("string")
    return _entered(others, F.array(
        F.when(routed, _entry(adep, ades, BY_MOVEMENT, format_date(F.col("r_at")))),
        F.when(routed, _entry(adep, ades, BY_FLIGHT_DATE, F.col("r_flight_date"))),
        F.when(routed, _entry(adep, ades, BY_BOTH, _both_dates(F.col("r_flight_date"), format_date(F.col("r_at"))))),
        F.when(F.col("r_special"), _entry(none, none, BY_REMARK, cell)),
    ))


def probe_entries(records: DataFrame, tolerance: float) -> DataFrame:
    """One row per record and key it asks for, with the number of that lookup."""
    adep, ades, none = F.col("adep"), F.col("ades"), F.lit("")
    routed = adep.isNotNull() & ades.isNotNull()
    dated = F.transform(search_specs(), lambda s: F.struct(
        adep.alias("adep"), ades.alias("ades"), s["by"].alias("by"), s["date"].alias("date"),
        s["lookup"].alias("lookup"),
    ))
    again = F.col("l_recovered") & (F.col("l_recovered_on") != F.col("l_moved_on"))
    recovered = F.when(again, F.transform(F.filter(dated, lambda s: s["by"] == BY_FLIGHT_DATE), lambda s: F.struct(
        s["adep"], s["ades"], F.lit(BY_BOTH).alias("by"), _both_dates(s["date"], F.col("l_recovered_on")).alias("date"),
        s["lookup"],
    ))).otherwise(F.slice(dated, 1, 0))
    number = F.lit(SPECIAL).alias("lookup")
    near = F.array(*[
        _entry(none, none, BY_REMARK, (time_cell(F.col("l_at"), tolerance) + step).cast("string"), number)
        for step in (-1, 0, 1)
    ])
    return _entered(records, F.concat(F.when(routed, F.concat(dated, recovered)).otherwise(F.slice(dated, 1, 0)), near))


def _eligible(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Rows found by remark must be close in time and not contradict the register."""
    close = minutes_apart(F.col("r_at"), F.col("l_at")) <= tolerance
    days = F.abs(F.datediff(F.col("r_at").cast("date"), F.col("l_at").cast("date"))) <= 1
    return pairs.where((F.col("by") != BY_REMARK) | (register_compatible() & close & days))


def _folded(index: DataFrame) -> DataFrame:
    """One row for each instant and register of a group (``NAMELESS`` for none) with the best row of every class."""
    top = F.struct(*RANK, *CARRIED)
    classes = [
        F.max(F.when((F.col("invalid_status") == F.lit(invalid)) & (F.col("r_special") == F.lit(special)), top)).alias(name)
        for name, (invalid, special) in zip(TOPS, CLASSES)
    ]
    return index.groupBy(*GROUP, F.col("r_at").alias("at"), _named("r_register").alias("register")).agg(*classes)


def _named(register: str) -> Column:
    """The register as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(register)), F.lit(NAMELESS))


def _whole(folded: DataFrame) -> DataFrame:
    """One row for each instant of a group with the best row of every class, with any and without a register."""
    nameless = F.col("register") == NAMELESS
    return folded.groupBy(*GROUP, "at").agg(
        *[F.max(top).alias(f"any_{top}") for top in TOPS],
        *[F.max(F.when(nameless, F.col(top))).alias(f"none_{top}") for top in TOPS],
    )


def _swept(tops: DataFrame, probes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``_rows`` for each instant of ``probes``: of every kind the row before it, the row after it and the row without a time.

    Each direction sorts the rows as they came and gives a row of its own: what one sweep found never enters the
    sort of the other.
    """
    kinds = [c for c in tops.columns if c not in by and c != "at"]
    instants = probes.select(*by, "at").distinct().withColumn("_asks", F.lit(True))
    both = tops.withColumn("_asks", F.lit(False)).unionByName(instants, allowMissingColumns=True)
    timed = F.col("at").isNotNull()

    def passed(at: Column, *wanted: Column) -> DataFrame:
        so_far = Window.partitionBy(*by).orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = {
            f"_{n}_{kind}": F.last(F.when(of, F.col(kind)), ignorenulls=True).over(so_far)
            for n, of in enumerate(wanted) for kind in kinds
        }
        return both.withColumns(found).where("_asks").select(*by, "at", F.array_compact(F.array(*found)).alias("_rows"))

    ahead = passed(F.col("at").asc_nulls_first(), timed, ~timed)
    back = passed(F.col("at").desc_nulls_last(), timed)
    return ahead.unionByName(back).where(F.size("_rows") > 0)


def _contenders(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(record, billing row) pairs: only rows that can be the best one. Records have a time."""
    # Both sweeps read this fold; it has no filter of one of them, so its exchange serves both.
    folded = _folded(index)
    asked = probes.withColumn("at", F.col("l_at"))
    mine = asked.where(F.col("l_register").isNotNull()).withColumn("register", _named("l_register"))
    per_register = [*GROUP, "register"]
    found = asked.join(_swept(_whole(folded), asked, GROUP), [*GROUP, "at"]).unionByName(
        mine.join(_swept(folded, mine, per_register), [*per_register, "at"]).drop("register"))
    rows = found.select(*RECORD, *GROUP, "lookup", F.explode("_rows").alias("_row"))
    return rows.select(*RECORD, *GROUP, "lookup", *[F.col("_row")[c].alias(c) for c in [*RANK, *CARRIED]])


def best_choices(records: DataFrame, others: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """Chosen row and lookup (``r_row``, ``lookup``) per record.

    Only what the preference depends on travels through the join; texts are added to
    the winners alone.
    """
    tolerance = rules.tolerance_minutes
    flagged = others.withColumn("invalid_status", invalid_status(rules))
    index = index_entries(flagged, tolerance).select(*GROUP, *RANK, *CARRIED)
    probes = probe_entries(records, tolerance).select(*RECORD, *GROUP, "lookup")
    pairs = _contenders(probes, index)
    found = findings(_eligible(pairs, tolerance))
    best = F.min(F.struct(selection_order(rules).alias("order"), "r_row", "lookup")).alias("_choice")
    return found.groupBy("l_data", "l_row").agg(best).select("l_data", "l_row", "_choice.r_row", "_choice.lookup")


def best_candidates(records: DataFrame, others: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """``_best`` evaluation per record, equal to the best of all its candidate pairs."""
    choices = best_choices(records, others, rules)
    chosen = choices.join(records, ["l_data", "l_row"]).join(
        others.drop("flight", "adep", "ades", "move"), "r_row"
    )
    evaluated = worded(findings(chosen.withColumn("invalid_status", invalid_status(rules))))
    return evaluated.select("l_data", "l_row", evaluation().alias("_best"))
