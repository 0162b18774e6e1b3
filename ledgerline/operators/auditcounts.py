"""How many candidates of every kind a record has, without listing the pairs.

What a candidate is to a record follows from its remark and status, its date, the two registers and how far its time lies
from two limits. Within one route, movement date and register the number of rows that are near enough is a difference of
running counts over the sorted times, so a record's counts are sums of differences. The lookups overlap in a known way
(:func:`ledgerline.operators.lookup.preferred_lookup`); rows that two of them find are taken off once, by the counts of
both dates together.

Billing rows are folded to the distinct times of a key and records to the distinct bounds they ask about before the two
meet: a flight that most rows share costs as many rows as it has times. The rows of the result are the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.dates import iso_day
from ledgerline.functions.times import format_date
from ledgerline.operators.evaluate import MatchRules, invalid_status

ANY = "*"
ROUTE = ["flight", "move", "adep", "ades"]
DATES = ["moved", "flown"]  # movement date and flight date; ANY for all, "" for a missing flight date
KINDS = ("special", "invalid_status", "no_time", "plain")
COUNTS = ("candidates", "special", "invalid_status", "no_time", "wrong_date", "matched", "register_mismatch", "late", "far")
RECORD = ["l_data", "l_row"]


def _kind(special: Column, invalid: Column, at: Column) -> Column:
    return (F.when(special, KINDS[0]).when(invalid, KINDS[1]).when(at.isNull(), KINDS[2]).otherwise(KINDS[3]))


def _flagged(others: DataFrame, rules: MatchRules) -> DataFrame:
    return others.withColumn("invalid_status", invalid_status(rules)).select(
        "*", _kind(F.col("r_special"), F.col("invalid_status"), F.col("r_at")).alias("kind"),
        F.col("r_at").alias("at"), format_date(F.col("r_at")).alias("moved_on"), F.coalesce("r_flight_date", F.lit("")).alias("flown_on"),
        F.coalesce("r_register", F.lit("")).alias("register"))


def _routed(df: DataFrame) -> DataFrame:
    for key in ROUTE:
        df = df.where(F.col(key).isNotNull())
    return df


def _term(sign: int | Column, moved: Column, flown: Column) -> Column:
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    return F.struct(sign.cast("int").alias("sign"), moved.alias("moved"), flown.alias("flown"))


def _terms(own_dates_only: bool) -> Column:
    """The signed groups (movement date, flight date) whose counts add up to a record's candidates by date; with
    ``own_dates_only`` to those among them that have a movement date the record allows."""
    day = F.col("l_moved_on")
    flown, again = F.col("l_flight_date"), F.when(F.col("l_recovered"), F.col("l_recovered_on"))
    flown_key, other = F.coalesce(flown, F.lit("")), again.isNotNull() & ~again.eqNullSafe(flown)
    moved = iso_day(day)
    terms = []
    any_date = F.lit(ANY)

    def lookup(when: Column, plus: tuple[Column, Column], minus: Sequence[tuple[Column, Column, Column]]) -> None:
        terms.append(F.when(when, _term(1, *plus)))
        terms.extend(F.when(when & also, _term(-1, m, f)) for also, m, f in minus)

    always = F.lit(True)
    if not own_dates_only:
        lookup(day.isNotNull(), (day, any_date), [])
        lookup(flown.isNotNull(), (any_date, flown), [(always, day, flown)])
        lookup(other, (any_date, again), [(always, day, again)])
        for step in (-1, 1):
            beside = F.date_add(moved, step).cast("string")
            lookup(beside.isNotNull(), (beside, any_date), [(always, beside, flown_key), (other, beside, again)])
    else:
        lookup(day.isNotNull(), (day, any_date), [])
        recovered = again.isNotNull() & (again != day)  # rows of the recovered date are allowed as well
        lookup(recovered & flown.isNotNull(), (again, flown), [])
        lookup(recovered & other, (again, again), [])
        near = recovered & (F.abs(F.datediff(iso_day(again), moved)) == 1)
        lookup(near, (again, any_date), [(always, again, flown_key), (other, again, again)])
    return F.array_compact(F.array(*terms))


def _dated(rows: DataFrame) -> DataFrame:
    """Rows under their movement date, their flight date and both."""
    moved, flown, any_date = F.col("moved_on"), F.col("flown_on"), F.lit(ANY)
    keys = F.array_compact(F.array(
        F.when(moved.isNotNull(), F.struct(moved.alias("moved"), any_date.alias("flown"))),
        F.when(flown != "", F.struct(any_date.alias("moved"), flown.alias("flown"))),
        F.when(moved.isNotNull(), F.struct(moved.alias("moved"), flown.alias("flown")))))
    return rows.withColumn("_key", F.explode(keys)).select("*", "_key.moved", "_key.flown").drop("_key")


def counts_by_date(records: DataFrame, flagged: DataFrame) -> DataFrame:
    """l_data, l_row and per kind the number of rows that the date lookups find; ``allowed``: plain ones of an allowed date."""
    groups = _dated(_routed(flagged)).groupBy(*ROUTE, *DATES).agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for kind in KINDS])
    asked = _routed(records)
    terms = F.concat(_tagged(False), _tagged(True))
    probes = asked.select(*RECORD, *ROUTE, F.explode(terms).alias("_t")).select(*RECORD, *ROUTE, "_t.*")
    met = probes.join(groups, [*ROUTE, *DATES])
    every = ~F.col("own")
    return met.groupBy(*RECORD).agg(
        *[F.sum(F.when(every, F.col("sign") * F.col(kind))).alias(kind) for kind in KINDS],
        F.sum(F.when(F.col("own"), F.col("sign") * F.col("plain"))).alias("allowed"))


def _tagged(own: bool) -> Column:
    return F.transform(_terms(own), lambda t: F.struct(
        t["sign"].alias("sign"), t["moved"].alias("moved"), t["flown"].alias("flown"), F.lit(own).alias("own")))


def counted(probes: DataFrame, references: DataFrame, by: Sequence[str]) -> DataFrame:
    """``n`` for every distinct ``by``, ``lo``, ``hi`` of ``probes``: the sum of ``n`` of the references with
    ``lo <= at <= hi``. One sorted pass over references and bounds; the cost is linear in both."""
    bounds = probes.select(*by, "lo", "hi").distinct()
    edges = bounds.select(*by, "lo", "hi", F.explode(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")),
        F.struct(F.col("hi").alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))).alias("_e")).select(
        *by, "lo", "hi", "_e.*", F.lit(0).cast("long").alias("n"))
    rows = references.select(*by, "at", F.lit(1).alias("turn"), "n").unionByName(edges, allowMissingColumns=True)
    sofar = Window.partitionBy(*by).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_sum", F.sum("n").over(sofar)).where(F.col("turn") != 1).groupBy(*by, "lo", "hi").agg(
        F.sum(F.col("sign") * F.col("_sum")).alias("n"))


def _around(minutes: float) -> tuple[Column, Column]:
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 60).cast("decimal(18,6)"))
    return F.col("l_at") - span, F.col("l_at") + span


SWEEP = ["flight", "move", "adep", "ades", "moved", "flown", "slot", "group"]


def near_counts(records: DataFrame, flagged: DataFrame, rules: MatchRules) -> DataFrame:
    """l_data, l_row and the numbers of rows near in time: ``close`` (within the tolerance) by any, no and the own
    register, ``reach`` (within the review limit), and ``band``: special rows that the remark finds and no date does."""
    limit, tolerance = max(rules.review_limit_minutes, rules.tolerance_minutes), rules.tolerance_minutes
    mine, one = F.col("l_register"), F.lit(1)
    own_route = (F.col("adep"), F.col("ades"))
    slots = F.when(mine.isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.lit(ANY), F.lit(""), mine))
    names = F.when(mine.isNull(), F.array(F.lit("close"))).otherwise(F.array(F.lit("close"), F.lit("close_none"), F.lit("close_own")))
    # Plain rows of an allowed date, by the route and the dates of each signed group.
    plain = _routed(records).select("*", F.explode(_terms(True)).alias("_t"))
    plain = plain.select("*", F.explode(F.concat(
        F.transform(F.arrays_zip(slots.alias("slot"), names.alias("what")), lambda s: F.struct(s["what"].alias("what"), s["slot"].alias("slot"), F.lit(False).alias("far"))),
        F.array(F.struct(F.lit("reach").alias("what"), F.lit(ANY).alias("slot"), F.lit(True).alias("far"))))).alias("_s"))
    near, far = _around(tolerance), _around(limit)
    plain = plain.select(
        *RECORD, "flight", "move", "adep", "ades", F.col("_t.moved").alias("moved"), F.col("_t.flown").alias("flown"),
        F.col("_s.slot").alias("slot"), F.lit("plain").alias("group"), F.col("_s.what").alias("what"), F.col("_t.sign").alias("sign"),
        F.when(F.col("_s.far"), far[0]).otherwise(near[0]).alias("lo"), F.when(F.col("_s.far"), far[1]).otherwise(near[1]).alias("hi"))
    # Special rows of the flight whatever their route, without those of the record's own route, day by day.
    days = F.array_distinct(F.array(format_date(near[0]), format_date(near[1])))
    fit = F.when(mine.isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.lit(""), mine))
    ways = F.array_compact(F.array(
        F.struct(one.alias("sign"), F.lit(ANY).alias("adep"), F.lit(ANY).alias("ades")),
        F.when(F.col("adep").isNotNull() & F.col("ades").isNotNull(), F.struct((-one).alias("sign"), own_route[0].alias("adep"), own_route[1].alias("ades")))))
    band = records.where(F.col("flight").isNotNull() & F.col("move").isNotNull()).select(
        *RECORD, "flight", "move", "l_at", F.explode(days).alias("moved"), fit.alias("_fit"), ways.alias("_ways"))
    band = band.select("*", F.explode("_fit").alias("slot")).select("*", F.explode("_ways").alias("_w")).select(
        *RECORD, "flight", "move", "_w.adep", "_w.ades", "moved", F.lit(ANY).alias("flown"), "slot", F.lit("special").alias("group"),
        F.lit("band").alias("what"), F.col("_w.sign").alias("sign"), near[0].alias("lo"), near[1].alias("hi"))
    probes = plain.unionByName(band)

    timed = flagged.where(F.col("at").isNotNull())
    by_route = _dated(_routed(timed.where(F.col("kind") == "plain"))).where(F.col("moved") != ANY).withColumn("group", F.lit("plain"))
    every = F.array_compact(F.array(
        F.struct(F.lit(ANY).alias("adep"), F.lit(ANY).alias("ades")),
        F.when(F.col("adep").isNotNull() & F.col("ades").isNotNull(), F.struct("adep", "ades"))))
    by_remark = timed.where((F.col("kind") == "special") & F.col("flight").isNotNull() & F.col("move").isNotNull()).withColumn(
        "_w", F.explode(every)).withColumns({
            "adep": F.col("_w.adep"), "ades": F.col("_w.ades"), "moved": F.col("moved_on"), "flown": F.lit(ANY), "group": F.lit("special")})
    columns = [c for c in SWEEP if c != "slot"]
    references = by_route.select(*columns, "register", "at").unionByName(by_remark.select(*columns, "register", "at")).withColumn(
        "slot", F.explode(F.array(F.lit(ANY), F.col("register")))).groupBy(*SWEEP, "at").agg(F.count(F.lit(1)).alias("n"))
    asked = references.join(probes.select(*SWEEP).distinct(), SWEEP, "left_semi")
    answers = counted(probes, asked, SWEEP)
    met = probes.join(answers, [*SWEEP, "lo", "hi"])
    return met.groupBy(*RECORD).agg(*[
        F.sum(F.when(F.col("what") == what, F.col("sign") * F.col("n"))).alias(what)
        for what in ("close", "close_none", "close_own", "reach", "band")])


def audit_counts(records: DataFrame, others: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """l_data, l_row and the numbers of :data:`COUNTS`: a row for every record of ``records`` (those with a time).

    ``candidates`` is the sum of the others, each candidate counted under the first that holds: special remark, invalid
    status, no time, a date the record does not allow, within the tolerance with and without a contradicting register,
    within the review limit, beyond it.
    """
    flagged = _flagged(others, rules)
    dated = counts_by_date(records, flagged)
    near = near_counts(records, flagged, rules)
    joined = records.select(*RECORD, "l_register").join(dated, RECORD, "left").join(near, RECORD, "left").fillna(0)
    mismatch = F.when(F.col("l_register").isNull(), F.lit(0)).otherwise(F.col("close") - F.col("close_none") - F.col("close_own"))
    parts = {
        "special": F.col("special") + F.col("band"), "invalid_status": F.col("invalid_status"), "no_time": F.col("no_time"),
        "wrong_date": F.col("plain") - F.col("allowed"), "matched": F.col("close") - mismatch, "register_mismatch": mismatch,
        "late": F.col("reach") - F.col("close"), "far": F.col("allowed") - F.col("reach"),
    }
    total = sum(list(parts.values())[1:], parts["special"])
    return joined.select(*RECORD, total.cast("long").alias("candidates"), *[c.cast("long").alias(n) for n, c in parts.items()])
