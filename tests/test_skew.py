"""Hot groups against brute force: recovery, nearest lookup, best candidate, extra rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import recovery
from ledgerline.operators.auditcounts import COUNTS, audit_counts, counted
from ledgerline.operators.best import best_candidates
from ledgerline.operators.evaluate import MatchRules, best_per_record, evaluate
from ledgerline.operators.extra import looked_at
from ledgerline.operators.lookup import candidate_pairs, preferred_lookup
from ledgerline.operators.nearest import nearest
from ledgerline.plans.staging import Run

START = datetime.datetime(2026, 5, 1, 23, 0)


def minute(n):
    return START + datetime.timedelta(minutes=n)


EVENT = ("group string, is_target boolean, at timestamp_ntz, register string, version timestamp_ntz, "
         "message double, data string, row bigint")


def greedy(events):
    """Targets one by one in row order, each taking its best unused source."""
    pairs, used = set(), set()
    for t in sorted((e for e in events if e[1]), key=lambda e: e[7]):
        options = [
            s for s in events if not s[1] and s[0] == t[0] and s[2] >= t[2] and s[7] not in used
            and (t[3] is None or s[3] == t[3])
        ]
        if options:
            best = min(options, key=lambda s: (s[2] - t[2], -s[4].timestamp(), -(s[5] if s[5] is not None else -1e9), -s[7]))
            used.add(best[7])
            pairs.add((t[7], best[7]))
    return pairs


@pytest.mark.parametrize("seed,targets,sources", [(1, 40, 60), (2, 80, 25), (3, 15, 120)])
def test_recovery_choice_whole_and_in_blocks(spark, seed, targets, sources):
    rng = random.Random(seed)
    events = []
    for row in range(targets + sources):
        is_target = row < targets
        group = rng.choice(["hot", "hot", "hot", "cold1", "cold2"])
        register = rng.choice([None, None, "A", "B", "C"])
        version = None if is_target else minute(rng.randrange(3))
        message = None if is_target else rng.choice([None, 1.0, 2.0])
        events.append((group, is_target, minute(rng.randrange(30)), register, version, message, "DAT DEP", row))
    rng.shuffle(events)
    df = spark.createDataFrame(events, EVENT)
    want = greedy(events)
    plain = recovery._serve_groups(df)
    assert {(r.target_row, r.source_row) for r in plain.collect()} == want
    for block_rows in (7, 30):
        got = recovery._paired_in_blocks(df, block_rows, Run())
        assert {(r.target_row, r.source_row) for r in got.collect()} == want


def test_small_blocks_do_not_cost_a_step_each(spark, monkeypatch):
    """A group of 600 events in blocks of 5 or more: a few steps, and the same pairs."""
    rng = random.Random(9)
    events = [("hot", row < 300, minute(rng.randrange(200)), rng.choice([None, "A", "B"]), None if row < 300 else minute(0), None, "DAT DEP", row)
              for row in range(600)]
    df = spark.createDataFrame(events, EVENT)
    monkeypatch.setattr(recovery, "recovery_events", lambda _: (df.where("is_target"), df.where("NOT is_target")))
    steps = []

    class Counted(Run):
        def stage(self, df, name):
            steps.append(name)
            return super().stage(df, name)

    got = recovery.recovery_pairs(df, Counted(), block_rows=5)
    assert {(r.target_row, r.source_row) for r in got.collect()} == greedy(events)
    assert 1 < steps.count("recovery-step") <= recovery.STEPS
    assert recovery.step_rows(20, 50) == 20 and recovery.step_rows(20, 10**9) == recovery.step_rows(recovery.BLOCK_ROWS, 10**9) == recovery.BLOCK_ROWS


def test_blocks_follow_the_order_of_their_group(spark):
    rng = random.Random(5)
    events = [(rng.choice(["hot"] * 9 + ["cold"]), rng.random() < 0.5, minute(rng.randrange(9)), None, None, None, "DAT DEP", row) for row in range(300)]
    placed = recovery.in_blocks(spark.createDataFrame(events, EVENT), 40).collect()
    for group in ("hot", "cold"):
        own = sorted((r for r in placed if r.group == group), key=lambda r: (r["at"], not r.is_target, -r.row))
        assert [r.block for r in own] == [i // 40 for i in range(len(own))]


def test_only_targets_that_a_block_can_serve_are_carried(spark):
    waiting = spark.createDataFrame([("g", True, minute(0), r, None, None, "D", i) for i, r in enumerate([None, "A", "A", "B", None, "A"])], EVENT)
    sources = spark.createDataFrame([("g", False, minute(1), r, None, None, "D", 9 + i) for i, r in enumerate(["A", "C"])], EVENT)
    for salts in (1, 3):
        assert {r.row for r in recovery.carried(waiting, sources, salts).collect()} == {0, 4, 1}


def test_nearest_matches_brute_force(spark):
    rng = random.Random(7)
    refs = [(rng.choice("ab"), minute(rng.randrange(60)), i) for i in range(80)]
    probes = [(rng.choice("abc"), None if i % 9 == 0 else minute(rng.randrange(60)), i) for i in range(60)]
    got = nearest(
        spark.createDataFrame(probes, "g string, at timestamp_ntz, id int"),
        spark.createDataFrame(refs, "g string, at timestamp_ntz, n int"), ["g"], "at", ["n"],
    ).collect()
    assert len(got) == len(probes)
    for r in got:
        mine = [x for x in refs if x[0] == r.g]
        early = max(((t, n) for _, t, n in mine if r.at and t <= r.at), default=None)
        late = min(((t, -n) for _, t, n in mine if r.at and t >= r.at), default=None)
        assert (r.before and (r.before.at, r.before.n)) == early
        assert (r.after and (r.after.at, -r.after.n)) == late


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    registers = [None, "R1", "R2", "R3"]

    def day(n):
        return (START.date() + datetime.timedelta(days=n)).isoformat()

    left, right = [], []
    for row in range(120):
        at = minute(rng.randrange(0, 3000))
        recovered = rng.random() < 0.3
        left.append(("DAT DEP", row, rng.choice(["F1", "F1", "F2"]), "X", "Y", "D", rng.choice(registers), at,
                     day(rng.randrange(3)), at.date().isoformat(), recovered, day(rng.randrange(3)) if recovered else None))
    for row in range(150):
        at = None if rng.random() < 0.1 else minute(rng.randrange(0, 3000, 5))
        special = rng.random() < 0.25
        right.append((row, rng.choice(["F1", "F1", "F2"]), rng.choice(["X", "X", "Z", None]), "Y", "D", rng.choice(registers), at,
                      day(rng.randrange(3)), rng.choice(["REGULER", "REGULER", "OTHER", None]), "note", special,
                      "RTB" if special else None, rng.choice([None, minute(1), minute(2)]), rng.choice([None, 1.0, 2.0])))
    records = spark.createDataFrame(left, (
        "l_data string, l_row bigint, flight string, adep string, ades string, move string, l_register string, "
        "l_at timestamp_ntz, l_flight_date string, l_moved_on string, l_recovered boolean, l_recovered_on string"))
    others = spark.createDataFrame(right, (
        "r_row bigint, flight string, adep string, ades string, move string, r_register string, r_at timestamp_ntz, "
        "r_flight_date string, r_status string, r_remark string, r_special boolean, r_keyword string, "
        "r_version timestamp_ntz, r_message double"))
    return records, others


@pytest.mark.parametrize("block_rows", [3, 512])
def test_listed_blocks_equal_all_pairs(sides, block_rows, monkeypatch):
    """Blocks bring the pairs of the join, however many blocks a key has."""
    from ledgerline.operators import lookup

    monkeypatch.setattr(lookup, "BLOCK_ROWS", block_rows)
    shown = ["l_data", "l_row", "r_row", "r_moved", "r_register", "r_status", "r_remark", "r_keyword", "lookup", "mode", "time_difference",
             "validation_result"]

    def bag(pairs):
        return sorted(evaluate(pairs).select(*shown).collect(), key=str)

    packed = lookup.candidate_blocks(*sides, 30)
    want = bag(preferred_lookup(candidate_pairs(*sides, 30)))
    assert bag(lookup.listed_blocks(packed, 30)) == want and len(want) > 1000
    assert (packed.where(F.size("_rows") > 3).count() > 0) == (block_rows == 512) or packed.count() > len(want) / 12


def test_minutes_apart_are_exact(spark):
    from decimal import Decimal

    from ledgerline.functions.times import minutes_apart

    rng = random.Random(5)
    rows = [(datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(-10**e, 10**e)))
            for e in (3, 6, 7, 9, 12, 15, 16) for _ in range(5)] + [(datetime.datetime(2024, 1, 1), None)]
    got = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz").select("a", "b", minutes_apart(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        micros = None if r.b is None else abs((r.a - r.b) // datetime.timedelta(microseconds=1))
        assert r.m == (None if micros is None else float(Decimal(micros) / 1000000) / 60.0)


def test_best_candidate_equals_the_best_of_all_pairs(sides):
    rules = MatchRules.of(30)

    def choices(best):
        return {(r.l_data, r.l_row): (r.b.r_row, r.b["mode"], r.b.date_used, r.b.validation_result)
                for r in best.withColumnRenamed("_best", "b").collect()}

    every = choices(best_per_record(evaluate(candidate_pairs(*sides, 30), rules), rules))
    assert len(every) > 100
    assert choices(best_candidates(*sides, rules)) == every


def test_no_sweep_sorts_what_another_found(sides):
    plan = best_candidates(*sides)._jdf.queryExecution().executedPlan().toString()
    steps = [line.lstrip(" :+-").split("(")[0].split(" ")[0] for line in plan.splitlines()]
    below = {i: next(s for s in steps[i + 1:] if s not in ("Project", "Filter")) for i, s in enumerate(steps) if s == "Sort"}
    assert steps.count("Window") >= 4
    assert "Window" not in below.values()


def test_best_of_registers_missing_and_empty(spark):
    """A row without a register, one with an empty register and one with a register are three kinds of rows."""
    lefts = [("DAT DEP", n, "F1", "X", "Y", "D", register, minute(60), "2026-05-01", minute(60).date().isoformat(), False, None)
             for n, register in enumerate((None, "", "R1"))]
    rights = [(n, "F1", "X", "Y", "D", register, minute(60 + n), minute(60).date().isoformat(), "REGULER", "", False, None, None, None)
              for n, register in enumerate(("R2", "", None, "R1"))]
    records = spark.createDataFrame(lefts, (
        "l_data string, l_row bigint, flight string, adep string, ades string, move string, l_register string, "
        "l_at timestamp_ntz, l_flight_date string, l_moved_on string, l_recovered boolean, l_recovered_on string"))
    others = spark.createDataFrame(rights, (
        "r_row bigint, flight string, adep string, ades string, move string, r_register string, r_at timestamp_ntz, "
        "r_flight_date string, r_status string, r_remark string, r_special boolean, r_keyword string, "
        "r_version timestamp_ntz, r_message double"))
    rules = MatchRules.of(30)
    every = best_per_record(evaluate(candidate_pairs(records, others, 30), rules), rules)
    chosen = {r.l_row: r.b.r_row for r in best_candidates(records, others, rules).withColumnRenamed("_best", "b").collect()}
    assert chosen == {r.l_row: r.b.r_row for r in every.withColumnRenamed("_best", "b").collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("rules", [MatchRules.of(30), MatchRules.of(45, ["REGULER"]), MatchRules.of(7.5, None, False)])
def test_audit_counts_equal_those_of_all_pairs(sides, rules):
    pairs = evaluate(preferred_lookup(candidate_pairs(*sides, rules.tolerance_minutes)), rules)
    late = F.col("time_difference")
    kind = (
        F.when(F.col("r_special"), "special").when(F.col("invalid_status"), "invalid_status").when(F.col("r_at").isNull(), "no_time")
        .when(F.col("date_mismatch"), "wrong_date").when((late <= rules.tolerance_minutes) & ~F.col("register_mismatch"), "matched")
        .when(late <= rules.tolerance_minutes, "register_mismatch").when(late <= 120, "late").otherwise("far"))
    listed = pairs.withColumn("kind", kind).groupBy("l_data", "l_row").pivot("kind", list(COUNTS[1:])).count().fillna(0)
    want = {(r.l_data, r.l_row): tuple(r[c] for c in COUNTS[1:]) for r in listed.collect()}
    got = audit_counts(*sides, rules).collect()
    assert len(got) == sides[0].count() and all(r.candidates == sum(r[c] for c in COUNTS[1:]) for r in got)
    assert {(r.l_data, r.l_row): tuple(r[c] for c in COUNTS[1:]) for r in got if r.candidates} == want
    assert len({k for counts in want.values() for k, n in zip(COUNTS[1:], counts) if n}) >= 7


def test_counted_between_bounds(spark):
    rng = random.Random(3)
    refs = [(rng.choice("ab"), minute(rng.randrange(50)), rng.randint(1, 3)) for _ in range(60)]
    asked = [(rng.choice("abc"), minute(a), minute(a + rng.randrange(20))) for a in rng.choices(range(50), k=40)]
    got = counted(spark.createDataFrame(asked + asked[:5], "g string, lo timestamp_ntz, hi timestamp_ntz"),
                  spark.createDataFrame(refs, "g string, at timestamp_ntz, n long"), ["g"]).collect()
    assert {(r.g, r.lo, r.hi): r.n for r in got} == {a: sum(n for g, t, n in refs if g == a[0] and a[1] <= t <= a[2]) for a in asked}


def test_looked_at_equals_the_rows_of_all_pairs(sides):
    pairs = {r.r_row for r in candidate_pairs(*sides, 30).select("r_row").distinct().collect()}
    assert {r.r_row for r in looked_at(*sides, 30).collect()} == pairs
    assert 0 < len(pairs) < 150


def test_recovery_in_one_and_in_many_blocks(spark):
    """Pairs do not depend on how many blocks a group has."""
    from ledgerline.plans.reconcile import reconcile_dat_vs_stream

    rows = []
    for i in range(60):
        target = i % 2 == 0
        rows.append(("GA1", "A", "B", "2026-05-01" if target else "2026-05-02", "" if i % 4 else "2310",
                     "" if target else f"00:{i:02d}", "PK1" if i % 3 == 0 else "", i + 2))
    dep = spark.createDataFrame(
        rows, "callsign string, adep string, ades string, eobd string, eobt string, atd string, register string, line int")
    empty = dep.limit(0)
    stream = spark.createDataFrame([], (
        "`DATE OF FLIGHT` string, `FLIGHT NUMBER` string, AERODROME string, `TO FROM` string, `D/A/L/O` string, line int"))
    combined = reconcile_dat_vs_stream(dep, empty, stream, row_col="line").combined

    def pairs(**options):
        return {(r.target_row, r.source_row) for r in recovery.recovery_pairs(combined, **options).collect()}

    plain = pairs()
    assert 10 < len(plain) <= 30
    assert pairs(block_rows=5) == plain == pairs(mode="none") == pairs(mode="none", block_rows=20)
    filled = recovery.recover_adjacent_date_movements(combined)
    assert filled.where(F.col("DAT_RECOVERY_USED")).count() == filled.where("USED_FOR_RECOVERY").count() == len(plain)
