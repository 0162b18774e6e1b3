"""Shape of the physical plans: no row-by-row pairing, narrow reads, pushed filters."""

import re

import pytest

from workload import reconciliation, registry

JOIN_HEAVY = ["best_candidate", "extra_rows", "not_selected", "midnight_recovery", "attach_timeless", "compare_matched",
              "compare_shared", "multiset_match", "audit_union"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOIN_HEAVY)
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(registry.QUERIES[name][0](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_listed_pairs_are_not_joined_again(spark, sf_dir):
    steps = [re.sub(r"^[\s:+*-]*(\(\d+\) )?", "", line) for line in plan(reconciliation.not_selected(spark, sf_dir)).splitlines()]
    above = steps[:next(i for i, step in enumerate(steps) if step.startswith("Union"))]
    assert {re.match(r"\w+", step).group(0) for step in above} <= {"AdaptiveSparkPlan", "Project", "Filter"}


def test_result_tables_read_only_what_they_show(spark, sf_dir):
    df = reconciliation.reconciled(spark, sf_dir).validasi.select("FLIGHT NUMBER")
    scan = plan(df)
    assert "PushedFilters" in scan and "EqualTo(STATUS,MISSING IN STREAM)" in scan
    columns = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"FLIGHT NUMBER", "STATUS", "VALIDASI"}


def test_every_query_has_sql_and_reads_tables(spark, sf_dir):
    import __spark_entry__ as entry

    from workload import registry

    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(registry.QUERIES) <= set(queries) and set(statements) <= set(queries)
    assert set(registry.QUERIES) <= set(statements) and len(registry.QUERIES) >= 80
    row = entry.entry(spark).first()
    assert row is not None


def test_results_by_name(spark, sf_dir):
    result = reconciliation.reconciled(spark, sf_dir)
    tables = result.tables()
    assert set(tables) == {
        "summary", "summary_table", "missing", "missing_billing", "missing_non_billable", "validasi", "matched",
        "need_review", "extra", "duplicates", "audit_detail", "excluded_non_billable", "dat_unique", "dat_dep",
        "dat_arr", "stream", "raw_dat_normalized", "dat_recovered",
    }
    assert result["settings"] == {
        "time_tolerance_minutes": 30, "invalid_stream_statuses": ["OTHER"],
        "treat_invalid_stream_status_as_missing": True,
    }
    counts = result.summary_values()
    assert counts["total_dat_unique"] + counts["duplicate_dat"] == counts["total_dat_combined"]
    assert result["missing_non_billable"].isEmpty()
