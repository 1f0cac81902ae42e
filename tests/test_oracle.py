"""Registered queries against their SQL on the smallest tables. RUBRICA_ALL=1 runs every query."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = """
    empty_batches limit_per_batch find_values to_pointer pointer_index context_paths canonical_equal collapse_ws dup_interaction_ids
    missing_specs orphan_specs spec_type_mismatch single_choice_answers multi_choice_answers choice_option_rules coordinate_slots
    check_object_rules check_object_rollup census_report type_hist plan_check_rollup plan_strict coverage_rollup
    missing_minus_present plan_totals drop_metadata_issues canonical_issues dedupe_issues issue_order solution_gate
    select_repair_issue normalize_issues hygiene_summary math_roundtrip transition_stages split_lossless split_order
    check_transitions reconcile_judges judge_with_fallback reconcile_resolver choose_plan_reply resolver_contract repair_contract
    apply_replace apply_remove apply_add repair_rounds candidate_nodes plan_request snippet public_result repair_decision latest_candidate stop_reason quality_summary report_summary report_rows
""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RUBRICA_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_key_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUICK) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, _, _ = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
