"""Checking source records with plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rubrica.operators import contracts, requests, rules_plan


def structural_stage(records: DataFrame) -> dict[str, DataFrame]:
    """Rule issues and roll-up, prefilled rows of invalid records, and requests for the valid ones."""
    rollup = rules_plan.plan_check_rollup(records)
    return {
        "issues": rules_plan.check_plan(records),
        "rollup": rollup,
        "prefilled": contracts.structural_rows(records, rollup),
        "requests": requests.plan_request(rules_plan.valid_records(records)),
    }
