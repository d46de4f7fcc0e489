"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = [
    "monthly_complaint_rate", "redact_personal_data", "primary_dialog", "reconciled_answers", "token_budget_batches",
    "category_share_deltas", "time_split", "cache_misses", "nearest_neighbours",
]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@needs_tables
def test_entry(spark):
    assert sorted(entry.entry(spark).columns) == ["complaint_rate", "month", "n"]


@needs_tables
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    result = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert result.startswith("ok"), result
