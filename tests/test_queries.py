"""Every named query runs; a cross-section is compared with its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = (
    "dedupe_usage", "usage_identity", "upsert_usage", "usage_streaks", "event_cost", "daily_rollup", "weekly_insights", "cost_distribution", "sittings",
    "autonomous_loops", "session_rows", "extract_messages", "activity_digest", "exchanges", "bm25_messages", "build_postings", "phrase_counts", "fun_cards",
    "correlate_commits", "unlanded_attempts", "inventory_diff", "compaction_invariant", "usage_codex", "kv_to_messages", "stream_tumbling",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
