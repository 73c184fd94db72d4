import os

import pytest

import __spark_entry__ as entry
from tallyscope.plans.catalog import QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not mounted")
SAMPLE = (
    "arith_pairs",
    "metrics_full_long",
    "market_stats",
    "drawdown",
    "rank_by_group",
    "latest_restatement",
    "price_history",
    "build_packets",
    "universe_exclusions",
    "universe_rules",
    "audit_rows",
    "journal_sequence",
    "overlap_peak",
    "stream_family_counts",
    "stream_state",
    "stream_replay",
    "stream_task_states",
    "stream_agent_states",
    "task_problems",
    "bad_lines",
    "company_concepts",
    "fact_faults",
    "plan_levels",
    "ordered_digest",
    "entity_in_order",
    "grouped_medians",
)


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(oracles)


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"bucket", "priority_score", "screen_rank"} <= set(df.columns)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, duck, name):
    ok, note, _ = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, note
