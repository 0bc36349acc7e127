"""Registered queries against their check SQL on the smallest data, and properties of the registry."""

import re

import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallyloom.operators import report
from tallyloom.plans.refresh import StoredMarts, refresh
from tallyloom.session import scratch_path

CHECKED = [
    "dq03_failed_rule_names", "dq13_quarantine_events", "gld01_dim_products", "gld04_customer_rfm", "gld06_funnel_daily",
    "kpi01_monthly_summary", "kpi02_customer_health", "kpi03_funnel_weekly", "cq17_sell_through", "cq40_repurchase_gaps",
    "mv08_synonym_resolution", "tel01_flatten_conversations", "drf01_scored_proposals", "nov05_example_questions", "esc05_decide",
    "rtr18_route_decisions", "src08_upsert_keeps_status", "rpt11_daily_report", "adm04_source_share",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_check(spark, con, name):
    _, problem = difference(spark, con, name, SMALL, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert problem is None


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in entry_module.queries())


def test_refresh_writes_what_the_marts_derive(spark, marts):
    root = scratch_path(spark, "medallion")
    for name in refresh(marts.bronze_sales, marts.event_lines, root):
        stored = getattr(StoredMarts(spark, root, marts.tables), name)
        assert stored.count() == getattr(marts, name).count(), name
    stored = StoredMarts(spark, root, marts.tables)
    same = ["month", "net_revenue", "aov", "known_customers"]
    assert sorted(map(tuple, stored.monthly_summary.select(*same).collect())) == sorted(map(tuple, marts.monthly_summary.select(*same).collect()))


def test_failed_refresh_leaves_the_published_run(spark, marts):
    root = scratch_path(spark, "medallion")
    refresh(marts.bronze_sales.limit(50), marts.event_lines.limit(50), root)
    before = StoredMarts(spark, root, marts.tables)
    broken = marts.event_lines.limit(50).withColumn("value", F.raise_error(F.lit("feed is down")).cast("string"))
    with pytest.raises(Exception, match="feed is down"):
        refresh(marts.bronze_sales.limit(10), broken, root)
    after = StoredMarts(spark, root, marts.tables)
    assert after.home == before.home and sum(r.passed + r.failed for r in after.expectations.where("rule = 'has_event_id'").collect()) == 50
    refresh(marts.bronze_sales.limit(10), marts.event_lines.limit(20), root)
    assert StoredMarts(spark, root, marts.tables).home > before.home and before.quarantine_events.count() >= 0


def test_report_window_ends_now_or_at_midnight():
    from datetime import date, datetime

    day = date(2026, 7, 1)
    early = report.ReportWindow(day, datetime(2026, 7, 1, 6))
    late = report.ReportWindow(day, datetime(2026, 7, 5))
    assert early.end == datetime.fromisoformat("2026-07-01T06:00+00:00").timestamp()
    assert late.end - late.start == 86400 and late.end == datetime.fromisoformat("2026-07-02T00:00+00:00").timestamp()
