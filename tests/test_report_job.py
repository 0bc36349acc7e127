import uuid
from datetime import date, datetime

import pytest
from conftest import rows

from tallyloom.operators.report import ReportWindow
from tallyloom.plans.report_job import SOURCES, DailyReport
from tallyloom.session import scratch_path
from tallyloom.sources.tables import table_from_query

DAY = ReportWindow(date(2024, 1, 20), datetime(2024, 1, 20, 18, 0, 0))  # still running: from the 19th, 18:00
NEXT = ReportWindow(date(2024, 1, 21), datetime(2024, 6, 1))


@pytest.fixture
def store(spark):
    made = []

    def put(sql):
        name = f"tl_report_{uuid.uuid4().hex}"
        table_from_query(spark.sql(sql), name, scratch_path(spark, "source"))
        made.append(name)
        return name

    yield put
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def values(df, day):
    return {r.kpi: r.value for r in df.collect() if r.report_date == day}


def job(spark, **names):
    return DailyReport(spark, scratch_path(spark, "report"), names)


def test_nothing_stored_gives_a_report_of_notes(spark):
    one = job(spark, queue="tl_no_such_table")
    missing = rows(one.run(DAY).select("kpi", "detail"))
    assert sorted(k for k, _ in missing) == sorted(k for s in SOURCES for k in s.kpis)
    assert dict(missing)["escalations_opened"] == "no table for queue"


def test_a_missing_column_costs_its_kpis_alone(spark, store):
    ledger = store("SELECT timestamp'2024-01-20 01:00:00' AS ts, 'space_glossary' AS action, 't' AS proposal_key")  # no approver
    one = job(spark, ledger=ledger)
    missing = dict(rows(one.run(DAY).select("kpi", "detail")))
    assert missing["healing_activity_total"] == "ledger lacks approver"
    got = values(one.read(), DAY.day)
    assert got["definitions_evolved"] == 1 and got["new_terms_learned"] == 1


def test_rows_are_counted_in_the_window_where_they_carry_a_time(spark, store):
    timed = store(
        "SELECT * FROM VALUES (timestamp'2024-01-19 17:59:59'), (timestamp'2024-01-19 18:00:00'), (timestamp'2024-01-20 17:59:59'), "
        "(timestamp'2024-01-20 18:00:00'), (CAST(NULL AS TIMESTAMP)) AS t(_ingested_at)"
    )
    plain = store("SELECT id FROM range(7)")
    assert values(job(spark, quarantine=timed).rows(DAY), DAY.day)["quarantine_rows_24h"] == 2
    assert values(job(spark, quarantine=plain).rows(DAY), DAY.day)["quarantine_rows_24h"] == 7
    got = values(job(spark, messages=plain).rows(DAY), DAY.day)
    assert got["corpus_size"] == 7 and got["corpus_growth_24h"] is None


def test_a_day_run_again_takes_new_values_and_leaves_other_days(spark, store):
    few, many = store("SELECT id FROM range(3)"), store("SELECT id FROM range(5)")
    one = job(spark, messages=few)
    one.run(DAY)
    one.run(NEXT)
    before = sorted(rows(one.read()), key=str)
    one.run(NEXT)
    assert sorted(rows(one.read()), key=str) == before  # the same rows, none twice
    one.names = {"messages": many}
    one.run(NEXT)
    assert values(one.read(), DAY.day)["corpus_size"] == 3
    assert values(one.read(), NEXT.day)["corpus_size"] == 5
