"""The refresh tests rules once and runs independent layers side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import clickstream, quality
from tallyloom.plans import refresh as job
from tallyloom.session import scratch_path

SOLD = "invoice STRING, stock_code STRING, description STRING, quantity STRING, invoice_date STRING, price STRING, customer_id STRING, country STRING, _source_file STRING"


@pytest.fixture(scope="module")
def feeds(spark):
    sold = spark.createDataFrame(
        [
            ("1", "10", "mug", "2", "2020-01-01 08:00:00", "1.50", "7", "UK", "b"),
            ("1", "10", "mug", "2", "2020-01-01 08:00:00", "1.50", "7", "UK", "a"),
            (None, "10", "mug", "n/a", "2020-01-01 08:00:00", "0", None, "UK", "a"),
            ("A3", "POST", None, "-1", "then", "x", None, None, None),
            ("C4", "10", None, "-1", "2020-01-02 08:00:00", "1.50", "7", "UK", "a"),
        ],
        SOLD,
    )
    lines = spark.createDataFrame(
        [
            ('{"event_id": "e1", "session_id": "s", "visitor_id": "v", "event_type": "view", "event_ts": "2020-01-01T08:00:00"}',),
            ('{"event_id": "e1", "session_id": "s", "visitor_id": "v", "event_type": "view", "event_ts": "2020-01-01T08:00:00"}',),
            ('{"event_id": "e2", "event_type": "hover", "event_ts": "soon", "extra": 1}',), ('{"event_id": "e3", "eve',), (None,), ("",),
        ],
        "value STRING",
    )
    return sold, lines


def test_layers_are_stored_side_by_side_and_hold_the_same_rows(spark, feeds, monkeypatch):
    seen, store = set(), job._store

    def watched(df, home, name):
        seen.add(threading.get_ident())
        return store(df, home, name)

    monkeypatch.setattr(job, "_store", watched)
    root = scratch_path(spark, "steps")
    job.refresh(*feeds, root)
    assert len(seen) > 1
    home = job.published(spark, root)
    for name, tagged in (("tagged_sales", job.sales.tagged_sales(feeds[0])), ("tagged_events", job.clickstream.tagged_events(feeds[1]))):
        stored = spark.read.schema(tagged.schema).parquet(f"{home}/{name}")
        assert stored.exceptAll(tagged).count() == 0 and tagged.exceptAll(stored).count() == 0
    got = {(r.feed, r.rule): (r.passed, r.failed) for r in spark.read.parquet(f"{home}/expectations").collect()}
    for feed, tagged, rules in (("sales", job.sales.tagged_sales(feeds[0]), quality.sales_rules()), ("events", job.clickstream.tagged_events(feeds[1]), quality.event_rules())):
        for r in quality.expectation_counts(tagged, rules).collect():
            assert got.pop((feed, r.rule)) == (r.passed, r.failed)
    assert not got


def test_a_failing_layer_fails_the_run(spark, feeds):
    root = scratch_path(spark, "steps")
    with pytest.raises(Exception):
        job.refresh(feeds[0], feeds[1].withColumn("value", F.raise_error(F.lit("broken"))), root)
    with pytest.raises(FileNotFoundError):
        job.published(spark, root)


def test_the_keys_of_a_line_are_parsed_once(feeds):
    parsed = clickstream.parse_lines(feeds[1])
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapType(StringType") == 1 or plan.count("from_json(MapType") == 1
    rescued = {r["_rescued"] for r in parsed.select("_rescued").collect()}
    assert rescued == {None, '{"extra":"1"}', '{"event_id": "e3", "eve', ""}
