import datetime
import json
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import clickstream, faults
from tallyloom.operators.quality import labelled, scorecard
from tallyloom.plans.marts import Marts
from tallyloom.session import scratch_path
from tallyloom.sources import warehouse as wh
from tallyloom.streaming import dedup, merged

V1 = {"event_id": "1", "session_id": "s", "visitor_id": "v", "event_type": "view", "stock_code": "p", "event_ts": "2026-06-01T08:00:00", "referrer": "direct"}
V2 = {"eventId": "2", "sessionId": "s", "visitorId": "v", "eventType": "purchase", "stockCode": "p", "eventTs": "2026-06-01T08:05:00", "referrer": "x?e=a.b@c.com", "currency": "GBP"}
V3 = {"meta": {"eventId": "3", "ts": "2026-06-01T08:06:00", "sv": 3}, "actor": {"visitorId": "v", "sessionId": "s"}, "action": {"type": "view", "sku": "p"}, "context": {"referrer": "direct"}}


@pytest.fixture(scope="module")
def lines(spark):
    texts = [json.dumps(x) for x in (V1, V1, V2, V3, {**V1, "event_id": "4", "event_type": None}, {**V1, "event_id": "5", "event_ts": "soon"}, {**V1, "event_id": "6", "extra": 1})]
    return spark.createDataFrame([(t,) for t in [*texts, texts[0][: len(texts[0]) // 2]]], "value STRING")


def test_versions_unify_and_v3_is_a_switch(lines):
    off, on = (clickstream.silver_events(clickstream.tagged_events(lines, accept_v3=a)) for a in (False, True))
    assert sorted(r.event_id for r in off.collect()) == ["1", "2", "6"]
    assert sorted(r.event_id for r in on.collect()) == ["1", "2", "3", "6"]


def test_every_line_is_kept_or_quarantined_with_a_reason(lines):
    tagged = clickstream.tagged_events(lines)
    bad = {r.event_id: list(r.quarantine_reasons) for r in clickstream.quarantine_events(tagged).collect()}
    assert bad["4"] == ["known_event_type"] and bad["5"] == ["parseable_ts"]
    assert tagged.count() == lines.count() == tagged.where("not is_quarantined").count() + tagged.where("is_quarantined").count()


def test_truncated_lines_and_unknown_keys_are_rescued(lines):
    kept = [r._rescued for r in clickstream.parse_lines(lines).where("_rescued is not null").collect()]
    assert len(kept) == 2 and '{"extra":"1"}' in kept


def test_mail_addresses_are_redacted(lines):
    got = {r.event_id: (r.pii_detected, r.referrer) for r in clickstream.silver_events(clickstream.tagged_events(lines)).collect()}
    assert got["2"] == (True, "x?e=[REDACTED]") and got["1"] == (False, "direct")


def test_bot_rule_and_conversion(spark):
    events = spark.range(0, 41).select(
        F.lit("s").alias("session_id"), F.lit("v").alias("visitor_id"), F.lit("view").alias("event_type"),
        F.timestamp_seconds(F.col("id") * 2).alias("event_ts"),
    )
    bot = clickstream.sessions(events).first()
    assert bot.is_bot and bot.duration_s == 80 and not bot.converted
    bought = events.unionByName(events.limit(1).withColumn("event_type", F.lit("purchase")))
    assert not clickstream.sessions(bought).first().is_bot
    assert clickstream.funnel_daily(clickstream.sessions(events)).count() == 0


def test_funnel_day_without_views_has_no_rate(spark):
    events = spark.createDataFrame([("s", "v", "purchase", "2026-06-01 10:00:00")], "session_id STRING, visitor_id STRING, event_type STRING, t STRING")
    day = clickstream.funnel_daily(clickstream.sessions(events.withColumn("event_ts", F.col("t").cast("timestamp")))).first()
    assert day.view_to_cart_rate is None and day.session_conversion_rate == 1.0


def test_clean_plan_injects_nothing(marts):
    clean = faults.inject(wh.flat_events(marts.tables), faults.CLEAN)
    assert faults.ground_truth(clean).count() == 0
    assert clean.count() == marts.tables("events").count()


def test_labels_match_what_the_rules_find(marts):
    leaks = scorecard(
        marts.silver_events.where("pii_detected").select("event_id"), labelled(marts.event_truth, "pii_leak"), "event_id"
    ).first()
    assert leaks.precision == 1.0 and leaks.labeled >= leaks.tp > 0
    got = clickstream.reconciliation(marts.event_truth, marts.tagged_events, marts.silver_events).first()
    assert got.quarantined >= got.labeled_malformed and got.labeled_duplicates >= got.removed > 0


def test_dedup_cuts_copies_before_the_shuffle(marts):
    plan = marts.silver_events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once per task, once after the exchange


def test_stream_equals_batch(spark):
    tables = wh.Warehouse(spark, "/root/testdata/sf0.001")
    marts = Marts(tables)
    folder, out, mark = (scratch_path(spark, n) for n in ("feed", "out", "mark"))
    marts.event_lines.write.text(folder)
    landed = dedup.run_dedup(spark, folder, out, mark)
    assert dedup.settle(spark.read.text(folder), landed).where("settled_as = 'late'").count() == 0
    assert sorted(rows(landed.select("event_id", "event_type"))) == sorted(rows(marts.silver_events.select("event_id", "event_type")))
    again = dedup.run_dedup(spark, folder, out, mark)  # nothing new arrived
    assert again.count() == landed.count()


def test_late_events_and_later_copies_are_settled(spark):
    def line(event, session, ts):
        return json.dumps({"event_id": event, "session_id": session, "visitor_id": "v", "event_type": "view", "stock_code": "1", "event_ts": ts, "referrer": "direct"})

    folder, out, mark = (scratch_path(spark, n) for n in ("feed", "out", "mark"))
    arrivals = [
        [line("a", "s1", "2026-01-10T00:00:00Z"), line("b", "s2", "2026-01-10T00:00:00Z")],
        [line("c", "s3", "2026-01-20T00:00:00Z")],
        [line("d", "s4", "2026-01-01T00:00:00Z"), line("c", "s0", "2026-01-19T23:00:00Z")],  # d is beyond the bound, c has an earlier copy
    ]
    for lines in arrivals:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)
        kept = dedup.run_dedup(spark, folder, out, mark, bound_hours=72)
    landed = spark.read.text(folder)
    settled = dedup.settle(landed, kept)
    assert {r.event_id: r.settled_as for r in settled.collect()} == {"d": "late", "c": "replaced"}
    batch = clickstream.silver_events(clickstream.tagged_events(landed))
    assert sorted(rows(dedup.settled_events(kept, settled))) == sorted(rows(batch.select(*dedup.COLUMNS)))


def test_second_run_reads_the_touched_dates_only(spark, capsys):
    def land(*events):
        lines = [(json.dumps({"event_id": e, "session_id": "s", "visitor_id": v, "event_type": "view", "event_ts": t, "referrer": r}),) for e, v, t, r in events]
        spark.createDataFrame(lines, "value STRING").coalesce(1).write.mode("append").text(folder)

    folder, out, mark = (scratch_path(spark, n) for n in ("feed", "merged", "mark"))
    table = merged.MergedEvents(spark, out, bound_days=1)
    land(("a", "v2", "2026-03-01T10:00:00", "from x@y.com"), ("b", "v", "2026-03-05T10:00:00", None), ("c", "v", "2026-03-09T10:00:00", None), ("c", "v", "2026-03-09T10:00:00", None))
    table.run(folder, mark)
    assert table.stored().count() == 3
    land(("a", "v2", "2026-03-01T10:00:00", "from x@y.com"), ("a", "v1", "2026-03-01T10:00:00", "q@z.org"), ("d", "v", "2026-03-02T10:00:00", None), ("", "v", "bad", None))
    got = {r.event_id: (r.visitor_id, r.referrer) for r in table.run(folder, mark).collect()}
    assert set(got) - {""} == {"a", "b", "c", "d"} and got["a"][0] == "v1" and "@" not in "".join(r[1] or "" for r in got.values())
    assert {r.event_id: r.merged_as for r in table.stored().where("batch = 1").collect()} == {"a": "replaced", "d": "late"}
    table.near([datetime.date(2026, 3, 1), datetime.date(2026, 3, 2)], 1).explain("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]", capsys.readouterr().out)[1]
    assert "event_date" in filters and "2026-02-28" in filters and "2026-03-05" not in filters and "2026-03-09" not in filters
    before = table.stored().count()
    table.run(folder, mark)  # nothing new
    assert table.stored().count() == before
