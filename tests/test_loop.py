import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import drift, escalation, novelty, quality, telemetry
from tallyloom.plans.learning_loop import LearningLoop
from tallyloom.session import scratch_path
from tallyloom.sources import tables

DAY = 86400
NOW = 1_000 * DAY
MESSAGE = "content STRING, user_id STRING, role STRING, ts DOUBLE, message_id STRING, feedback_rating STRING"


def said(spark, *items):
    return spark.createDataFrame([(c, u, r, float(ts), f"m{i}", "NEGATIVE") for i, (c, u, r, ts) in enumerate(items)], MESSAGE)


@pytest.mark.parametrize(
    "text, want",
    [
        ("'liquid assets' means liquid_cash_assets", ("liquid assets", "liquid_cash_assets")),
        ("GMV means gross_revenue in gold_daily_revenue", ("gmv", "gross_revenue")),
        ("VIPs refers to `gold_customer_rfm.monetary`", ("vips", "gold_customer_rfm.monetary")),
        ("turnover should map to net_revenue.", ("turnover", "net_revenue.")),  # a full stop stays
        ("bounce rate is on gold_sessions.n_views = 1", ("bounce rate", "gold_sessions.n_views")),
        ("aov means AOV", None),
        ("show me sales by region", None),
        ("", None),
        (None, None),
    ],
)
def test_correction_parse(spark, text, want):
    got = rows(telemetry.corrections(said(spark, (text, "u", "pm", 0))).select("term", "entity"))
    assert got == ([want] if want else [])


def scored(spark, *items, **kw):
    c = telemetry.corrections(said(spark, *items))
    return {(r.term, r.entity): r for r in drift.score(c, NOW, **kw).collect()}


def test_two_users_beat_one_loud_user(spark):
    loud = scored(spark, *[("gmv means a.b", "u1", "finance", NOW)] * 5)[("gmv", "a.b")]
    two = scored(spark, ("gmv means a.b", "u1", "finance", NOW), ("gmv means a.b", "u2", "finance", NOW))[("gmv", "a.b")]
    assert two.confidence > loud.confidence and loud.distinct_users == 1 and loud.evidence_count == 5


def test_confidence_halves_its_weight_every_week(spark):
    old = scored(spark, ("gmv means a.b", "u1", "pm", NOW - 7 * DAY), ("gmv means a.b", "u2", "nobody", NOW - 14 * DAY))
    raw = 0.9 * 0.5 + 0.5 * 0.25
    assert old[("gmv", "a.b")].confidence == pytest.approx(round(1 - math.exp(-raw / 2), 4))
    fresh = scored(spark, ("gmv means a.b", "u1", "pm", 0), ("gmv means a.b", "u2", "pm", 0))  # no time counts as now
    assert fresh[("gmv", "a.b")].confidence == pytest.approx(round(1 - math.exp(-0.9), 4))


def test_conflicts_ignore_who_said_it(spark):
    c = telemetry.corrections(said(spark, ("sales means a.x", "u1", "pm", 0), ("sales means b.y", "u1", "pm", 0), ("gmv means a.b", "u2", "pm", 0)))
    assert sorted(rows(drift.conflicts(c))) == [("sales", "a.x", 1, 2), ("sales", "b.y", 1, 2)]
    assert rows(drift.without_conflicts(drift.score(c, NOW), drift.conflicts(c)).select("term")) == [("gmv",)]


def test_triage_needs_confidence_and_users(spark):
    p = spark.createDataFrame([("a", "t.c", 0.75, 2), ("b", "t.c", 0.9, 1), ("c", "t.c", 0.74, 5)], "term STRING, entity STRING, confidence DOUBLE, distinct_users BIGINT")
    assert {r.term: r.lane for r in drift.triage(p).collect()} == {"a": "auto", "b": "review", "c": "review"}


def test_entity_resolution(spark):
    names = ["col", "t.col", "s.t.col", "c.s.t.col", "`t`.`col`"]
    p = spark.createDataFrame([(n,) for n in names], "entity STRING")
    got = {r.entity: (r.fq_table, r.column_name) for r in drift.resolved(p, "main.gold").collect()}
    assert got == {
        "col": (None, None), "t.col": ("main.gold.t", "col"), "s.t.col": ("main.s.t", "col"),
        "c.s.t.col": ("c.s.t", "col"), "`t`.`col`": ("main.gold.t", "col"),
    }


def test_statements_escape_quotes(spark):
    p = spark.createDataFrame([("it's", "t.c", 0.9, 3)], "term STRING, entity STRING, confidence DOUBLE, distinct_users BIGINT")
    got = {r.action: r.payload for r in drift.healing_plan(p, "main.gold", dry_run=False).collect()}
    assert "''it''s''" in got["uc_comment"] and "= 'its'" in got["uc_tag"]


# ---- novelty -------------------------------------------------------------------------------------


def asked(spark, *items):
    return spark.createDataFrame([(q, u, r) for q, u, r in items], "content STRING, user_id STRING, feedback_rating STRING")


def test_pairs_hide_their_words_and_order_is_fixed(spark):
    q = asked(
        spark, ("why is perfect order down", "u1", "NEGATIVE"), ("show perfect order by region", "u2", "negative"),
        ("what is our gross margin", "u1", "-1"), ("gross margin please", "u1", "bad"), ("perfect weather", "u3", "POSITIVE"),
    )
    failed = novelty.failed_questions(q, "content", ["feedback_rating"])
    got = rows(novelty.novel_terms(failed, "content", "user_id").select("term", "occurrences", "distinct_users"))
    assert got == [("perfect order", 2, 2), ("gross margin", 2, 1)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("net revenue by country", set()),  # governed pair and word
        ("how many sales in 2011", set()),
        ("which countries", set()),
        ("our margin", {"margin"}),
        ("perfect order", {"perfect", "order", "perfect order"} - {"order"}),
    ],
)
def test_candidate_terms(spark, text, want):
    got = {r.term for r in novelty.candidate_terms(asked(spark, (text, "u", "")), "content").collect()}
    got.discard("net")  # a plain word on its own is a candidate
    assert got == want


def test_numeric_and_word_ratings(spark):
    df = spark.createDataFrame([(-1.0, "POSITIVE"), (1.0, "Thumbs_Down "), (None, None), (2.0, "-5")], "rated DOUBLE, feedback_rating STRING")
    assert [r[0] for r in df.select(novelty.is_negative(df, ["rated", "feedback_rating"])).collect()] == [True, True, False, False]


def test_examples_are_distinct_first_three(spark):
    q = spark.createDataFrame([(f"churny thing {c}", i) for i, c in enumerate("bbacd")], "content STRING, ts INT")
    got = {r.term: list(r.example_questions) for r in novelty.example_questions(q, "content", ["ts"]).collect()}
    assert got["churny"] == ["churny thing b", "churny thing a", "churny thing c"]


# ---- queue ---------------------------------------------------------------------------------------

SALES = [
    ("sales means a.x", "u1", "pm", NOW), ("sales means b.y", "u2", "pm", NOW), ("gmv means a.b", "u3", "pm", NOW),
    *[("aov means r.aov", f"u{i}", "finance", NOW) for i in range(4)], ("why is perfect order down", "u1", "pm", NOW), ("perfect order again", "u2", "pm", NOW),
]


def test_the_loop_end_to_end_is_idempotent(spark):
    loop = LearningLoop(spark, scratch_path(spark, "loop"))
    messages = said(spark, *SALES)
    assert loop.harvest(messages).count() == loop.harvest(messages).count() == 7
    loop.detect(NOW)
    healed = {r.term: r.status for r in loop.heal("2026-01-01").collect()}
    assert healed["aov"] == "applied" and healed["sales"] == "proposed" and healed["gmv"] == "proposed"
    assert {r.term: r.status for r in loop.detect(NOW).collect()}["aov"] == "applied"  # a decided status is kept
    first = loop.escalate(messages, NOW, "2026-01-01")
    kinds = sorted((r.kind, r.term) for r in first.collect())
    assert ("poison_conflict", "sales") in kinds and ("novel_term", "perfect order") in kinds
    assert sum(k == "below_gate_proposal" and t == "sales" for k, t in kinds) == 1  # one key, strongest entity
    assert loop.escalate(messages, NOW, "2026-01-02").count() == first.count()
    rulings = first.select("id", F.when(F.col("kind") == "novel_term", "reject").otherwise("approve").alias("ruling"), F.lit("ann").alias("principal"))
    grants = spark.createDataFrame([("ann", "reviewer", None)], "principal STRING, role STRING, revoked_at TIMESTAMP")
    assert loop.decide(rulings, grants, "other", "2026-01-03").where("status <> 'pending'").count() == 0
    decided = loop.decide(rulings, grants, "reviewer", "2026-01-03")
    assert decided.where("decided_by = 'human:ann'").count() == first.count()
    flipped = rulings.withColumn("ruling", F.lit("reject"))
    assert rows(loop.decide(flipped, grants, "reviewer", "2026-01-04").select("id", "status").orderBy("id")) == rows(decided.select("id", "status").orderBy("id"))
    done = loop.apply("2026-01-05")
    assert {r.status for r in done.collect()} == {"applied", "rejected"}
    assert loop.apply("2026-01-06").count() == done.count()
    assert loop.ledger.read().where("status = 'applied'").count() == 3 + done.where("status = 'applied'").count()


def test_kinds_without_a_rule_are_left_alone(spark):
    q = spark.createDataFrame([(1, "k1", "novel_term", "t", None, "approved", None), (2, "k2", "below_gate_proposal", "u", "col", "approved", "x")],
                              "id BIGINT, proposal_key STRING, kind STRING, term STRING, entity STRING, status STRING, decided_by STRING")
    got = escalation.applications(q, "main.gold", ["below_gate_proposal"])
    assert rows(got.select("id", "payload")) == [(2, "no target column in 'col'")]


# ---- tables --------------------------------------------------------------------------------------


def test_snapshots_restore_and_rerun(spark):
    t = tables.SnapshotTable(spark, scratch_path(spark, "t"), "k STRING, v INT")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k STRING, v INT")
    merge = lambda old: tables.insert_only(old, new, ["k"], [F.col("v")])
    assert t.read().count() == 0
    assert sorted(rows(t.change(merge))) == sorted(rows(t.change(merge))) == [("a", 1), ("b", 3)]
    t.publish(new.limit(0))
    assert t.read().count() == 0
    t.restore(1)
    assert sorted(rows(t.read())) == [("a", 1), ("b", 3)] and t.versions() == [1, 2, 3, 4]


def test_a_died_write_and_a_second_writer(spark):
    t = tables.SnapshotTable(spark, scratch_path(spark, "t"), "k STRING, v INT")
    new = spark.createDataFrame([("a", 1)], "k STRING, v INT")
    new.write.parquet(f"{t.root}/data-00000001-half")  # a job that died before its commit
    assert t.publish(new) == 1 and rows(t.read()) == [("a", 1)]
    t.publish(new.limit(0), base=1)
    with pytest.raises(tables.ConcurrentChange):
        t.publish(new, base=1)
    assert t.read().count() == 0 and t.versions() == [1, 2]


def test_repeated_healing_and_a_rollback(spark):
    loop = LearningLoop(spark, scratch_path(spark, "loop"))
    loop.harvest(said(spark, *SALES))
    loop.detect(NOW)
    before = loop.proposals.versions()[-1]
    for at in ("2026-01-01", "2026-01-02"):
        loop.heal(at, dry_run=True)
    assert loop.ledger.read().count() == 3
    loop.heal("2026-01-03")
    assert loop.ledger.read().count() == 6
    statuses = sorted(rows(loop.proposals.read(before).select("term", "entity", "status")))
    scores = spark.createDataFrame(
        [("r1", "b", 0.9, s, 9, 10) for s in ("jargon",)] + [("r2", "a", 0.5, s, 5, 10) for s in ("jargon",)],
        "run_id STRING, phase STRING, accuracy DOUBLE, stratum STRING, correct BIGINT, total BIGINT",
    )
    for _ in range(2):
        assert loop.evaluate(scores, "r1", "r2", before, "2026-01-04") == "ROLLBACK"
    assert sorted(rows(loop.proposals.read().select("term", "entity", "status"))) == statuses
    assert rows(loop.ledger.read().where("action = 'evaluation_gate'").select("status")) == [("rolled_back",)]


def test_a_later_change_survives_the_rollback(spark):
    shape = "k STRING, v INT, status STRING"
    frame = lambda *r: spark.createDataFrame(list(r), shape)
    old = frame(("a", 1, "new"), ("b", 2, "new"), ("c", None, "new"), ("gone", 4, "new"), ("same", 5, "new"))
    judged = frame(("a", 1, "applied"), ("b", 9, "applied"), ("c", 3, "new"), ("same", 5, "new"), ("added", 6, "new"), ("touched", 7, "new"))
    log = tables.change_log(old, judged, ["k"])
    assert dict(rows(log.select("k", "change"))) == {"a": "update", "b": "update", "c": "update", "gone": "delete", "added": "insert", "touched": "insert"}
    later = frame(("a", 1, "applied"), ("b", 8, "applied"), ("c", 3, "held"), ("same", 5, "held"), ("added", 6, "new"), ("touched", 7, "held"), ("learned", 1, "new"))
    want = [("a", 1, "new"), ("b", 8, "new"), ("c", None, "held"), ("gone", 4, "new"), ("learned", 1, "new"), ("same", 5, "held"), ("touched", 7, "held")]
    once = tables.undo(later, log, ["k"])
    assert sorted(rows(once)) == want and sorted(rows(tables.undo(once, log, ["k"]))) == want


def test_copies_keep_a_row_as_it_was(spark):
    df = spark.createDataFrame([("f1", 9, "k"), ("f2", 1, "k")], "f STRING, n INT, k STRING")
    assert rows(quality.without_copies(df, ["k"])) == [("f1", 9, "k")]


def test_upsert_takes_null_scores_and_keeps_status(spark):
    old = spark.createDataFrame([("a", 1, "applied"), ("b", 2, "proposed")], "k STRING, v INT, status STRING")
    new = spark.createDataFrame([("a", None), ("c", 9)], "k STRING, v INT")
    got = tables.upsert(old, new, ["k"], ["v"], {"status": "proposed"})
    assert sorted(rows(got)) == [("a", None, "applied"), ("b", 2, "proposed"), ("c", 9, "proposed")]


def test_conversation_flattening(spark):
    data = ('{"id":"c1","user_id":"u9","messages":[{"id":"m1","content":"hi","feedback":{"rating":"NEGATIVE"},"created_timestamp":1000,'
            '"attachments":[{"text":"t"},{"query":{"query":"SELECT 1"}},{"query":{"query":"SELECT 2"}}]},{"message_id":"m2","user_id":"u1","feedback":"POSITIVE"}]}')
    conv = spark.createDataFrame([(data,)], "value STRING").select(F.from_json("value", telemetry.CONVERSATION_SCHEMA).alias("c")).select("c.*")
    got = {r.message_id: r for r in telemetry.flatten_conversations(conv).collect()}
    assert (got["m1"].user_id, got["m1"].sql, got["m1"].feedback_rating) == ("u9", "SELECT 2", "NEGATIVE")
    assert (got["m2"].user_id, got["m2"].sql, got["m2"].feedback_rating, got["m2"].created_ts) == ("u1", "", "POSITIVE", None)


def test_exported_pages_are_bounded_and_read_whatever_their_shape(spark):
    turns = spark.range(450).select(F.lit("c").alias("conversation_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit('say "'), F.col("id")).alias("content"))
    lines = telemetry.export_pages(turns)
    assert lines.count() == 3
    got = telemetry.read_export(lines).orderBy("turn").collect()
    assert [(r.page, r.position, r.turn) for r in got] == [(i // 200, i % 200, i) for i in range(450)] and got[7].content == 'say "7'
    odd = spark.createDataFrame([('{"conversation_id": "d", "messages": [{"turn": "x", "more": {"a": [1]}}, 5, null]}',), ("no json",), (None,), ("{}",)], "value STRING")
    assert [(r.conversation_id, r.position, r.turn, r.role) for r in telemetry.read_export(odd).collect()] == [("d", i, None, None) for i in range(3)]
