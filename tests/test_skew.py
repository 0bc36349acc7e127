"""A third of all rows under one key: results must stay whole and equal brute force."""

from collections import Counter, defaultdict

from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions.text import whole_word_hits
from tallyloom.operators import clickstream, drift, novelty
from tallyloom.operators.quality import scorecard
from tallyloom.sources.tables import one_per_key

N = 6000


def hot(n: int = 97):
    """Key 'hot' for every third row, one of n keys otherwise."""
    return F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % n).cast("string")))


def test_hot_event_id_keeps_one_row(spark):
    e = spark.range(N).select(
        hot().alias("event_id"), *[F.lit("x").alias(c) for c in ("session_id", "visitor_id", "event_type", "stock_code", "referrer")],
        F.date_format(F.timestamp_seconds(F.col("id") * 7 % 1000 + 100), "yyyy-MM-dd HH:mm:ss").alias("event_ts"),
    )
    want = {}
    for r in e.collect():
        want[r.event_id] = min(want.get(r.event_id, r.event_ts), r.event_ts)
    assert {r.event_id: r.event_ts for r in clickstream.first_per_event(e).collect()} == want


def test_hot_key_first_row(spark):
    df = spark.range(N).select(hot().alias("k"), (F.col("id") * 31 % 5003).alias("v"))
    want = defaultdict(lambda: 10**9)
    for r in df.collect():
        want[r.k] = min(want[r.k], r.v)
    assert dict(rows(one_per_key(df, ["k"], [F.col("v")]))) == dict(want)


def test_hot_proposal_counts_every_report(spark):
    c = spark.range(N).select(
        hot().alias("term"), F.lit("t.c").alias("entity"), F.concat(F.lit("u"), (F.col("id") % 11).cast("string")).alias("user"),
        F.lit("pm").alias("role"), F.lit(0.0).alias("ts"), F.col("id").cast("string").alias("source_message_id"),
    )
    want = Counter(r.term for r in c.collect())
    got = drift.score(c, 0.0)
    assert {r.term: r.evidence_count for r in got.collect()} == dict(want)
    assert drift.evidence(c).count() == N


def test_hot_term_and_hot_word(spark):
    q = spark.range(N).select(
        F.col("id"), F.concat(F.lit("blorp "), hot(7)).alias("content"), F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("user_id")
    )
    got = {r.term: r.occurrences for r in novelty.novel_terms(q, "content", "user_id").collect()}
    assert got["blorp hot"] == N // 3 and "blorp" not in got and sum(got.values()) == N
    phrases = spark.createDataFrame([("blorp hot",), ("blorp k1",), ("hot",)], "term STRING")
    hits = Counter(r.phrase for r in whole_word_hits(q, ["id"], "content", phrases, "term").collect())
    k1 = sum(1 for i in range(N) if i % 3 and i % 7 == 1)
    assert hits == {"blorp hot": N // 3, "hot": N // 3, "blorp k1": k1}


def test_hot_scorecard_counts_keys_once(spark):
    flags, truth = (spark.range(N).select(hot(n).alias("k")) for n in (10, 20))
    got = scorecard(flags, truth, "k").first()
    assert (got.tp, got.flagged, got.labeled) == (11, 11, 21)
