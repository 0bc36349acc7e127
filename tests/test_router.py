import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import evals, models, router

TERMS = ["net_revenue", "net", "revenue", "country", "sale_date", "sale", "date"]


def features(spark, text):
    df = spark.createDataFrame([(text,)], "question STRING")
    return router.heuristic_route(router.with_features(df, schema_words=TERMS)).first()


def test_feature_values(spark):
    f = features(spark, "What was net revenue by country last month?")
    assert f.token_count == 8 and f.schema_term_overlap == pytest.approx(3 / 8)
    assert f.has_time_reference and f.has_metric_term and f.has_wh_word and f.has_question_mark
    assert features(spark, "Pull the Jira tickets").references_external_system == 1.0
    assert features(spark, "Why, and should we? How are we doing").vagueness == 3.0
    assert features(spark, None).char_length == 0.0
    assert features(spark, "dismayed").has_time_reference == 0.0  # 'may' inside a word


@pytest.mark.parametrize(
    "text, decision, p",
    [
        ("", "reject", 0.05),
        ("Pull the Salesforce pipeline for me", "reject", 0.05),
        ("How are we doing?", "reject", 0.15),
        ("Why is revenue down this month?", "human_review", 0.5),
        ("list everything", "human_review", 0.5),
        ("net revenue by country last month", "run", 0.9),
    ],
)
def test_heuristic_routes(spark, text, decision, p):
    got = features(spark, text)
    assert (got.decision, got.p_answerable) == (decision, p)


def test_route_order_of_rules(spark):
    rows_in = [
        ("low", 0.1, [("a", 0.9)], "sales"), ("poison", 0.9, [("a", 0.9)], "sales"), ("run", 0.9, [("a", 0.8), ("b", 0.2)], None),
        ("close", 0.9, [("a", 0.5), ("b", 0.45)], None), ("mid", 0.5, [("a", 0.9)], None), ("none", 0.9, [], None),
    ]
    df = spark.createDataFrame(rows_in, "question STRING, p_answerable DOUBLE, metrics ARRAY<STRUCT<name: STRING, p: DOUBLE>>, poison STRING")
    got = {r.question: (r.decision, r.p_ambiguous) for r in router.route(df, 0.35, 0.65).collect()}
    assert got["low"][0] == "reject" and got["poison"][0] == "clarify" and got["run"] == ("run", 0.25)
    assert got["close"] == ("clarify", 0.9) and got["mid"][0] == "clarify" and got["none"] == ("clarify", 1.0)


def test_thresholds_and_fallback(spark):
    clean = spark.createDataFrame([("noise", 0.2), ("noise", 0.3), ("answerable", 0.8)], "label STRING, p_answerable DOUBLE")
    got = router.chosen_thresholds(router.threshold_sweep(clean)).first()
    assert (got.t_low, got.t_high) == (0.3, 0.35)
    mixed = spark.createDataFrame([("noise", 0.99), ("answerable", 0.01)], "label STRING, p_answerable DOUBLE")
    got = router.chosen_thresholds(router.threshold_sweep(mixed)).first()
    assert (got.t_low, got.t_high) == (0.35, 0.65)


def test_split_is_exact_and_falls_back(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 90, "a").otherwise("b").alias("y"))
    got = dict(((r.y, r.part), r["count"]) for r in router.stratified_split(df, "y", "k").groupBy("y", "part").count().collect())
    assert got == {("a", "eval"): 23, ("a", "train"): 67, ("b", "eval"): 3, ("b", "train"): 7}
    tiny = router.stratified_split(df.limit(3).unionByName(df.where("k = '99'")), "y", "k")
    assert {r.part for r in tiny.collect()} == {"both"}


def test_lift_gate(spark):
    data = [("r1", "jargon", 0.8), ("r1", "clean", 1.0), ("r2", "jargon", 0.9), ("r2", "clean", 0.9), ("r3", "jargon", 0.9), ("r3", "clean", 1.0), ("r3", "collision", 0.0)]
    s = spark.createDataFrame(data, "run_id STRING, stratum STRING, accuracy DOUBLE")
    assert evals.lift(s, "r1", "r2").first().verdict == "ROLLBACK"
    assert evals.lift(s, "r1", "r3").first().verdict == "KEEP"
    assert rows(evals.rollback_decision(s, "r1", "r2", "r3")) == [("ROLLBACK", "KEEP", "restore", "rolled_back")]


def test_answer_comparison(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k STRING, v INT")
    reason = lambda c: evals.compare_answers(c, gold).first().reason
    assert reason(gold) == "equal"
    assert reason(gold.distinct()) == "missing rows"
    assert reason(gold.unionByName(gold.limit(1))) == "extra rows"
    assert reason(gold.withColumn("v", F.when(F.col("k") == "b", 3).otherwise(F.col("v")))) == "single cell difference"
    assert reason(gold.select("k")) == "missing columns"


def test_quality_model_separates_noise(spark):
    ask = ["net revenue by country last month", "sessions per day in 2011", "total sales this week", "average conversion rate by month"]
    noise = ["how are we doing", "why though", "pull the jira board", "any thoughts"]
    df = spark.createDataFrame([(q, "answerable") for q in ask] + [(q, "noise") for q in noise], "question STRING, label STRING")
    f = router.with_features(df)
    got = models.p_answerable(models.quality_model(f), f)
    said = F.when(F.col("p_answerable") >= 0.5, "answerable").otherwise("noise")
    assert router.classifier_scores(got.select("label", said.alias("predicted"))).first().accuracy == 1.0


def test_nearest_rows_of_many_probes(spark, monkeypatch):
    import numpy as np

    from tallyloom.functions import nearest as N

    random = np.random.default_rng(3)
    vectors = {i: [round(float(x), 1) for x in random.standard_normal(3)] for i in range(300)}  # many ties
    data = [(i, v) for i, v in vectors.items()] + [(1000, None), (1001, [0.0] * 3), (1002, [None] * 3), (1003, [float("nan")] * 3), (None, [1.0] * 3)]
    table = spark.createDataFrame(data, "id BIGINT, v ARRAY<DOUBLE>")
    want = []
    for i in range(0, 300, 7):
        p = np.array(vectors[i])
        near = [(-round(float(np.dot(p, v) / np.linalg.norm(p) / np.linalg.norm(v)), 6), j) for j, v in ((j, np.array(v)) for j, v in vectors.items()) if j != i and v.any()]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:4])]
    asked = table.where("id % 7 = 0 and id < 1000")

    def got():
        return sorted((r[0], r[1], r[2], round(r[3], 5)) for r in N.nearest(table, asked, 4, "id", "v").collect())

    want = sorted((a, b, c, round(d, 5)) for a, b, c, d in want)
    assert got() == want
    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "PROBES", 10)
    assert got() == want and N.nearest(table.limit(0), asked, 4, "id", "v").count() == 0
