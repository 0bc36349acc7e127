"""Benchmark scoring, question routing, model and forecast cases."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registered.base import CTES, case
from registered.loop import EDGE, quoted
from tallyloom import fixed_values as fv
from tallyloom.functions.nearest import nearest
from tallyloom.operators import certified, drift, evals, models, router, telemetry
from tallyloom.plans.marts import Marts
from tallyloom.plans.router_job import RouterJob
from tallyloom.session import scratch_path
from tallyloom.sources import warehouse as wh
from tallyloom.sources.tables import SnapshotTable, change_log, undo
from tallyloom.sources.suite import with_strata

# ---- evaluation ----------------------------------------------------------------------------------

CTES["suite"] = """
SELECT trim(text) AS question, CASE item_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'jargon' WHEN 2 THEN 'collision' ELSE 'noise' END AS stratum, item_id % 4 <> 3 AS answerable, item_id FROM benchmark"""
CTES["eval_results"] = """
SELECT 'run' || r AS run_id, CASE r WHEN 1 THEN 'before' WHEN 2 THEN 'after' ELSE 'recovery' END AS phase, TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(r AS INT)) AS ts,
  CASE WHEN item_id % 9 = 0 THEN 'new: ' || text WHEN item_id % 2 = 0 THEN '  ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS question,
  CASE (item_id * 3 + r) % 5 WHEN 0 THEN 'BAD' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS assessment FROM benchmark, (VALUES (1), (2), (3)) t(r)"""
CTES["graded"] = """
SELECT e.*, coalesce(s.stratum, 'unmatched') AS stratum, assessment = 'GOOD' AS is_good FROM eval_results e
LEFT JOIN (SELECT lower(trim(question)) AS k, min(stratum) AS stratum FROM suite WHERE answerable GROUP BY 1) s ON lower(trim(e.question)) = s.k"""
CTES["scores"] = """
SELECT run_id, phase, stratum, count(*) FILTER (WHERE is_good) AS correct, count(*) AS total, max(ts) AS recorded_at,
  round(count(*) FILTER (WHERE is_good) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM graded GROUP BY 1, 2, 3"""
CTES["run_summary"] = """
SELECT run_id, phase, max(ts) AS ts, count(*) AS total, count(*) FILTER (WHERE assessment = 'GOOD') AS good,
  greatest(0, count(*) - count(*) FILTER (WHERE assessment = 'GOOD') - count(*) FILTER (WHERE assessment = 'NEEDS_REVIEW')) AS bad,
  count(*) FILTER (WHERE assessment = 'NEEDS_REVIEW') AS manual_review, round(count(*) FILTER (WHERE assessment = 'GOOD') / CAST(count(*) AS DOUBLE), 4) AS accuracy
FROM eval_results GROUP BY 1, 2"""


def suite_of(m: Marts):
    return with_strata(wh.eval_suite(m.tables))


def graded_of(m: Marts):
    return evals.graded(wh.eval_results(m.tables), suite_of(m))


def scores_of(m: Marts):
    return evals.stratified(graded_of(m))


def summary_of(m: Marts):
    return evals.run_summary(wh.eval_results(m.tables))


@case("src04_suite_strata", "SELECT question, stratum, answerable FROM suite")
def _(m: Marts):
    return suite_of(m)


@case("evl01_stratified_scores", "SELECT * FROM scores")
def _(m: Marts):
    return scores_of(m)


@case("evl01_failed_questions", "SELECT run_id, stratum, trim(question) AS question FROM graded WHERE NOT is_good")
def _(m: Marts):
    return evals.failures(graded_of(m))


@case("evl02_run_summary", "SELECT * FROM run_summary")
def _(m: Marts):
    return summary_of(m)


ACC = "(SELECT coalesce(max(accuracy), 0.0) FROM {0} WHERE run_id = '{1}'{2})"


@case(
    "evl03_aggregate_gate",
    f"SELECT before, after, after >= before + 0.01 AS keep FROM (SELECT {ACC.format('run_summary', 'run1', '')} AS before, {ACC.format('run_summary', 'run2', '')} AS after)",
)
def _(m: Marts):
    return evals.keeps_accuracy(summary_of(m), "run1", "run2", 0.01)


def lift_sql(before: str, after: str) -> str:
    cells = ", ".join(
        ACC.format("scores", run, f" AND stratum = '{s}'") + f" AS {s}_{n}"
        for s in ("jargon", "clean", "collision") for n, run in (("before", before), ("after", after))
    )
    return f"SELECT *, CASE WHEN jargon_after >= jargon_before AND clean_after >= clean_before THEN 'KEEP' ELSE 'ROLLBACK' END AS verdict FROM (SELECT {cells})"


@case("evl04_lift", lift_sql("run1", "run2"))
def _(m: Marts):
    return evals.lift(scores_of(m), "run1", "run2")


@case(
    "evl05_variance",
    "SELECT stratum, count(*) AS runs, round(avg(accuracy), 4) AS mean_accuracy, min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy FROM scores GROUP BY 1",
)
def _(m: Marts):
    return evals.variance(scores_of(m))


@case("evl06_latest_run", "SELECT run_id FROM run_summary ORDER BY ts DESC, run_id DESC LIMIT 1")
def _(m: Marts):
    return evals.latest_done(wh.eval_results(m.tables))


@case(
    "evl07_deltas",
    "SELECT run_id, phase, accuracy, previous, delta, CASE WHEN previous IS NULL THEN 'first' WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'regressed' ELSE 'flat' END AS trend FROM ("
    "SELECT *, round(accuracy - previous, 4) AS delta FROM (SELECT *, lag(accuracy) OVER (ORDER BY ts, run_id) AS previous FROM run_summary))",
)
def _(m: Marts):
    return evals.deltas(summary_of(m))


@case(
    "evl08_rollback_decision",
    f"SELECT g.verdict AS gate_verdict, r.verdict AS recovery_verdict, CASE g.verdict WHEN 'ROLLBACK' THEN 'restore' ELSE 'keep' END AS action, "
    f"CASE g.verdict WHEN 'ROLLBACK' THEN 'rolled_back' ELSE 'applied' END AS ledger_status FROM ({lift_sql('run1', 'run2')}) g, ({lift_sql('run1', 'run3')}) r",
)
def _(m: Marts):
    return evals.rollback_decision(scores_of(m), "run1", "run2", "run3")


@case(
    "evl08_rolled_back_proposals",
    f"SELECT term, entity, CASE WHEN confidence >= 0.5 AND (SELECT verdict FROM ({lift_sql('run1', 'run2')})) <> 'ROLLBACK' THEN 'applied' ELSE status END AS status, "
    "CASE WHEN distinct_users = 3 THEN evidence_count + 10 ELSE evidence_count END AS evidence_count FROM part_proposals",
)
def _(m: Marts):
    """The stored proposals after a judged change (strong ones applied), a later one (new evidence) and the gate."""
    table = SnapshotTable(m.spark, scratch_path(m.spark, "proposals"), "term STRING")
    key = ["term", "entity"]
    table.publish(wh.part_proposals(m.tables))
    before = table.versions()[-1]
    table.change(lambda old: old.withColumn("status", F.when(F.col("confidence") >= 0.5, "applied").otherwise(F.col("status"))))
    after = table.versions()[-1]
    table.change(lambda old: old.withColumn("evidence_count", F.when(F.col("distinct_users") == 3, F.col("evidence_count") + 10).otherwise(F.col("evidence_count"))))
    if evals.lift(scores_of(m), "run1", "run2").first()["verdict"] == "ROLLBACK":
        log = change_log(table.read(before), table.read(after), key)
        table.change(lambda now: undo(now, log, key))
    return table.read().select("term", "entity", "status", "evidence_count")


GOLDEN = "SELECT country, sum(line_amount) AS net_revenue FROM fact_sales GROUP BY country"


@case(
    "evl09_answer_comparison",
    f"SELECT * FROM (VALUES ('same', 'equal', '', 0::BIGINT, 0::BIGINT), ('short', 'missing rows', '', 0, 1), ('null cell', 'single cell difference', '', 1, 1)) v(pair, reason, missing_columns, extra_rows, missing_rows) "
    f"WHERE (SELECT count(*) FROM ({GOLDEN}) WHERE country = 'NATION_10') = 1",
)
def _(m: Marts):
    golden = m.fact_sales.groupBy("country").agg(F.sum("line_amount").alias("net_revenue"))
    same = evals.compare_answers(golden, golden).withColumn("pair", F.lit("same"))
    short = evals.compare_answers(golden.where(F.col("country") != "NATION_10"), golden).withColumn("pair", F.lit("short"))
    nulled = golden.withColumn("net_revenue", F.when(F.col("country") != "NATION_10", F.col("net_revenue")))
    return same.unionByName(short).unionByName(evals.compare_answers(nulled, golden).withColumn("pair", F.lit("null cell")))


# ---- features and routes -------------------------------------------------------------------------

ANY = "CAST(len(list_intersect(names, [{0}])) > 0 AS INT)"
PHRASES = " + ".join("CAST(contains(low, '" + p.replace("'", "''") + "') AS INT)" for p in fv.VAGUE_PHRASES)
CTES["featured"] = (
    r"""
SELECT message_id, content, CAST(len(names) AS DOUBLE) AS token_count, CAST(length(content) AS DOUBLE) AS char_length,
  CAST(regexp_matches(low, '(^|[^\p{L}\p{N}_])"""
    + fv.TIME_REFERENCE_PATTERN
    + r"""($|[^\p{L}\p{N}_])') AS DOUBLE) AS has_time_reference,
  CAST("""
    + ANY.format(quoted(fv.METRIC_TERMS))
    + " AS DOUBLE) AS has_metric_term, coalesce(len(list_filter(names, lambda x: x IN ("
    + quoted(fv.SCHEMA_WORDS)
    + r"""))) / nullif(CAST(len(names) AS DOUBLE), 0), 0.0) AS schema_term_overlap,
  CAST("""
    + ANY.format(quoted(fv.WH_WORDS))
    + " AS DOUBLE) AS has_wh_word, CAST(contains(content, '?') AS DOUBLE) AS has_question_mark, CAST("
    + PHRASES
    + r""" + len(list_filter(regexp_extract_all(low, '[\p{L}\p{N}\p{M}_]+'), lambda x: x IN ("""
    + quoted(fv.VAGUE_WORDS)
    + "))) AS DOUBLE) AS vagueness, CAST("
    + ANY.format(quoted(fv.EXTERNAL_SYSTEMS))
    + """ AS DOUBLE) AS references_external_system, feedback_rating, sql_text
FROM (SELECT *, lower(content) AS low, regexp_extract_all(lower(content), '[a-z0-9_]+') AS names FROM telemetry)"""
)
CTES["routed"] = """
SELECT *, CASE WHEN token_count = 0 OR references_external_system > 0 THEN 'reject' WHEN vagueness > 0 AND has_metric_term = 0 AND schema_term_overlap = 0 THEN 'reject'
    WHEN vagueness > 0 OR signals <= 1 THEN 'human_review' ELSE 'run' END AS decision,
  CASE WHEN token_count = 0 OR references_external_system > 0 THEN 0.05::DOUBLE WHEN vagueness > 0 AND has_metric_term = 0 AND schema_term_overlap = 0 THEN 0.15
    WHEN vagueness > 0 OR signals <= 1 THEN 0.5 ELSE 0.9 END AS p_answerable
FROM (SELECT *, has_metric_term + CAST(schema_term_overlap > 0 AS INT) + has_time_reference AS signals FROM featured)"""
CTES["marks"] = """
SELECT message_id, content AS question, (n * 7 % 101) / 100.0::DOUBLE AS p_answerable, (n * 3 % 50 + 1) / 100.0::DOUBLE AS p_net, (n * 7 % 50 + 1) / 100.0::DOUBLE AS p_aov, (n * 11 % 50 + 1) / 100.0::DOUBLE AS p_mon,
  CASE n % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'jargon' WHEN 2 THEN 'collision' ELSE 'noise' END AS stratum, n % 4 <> 3 AS answerable, CASE WHEN n % 4 = 3 THEN 'noise' ELSE 'answerable' END AS label FROM telemetry"""


def featured_of(m: Marts):
    return router.with_features(wh.telemetry(m.tables), "content")


@case("rtr01_question_features", f"SELECT message_id, {', '.join('round({0}, 6) AS {0}'.format(f) for f in router.FEATURES)} FROM featured")
def _(m: Marts):
    return featured_of(m).select("message_id", *[F.round(f, 6).alias(f) for f in router.FEATURES])


@case("rtr02_heuristic_route", "SELECT message_id, decision, p_answerable FROM routed")
def _(m: Marts):
    return router.heuristic_route(featured_of(m)).select("message_id", "decision", "p_answerable")


@case(
    "rtr03_probability_route",
    "SELECT message_id, p_answerable, CASE WHEN p_answerable >= 0.65 THEN 'run' WHEN p_answerable <= 0.35 THEN 'reject' ELSE 'human_review' END AS decision FROM marks",
)
def _(m: Marts):
    return wh.question_marks(m.tables).select("message_id", "p_answerable", router.probability_route().alias("decision"))


def labelled_features(m: Marts):
    """Questions with a rating-based label, featured."""
    label = F.when(F.col("feedback_rating") == "NEGATIVE", "noise").otherwise("answerable")
    return featured_of(m).withColumn("question", F.col("content")).withColumn("label", label)


CTES["held_out"] = """
SELECT message_id, label FROM (SELECT message_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(message_id), message_id) AS rn, count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT message_id, CASE WHEN feedback_rating = 'NEGATIVE' THEN 'noise' ELSE 'answerable' END AS label FROM telemetry)) WHERE rn <= floor(n * 0.25 + 0.5)"""
JUDGED = "SELECT label, count(*) AS held_out, TRUE AS better_than_majority, TRUE AS same_after_load FROM held_out GROUP BY label"


def judged(scored: DataFrame, again: DataFrame) -> DataFrame:
    """Held-out rows by label, whether the model is right more often than the larger class is large, and whether the
    stored model says the same."""
    both = scored.select("message_id", "label", F.col("predicted").alias("_p")).join(again.select("message_id", "predicted"), "message_id")
    counts = both.groupBy("label").agg(
        F.count(F.lit(1)).alias("held_out"), F.count_if(F.col("label") == F.col("_p")).alias("_right"), F.bool_and(F.col("_p").eqNullSafe(F.col("predicted"))).alias("same_after_load")
    )
    whole = Window.partitionBy()  # one row for each class
    return counts.select("label", "held_out", (F.sum("_right").over(whole) > F.max("held_out").over(whole)).alias("better_than_majority"), "same_after_load")


@case("rtr04_quality_classifier", JUDGED)
def _(m: Marts):
    """Fitted on three quarters, judged on the rest, stored and loaded."""
    rows = labelled_features(m).select("message_id", "label", *router.FEATURES)
    train, held = models.parts(router.stratified_split(rows, "label", "message_id"))
    model, path = models.quality_model(train), scratch_path(m.spark, "quality")
    model.write().overwrite().save(path)
    said = F.when(F.col("p_answerable") >= 0.5, "answerable").otherwise("noise")
    one, two = (models.p_answerable(x, held).withColumn("predicted", said) for x in (model, models.PipelineModel.load(path)))
    return judged(one, two)


CTES["predictions"] = """
SELECT CASE feedback_rating WHEN 'NEGATIVE' THEN 'noise' ELSE 'answerable' END AS label, CASE decision WHEN 'run' THEN 'answerable' ELSE 'noise' END AS predicted FROM routed"""


def predictions_of(m: Marts):
    said = F.when(F.col("decision") == "run", "answerable").otherwise("noise")
    return router.heuristic_route(labelled_features(m)).select("label", said.alias("predicted"))


CELL = "(SELECT CAST(count(*) AS DOUBLE) FROM predictions WHERE {0})"


@case(
    "rtr05_classifier_scores",
    f"SELECT round({CELL.format('label = predicted')} / {CELL.format('TRUE')}, 4) AS accuracy, "
    f"round({CELL.format(chr(39).join(['label = ', 'noise', ' AND predicted = ', 'noise', '']))} / {CELL.format(chr(39).join(['predicted = ', 'noise', '']))}, 4) AS precision, "
    f"round({CELL.format(chr(39).join(['label = ', 'noise', ' AND predicted = ', 'noise', '']))} / {CELL.format(chr(39).join(['label = ', 'noise', '']))}, 4) AS recall",
)
def _(m: Marts):
    return router.classifier_scores(predictions_of(m))


# ---- corpus --------------------------------------------------------------------------------------

CTES["seed"] = """
SELECT text AS question, 'suite' AS kind, CASE WHEN item_id % 4 = 3 THEN 'noise' ELSE 'answerable' END AS label, CASE WHEN item_id % 4 = 3 THEN 'NONE' ELSE 'net_revenue' END AS target_metric FROM benchmark
UNION ALL SELECT DISTINCT content, 'asked', 'noise', 'NONE' FROM telemetry WHERE content LIKE 'How are we%'"""


def seed_of(m: Marts):
    noise = F.col("trap") == "bad"
    suite = wh.eval_suite(m.tables).select(
        "question", F.lit("suite").alias("kind"), F.when(noise, "noise").otherwise("answerable").alias("label"),
        F.when(noise, "NONE").otherwise("net_revenue").alias("target_metric"),
    )
    asked = wh.telemetry(m.tables).where(F.col("content").like("How are we%")).select(
        F.col("content").alias("question"), F.lit("asked").alias("kind"), F.lit("noise").alias("label"), F.lit("NONE").alias("target_metric")
    )
    return suite.unionByName(asked.distinct())


CTES["harvest"] = """
SELECT message_id, trim(content) AS question, ts, sql_text, CASE WHEN message_id IN (SELECT message_id FROM corrections) THEN 'correction_message'
  WHEN contains(feedback_rating, 'POSITIVE') THEN 'answerable' WHEN contains(feedback_rating, 'NEGATIVE') AND trim(sql_text) = '' THEN 'noise' ELSE 'no_weak_label' END AS outcome
FROM telemetry WHERE trim(content) <> ''"""
METRIC_LIST = "[" + quoted(sorted(fv.METRIC_VOCABULARY, key=lambda v: (-len(v), v))) + "]"
WEAK = f"coalesce(list_filter({METRIC_LIST}, lambda v: list_contains(regexp_extract_all(lower(sql_text), '[a-z0-9_]+'), v))[1], 'NONE')"
CTES["corpus"] = f"""
SELECT question, kind, label, target_metric, 'seed' AS source FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY kind, label, target_metric) AS rn FROM seed) WHERE rn = 1 UNION ALL
SELECT question, 'telemetry', outcome, CASE outcome WHEN 'answerable' THEN {WEAK} ELSE 'NONE' END, 'telemetry' FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY ts, message_id) AS rn FROM harvest WHERE outcome IN ('answerable', 'noise') AND question NOT IN (SELECT question FROM seed)) WHERE rn = 1"""


def corpus_of(m: Marts):
    return router.corpus(seed_of(m), wh.telemetry(m.tables))


@case("rtr06_corpus", "SELECT * FROM corpus")
def _(m: Marts):
    return corpus_of(m)


@case(
    "rtr06_harvest_counts",
    "SELECT CASE WHEN question IN (SELECT question FROM seed) THEN 'duplicate_of_seed' ELSE outcome END AS outcome, count(*) AS messages FROM harvest GROUP BY 1",
)
def _(m: Marts):
    return router.harvest_counts(seed_of(m), wh.telemetry(m.tables))


@case("rtr07_weak_target_metric", f"SELECT message_id, {WEAK} AS target_metric FROM telemetry")
def _(m: Marts):
    return router.weak_metric(wh.telemetry(m.tables), "message_id")


@case(
    "rtr08_corpus_summary",
    "SELECT 'source' AS dimension, source AS value, count(*) AS rows FROM corpus GROUP BY 2 UNION ALL SELECT 'label', label, count(*) FROM corpus GROUP BY 2 "
    "UNION ALL SELECT 'target_metric', target_metric, count(*) FROM corpus WHERE label = 'answerable' GROUP BY 2",
)
def _(m: Marts):
    return router.corpus_summary(corpus_of(m))


def training_rows(m: Marts):
    """Every question with a label and a target, featured for the heads."""
    asked = F.col("question")
    metric = F.when(asked.contains("revenue"), "net_revenue").when(asked.contains("AOV"), "aov").otherwise("orders")
    rows = labelled_features(m).select("message_id", "question", "label", *router.FEATURES)
    return rows.withColumn("target_metric", metric)


def heads(m: Marts, trees: bool = False):
    train, held = models.parts(router.stratified_split(training_rows(m), "label", "message_id"))
    features = models.TextFeatures().fit(train)
    head = models.Head("label", trees).fit(features.transform(train))
    return features, head, train, held


CTES["question_grams"] = """
SELECT message_id, gram, count(*) AS tf FROM (
  SELECT message_id, unnest(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS gram FROM (SELECT message_id, regexp_extract_all(lower(content), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS words FROM telemetry)) GROUP BY 1, 2"""
CTES["question_gram_weights"] = """
SELECT message_id, gram, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY message_id)) AS weight FROM (
  SELECT message_id, gram, tf, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM telemetry)) / (1.0 + df))) AS raw FROM question_grams JOIN (SELECT gram, count(*) AS df FROM question_grams GROUP BY gram) USING (gram))"""


@case("rtr09_text_features", "SELECT message_id, gram, tf, round(weight, 6) AS weight FROM question_gram_weights")
def _(m: Marts):
    """The TF-IDF weight of every gram of every question."""
    rows = training_rows(m).select("message_id", "question")
    table, questions = models.gram_table(rows), rows.agg(F.count(F.lit(1))).scalar()
    return models.gram_weights(rows, "message_id", table, questions).withColumn("weight", F.round("weight", 6))


METRIC_OF = "CASE WHEN contains(question, 'revenue') THEN 'net_revenue' WHEN contains(question, 'AOV') THEN 'aov' ELSE 'orders' END"


@case(
    "rtr10_two_heads",
    "SELECT 'answerability' AS head, count(*) AS held_out, TRUE AS better_than_majority FROM held_out UNION ALL "
    "SELECT 'target_metric', count(*), TRUE FROM (SELECT row_number() OVER (PARTITION BY metric ORDER BY md5(message_id), message_id) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM ("
    f"SELECT message_id, {METRIC_OF} AS metric FROM (SELECT message_id, content AS question FROM telemetry WHERE feedback_rating IS DISTINCT FROM 'NEGATIVE'))) WHERE rn <= floor(n * 0.25 + 0.5)",
)
def _(m: Marts):
    """Both heads on the rows held out from them; the metric head is fitted on answerable questions alone."""
    def head_of(rows: DataFrame, label: str, name: str) -> DataFrame:
        train, held = models.parts(router.stratified_split(rows, label, "message_id"))
        features = models.TextFeatures().fit(train)
        said = models.Head(label).fit(features.transform(train)).predict(features.transform(held))
        counts = said.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col("predicted")).alias("right"))
        return counts.agg(F.sum("n").alias("held_out"), (F.sum("right") > F.max("n")).alias("better_than_majority")).select(F.lit(name).alias("head"), "held_out", "better_than_majority")

    rows = training_rows(m)
    first = head_of(rows, "label", "answerability")
    rows = rows.where(F.col("label") == "answerable")
    return first.unionByName(head_of(rows, "target_metric", "target_metric")) if models.enough_targets(rows, "target_metric") else first


@case(
    "rtr11_stratified_split",
    "SELECT message_id, label, CASE WHEN rn <= floor(n * 0.25 + 0.5) THEN 'eval' ELSE 'train' END AS part FROM ("
    "SELECT message_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(message_id), message_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM marks)",
)
def _(m: Marts):
    return router.stratified_split(wh.question_marks(m.tables).select("message_id", "label"), "label", "message_id")


@case("rtr12_confusion", "SELECT label, predicted, count(*) AS n FROM predictions GROUP BY 1, 2")
def _(m: Marts):
    return router.confusion(predictions_of(m))


@case(
    "rtr12_class_report",
    "SELECT c AS class, coalesce(round(tp / nullif(said, 0), 4), 0.0) AS precision, coalesce(round(tp / nullif(true_n, 0), 4), 0.0) AS recall, "
    "coalesce(round(2 * tp / nullif(said + true_n, 0), 4), 0.0) AS f1, CAST(true_n AS BIGINT) AS support FROM (SELECT c, "
    "(SELECT CAST(count(*) AS DOUBLE) FROM predictions WHERE label = c AND predicted = c) AS tp, (SELECT CAST(count(*) AS DOUBLE) FROM predictions WHERE predicted = c) AS said, "
    "(SELECT CAST(count(*) AS DOUBLE) FROM predictions WHERE label = c) AS true_n FROM (SELECT label AS c FROM predictions UNION SELECT predicted FROM predictions))",
)
def _(m: Marts):
    return router.class_report(predictions_of(m))


@case(
    "rtr13_top_coefficients",
    "SELECT label AS class, CAST(i AS BIGINT) AS place, TRUE AS falling, TRUE AS of_the_training_rows FROM (SELECT DISTINCT label FROM training_labels), range(1, 6) r(i)",
)
def _(m: Marts):
    """The five strongest features of each class: places, whether coefficients fall, and whether each named gram is one
    of the training rows (or one of the nine features)."""
    features, head, train, _ = heads(m)
    top = head.top_coefficients(features)
    grams = models.gram_table(train).select(F.concat(F.lit("term:"), "gram").alias("feature"), F.lit(True).alias("_known"))
    before = F.lag("coefficient").over(Window.partitionBy("class").orderBy("place"))
    return top.withColumn("before", before).join(grams, "feature", "left").select(
        "class", "place", F.coalesce(F.col("before") >= F.col("coefficient"), F.lit(True)).alias("falling"),
        (F.coalesce("_known", F.lit(False)) | F.col("feature").startswith("feature:")).alias("of_the_training_rows"),
    )


@case("rtr14_boosted_arm", JUDGED)
def _(m: Marts):
    features, head, _, held = heads(m, trees=True)
    path = scratch_path(m.spark, "boosted")
    head.save(path)
    ready = features.transform(held)
    return judged(head.predict(ready), models.Head.load(path, "label", trees=True).predict(ready))


CTES["sweep"] = """
SELECT t AS threshold, coalesce(round(leak / nullif(noise, 0), 4), 0.0) AS noise_leak_rate, coalesce(round(loss / nullif(ans, 0), 4), 0.0) AS question_loss_rate,
  CAST(leak AS BIGINT) AS noise_passed, CAST(loss AS BIGINT) AS answerable_lost FROM (
  SELECT t, CAST(count(*) FILTER (WHERE label = 'noise' AND p_answerable >= t) AS DOUBLE) AS leak, count(*) FILTER (WHERE label = 'noise') AS noise,
    CAST(count(*) FILTER (WHERE label = 'answerable' AND p_answerable < t) AS DOUBLE) AS loss, count(*) FILTER (WHERE label = 'answerable') AS ans
  FROM marks, (SELECT round(0.05 * i, 2)::DOUBLE AS t FROM range(1, 20) r(i)) GROUP BY t)"""


@case("rtr15_threshold_sweep", "SELECT * FROM sweep")
def _(m: Marts):
    return router.threshold_sweep(wh.question_marks(m.tables).select("label", "p_answerable"))


CTES["heuristic_marks"] = "SELECT CASE feedback_rating WHEN 'NEGATIVE' THEN 'noise' ELSE 'answerable' END AS label, p_answerable FROM routed"
CTES["heuristic_sweep"] = CTES["sweep"].replace("FROM marks", "FROM heuristic_marks")


def choice_sql(sweep: str) -> str:
    return (
        "SELECT CASE WHEN low >= high THEN 0.35::DOUBLE ELSE low END AS t_low, CASE WHEN low >= high THEN 0.65::DOUBLE ELSE high END AS t_high FROM ("
        f"SELECT high, coalesce((SELECT max(threshold) FROM {sweep} WHERE question_loss_rate = 0 AND threshold < high), 0.35::DOUBLE) AS low FROM ("
        f"SELECT coalesce(min(threshold), 0.65::DOUBLE) AS high FROM {sweep} WHERE noise_leak_rate = 0))"
    )


@case("rtr16_chosen_thresholds", choice_sql("heuristic_sweep"))
def _(m: Marts):
    scored = router.heuristic_route(labelled_features(m)).select("label", "p_answerable")
    return router.chosen_thresholds(router.threshold_sweep(scored))


CTES["poison"] = f"""
SELECT message_id, string_agg(term, ', ' ORDER BY term) AS poison FROM telemetry JOIN conflicts ON regexp_matches(lower(content), '(^|{EDGE})' || term || '($|{EDGE})') GROUP BY 1"""


CTES["training_labels"] = "SELECT content AS question, CASE WHEN feedback_rating = 'NEGATIVE' THEN 'noise' ELSE 'answerable' END AS label FROM telemetry"


def poison_of(m: Marts):
    messages = wh.telemetry(m.tables)
    conflicted = drift.conflicts(telemetry.corrections(messages))
    return router.poison_hits(wh.question_marks(m.tables), "message_id", conflicted)


@case("rtr17_poison_hits", "SELECT * FROM poison")
def _(m: Marts):
    return poison_of(m)


CTES["decisions"] = """
SELECT *, CASE WHEN p_answerable <= 0.3 THEN 'reject' WHEN poison IS NOT NULL THEN 'clarify' WHEN p_answerable >= 0.6 AND p_ambiguous <= 0.75 THEN 'run' ELSE 'clarify' END AS decision,
  CASE WHEN p_answerable <= 0.3 THEN 'not answerable' WHEN poison IS NOT NULL THEN 'ambiguous term' WHEN p_answerable >= 0.6 AND p_ambiguous <= 0.75 THEN 'confident'
    WHEN p_answerable >= 0.6 THEN 'ambiguous metric' ELSE 'uncertain' END AS reason
FROM (SELECT k.*, p.poison, m[1].name AS target_metric, m[2].p / m[1].p AS p_ambiguous FROM (
  SELECT *, list_reverse_sort([{'p': p_net, 'name': 'net_revenue'}, {'p': p_aov, 'name': 'aov'}, {'p': p_mon, 'name': 'monetary'}]) AS m FROM marks) k LEFT JOIN poison p ON k.message_id = p.message_id)"""


def decisions_of(m: Marts):
    marks = wh.question_marks(m.tables).join(poison_of(m), "message_id", "left")
    return router.route(marks, 0.3, 0.6)


@case("rtr18_route_decisions", "SELECT message_id, target_metric, round(p_ambiguous, 4) AS p_ambiguous, decision, reason FROM decisions")
def _(m: Marts):
    return decisions_of(m).select("message_id", "target_metric", "p_ambiguous", "decision", "reason")


@case("rtr18_router_job", "SELECT label, count(*) AS questions, TRUE AS same_after_load, TRUE AS decided_by_rule FROM training_labels GROUP BY label")
def _(m: Marts):
    """Fit, store, load, score, sweep, choose and route; the rule is applied again to the stored probabilities."""
    rows = training_rows(m)
    job = RouterJob(m.spark, scratch_path(m.spark, "router"))
    job.fit(rows)
    chosen, routed = job.run(rows, poison_of(m))
    again = job.score(rows).select("message_id", F.col("p_answerable").alias("again"))
    low, high = chosen.first()
    p = F.col("p_answerable")
    expected = (
        F.when(p <= low, "reject").when(F.coalesce("poison", F.lit("")) != "", "clarify")
        .when((p >= high) & (F.col("p_ambiguous") <= fv.AMBIGUITY_RATIO), "run").otherwise("clarify")
    )
    return routed.join(again, "message_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("questions"), F.bool_and(F.abs(p - F.col("again")) < 1e-9).alias("same_after_load"),
        F.bool_and(expected == F.col("decision")).alias("decided_by_rule"),
    )


@case(
    "rtr13_metric_coefficients",
    "SELECT class, 5::BIGINT AS features FROM (SELECT CASE WHEN contains(question, 'revenue') THEN 'net_revenue' WHEN contains(question, 'AOV') THEN 'aov' ELSE 'orders' END AS class, label FROM training_labels) "
    "WHERE label = 'answerable' GROUP BY class",
)
def _(m: Marts):
    """The metric head's strongest features, counted by class."""
    rows = training_rows(m).where(F.col("label") == "answerable")
    features = models.TextFeatures().fit(rows)
    head = models.Head("target_metric").fit(features.transform(rows))
    return head.top_coefficients(features).groupBy("class").agg(F.count(F.lit(1)).alias("features"))


@case("rtr19_corpus_ids", "SELECT question, left(sha1(question), 16) AS corpus_id FROM corpus")
def _(m: Marts):
    return router.with_ids(corpus_of(m)).select("question", "corpus_id")


@case(
    "rtr20_similar_questions",
    "SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), 6) AS similarity "
    "FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 5",
)
def _(m: Marts):
    vectors = m.tables("embeddings")
    probe = vectors.agg(F.min_by("embedding", "vec_id")).scalar()
    return router.similar(vectors.select("vec_id", "label", "embedding"), F.col("embedding"), probe, 5).drop("embedding")


@case(
    "rtr20_similar_batch",
    "SELECT probe, place, row, similarity FROM (SELECT p.vec_id AS probe, r.vec_id AS row, round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS similarity, "
    "row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) DESC, r.vec_id) AS place "
    "FROM embeddings p JOIN embeddings r ON p.vec_id % 50 = 0 AND p.vec_id <> r.vec_id) WHERE place <= 5",
)
def _(m: Marts):
    """The five nearest rows of every 50th question vector."""
    vectors = m.tables("embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, "vec_id", "embedding")


ARM = """
SELECT *, coalesce(round(noise_deflected / CAST(nullif(noise, 0) AS DOUBLE), 4), 0.0) AS deflection_rate, coalesce(round(false_rejects / CAST(nullif(answerable, 0) AS DOUBLE), 4), 0.0) AS false_reject_rate FROM (
  SELECT count(*) AS questions, count(*) FILTER (WHERE NOT answerable) AS noise, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE NOT answerable AND decision <> 'run') AS noise_deflected,
    count(*) FILTER (WHERE answerable AND decision = 'run') AS passed, count(*) FILTER (WHERE answerable AND decision = 'clarify') AS clarified, count(*) FILTER (WHERE answerable AND decision = 'reject') AS false_rejects FROM decisions)"""


@case("rtr21_arm_counts", ARM)
def _(m: Marts):
    return router.arm_counts(decisions_of(m))


@case(
    "rtr21_decision_mix",
    "SELECT stratum, count(*) FILTER (WHERE decision = 'run') AS run, count(*) FILTER (WHERE decision = 'clarify') AS clarify, count(*) FILTER (WHERE decision = 'reject') AS reject FROM decisions WHERE answerable GROUP BY 1",
)
def _(m: Marts):
    return router.decision_mix(decisions_of(m))


PROBE = "sales means quantity in fact_sales"


@case("rtr22_poison_probe", f"SELECT DISTINCT question, decision, decision = 'clarify' AS passed FROM decisions WHERE question = '{PROBE}'")
def _(m: Marts):
    return router.probe_check(decisions_of(m), PROBE)


CTES["stratum_accuracy"] = """
SELECT s AS stratum, coalesce((SELECT max(accuracy) FROM scores WHERE run_id = 'run3' AND stratum = s),
  (SELECT round(CAST(sum(correct) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 4) FROM scores WHERE run_id = 'run3' AND stratum IN ('clean', 'jargon', 'collision'))) AS stratum_accuracy
FROM (VALUES ('clean'), ('jargon'), ('collision')) t(s)"""


@case("rtr23_stratum_accuracy", "SELECT * FROM stratum_accuracy")
def _(m: Marts):
    return router.stratum_accuracy(scores_of(m), "run3")


def results_of(m: Marts):
    return router.arm_results(decisions_of(m), router.stratum_accuracy(scores_of(m), "run3"))


CTES["arm_results"] = """
SELECT question, d.stratum, answerable, TRUE AS arm_a_sent, decision AS arm_b_decision, decision = 'run' AS arm_b_sent, p_answerable, target_metric, round(p_ambiguous, 4) AS p_ambiguous, stratum_accuracy, reason
FROM decisions d LEFT JOIN stratum_accuracy a ON d.stratum = a.stratum"""


@case(
    "rtr24_usefulness",
    "SELECT arm, e AS expected_correct, deflected, n AS questions, round((e + deflected) / n, 4) AS usefulness FROM ("
    "SELECT 'all' AS arm, CAST(sum(CAST(stratum_accuracy AS DECIMAL(10,6))) FILTER (WHERE answerable) AS DOUBLE) AS e, 0::BIGINT AS deflected, count(*) AS n FROM arm_results UNION ALL "
    "SELECT 'routed', CAST(sum(CAST(stratum_accuracy AS DECIMAL(10,6))) FILTER (WHERE answerable AND arm_b_sent) AS DOUBLE), count(*) FILTER (WHERE NOT answerable AND NOT arm_b_sent), count(*) FROM arm_results)",
)
def _(m: Marts):
    return router.usefulness(results_of(m))


@case("rtr25_arm_results", "SELECT * FROM arm_results")
def _(m: Marts):
    return results_of(m)


# ---- data science --------------------------------------------------------------------------------

CTES["trend"] = "SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM points"
CTES["points"] = "SELECT sale_date, CAST(net_revenue AS DOUBLE) AS y, CAST(date_diff('day', (SELECT min(sale_date) FROM daily_revenue), sale_date) AS DOUBLE) AS x, dayofweek(sale_date) AS dow FROM daily_revenue"
CTES["residuals"] = "SELECT dow, y - ((SELECT base FROM trend) + (SELECT slope FROM trend) * x) AS r FROM points"
CTES["offsets"] = "SELECT dow, avg(r) AS shift, sum(r * r) AS ss, count(*) AS n FROM residuals GROUP BY dow"


@case(
    "dsm01_revenue_forecast",
    "WITH f AS (SELECT ds, v, 1.96 * (SELECT sqrt(sum(ss - n * shift * shift) / sum(n)) FROM offsets) AS w FROM ("
    "SELECT ds, (SELECT base FROM trend) + (SELECT slope FROM trend) * date_diff('day', (SELECT min(sale_date) FROM daily_revenue), ds) + coalesce(shift, 0.0) AS v FROM ("
    "SELECT (SELECT max(sale_date) FROM daily_revenue) + CAST(i AS INT) AS ds FROM range(1, 29) r(i)) LEFT JOIN offsets ON dayofweek(ds) = dow)) "
    "SELECT ds, round(v, 2) AS revenue_forecast, round(v - w, 2) AS revenue_lower, round(v + w, 2) AS revenue_upper FROM f",
)
def _(m: Marts):
    return models.forecast(m.daily_revenue)


@case("dsm02_purchase_propensity")
def _(m: Marts):
    return models.propensity(m.customer_rfm)
