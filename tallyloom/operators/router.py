"""Question features, routing, corpus assembly, thresholds and the two-arm comparison."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import ratio
from tallyloom.functions.ranking import cut_rows
from tallyloom.functions.text import any_in, clean_text, count_in, is_correction, name_tokens, whole_word_hits, word_tokens
from tallyloom.session import write_and_read
from tallyloom.sources.tables import one_per_key

FEATURES = [
    "token_count", "char_length", "has_time_reference", "has_metric_term", "schema_term_overlap",
    "has_wh_word", "has_question_mark", "vagueness", "references_external_system",
]


def with_features(questions: DataFrame, text_col: str = "question", schema_words: list[str] | None = None) -> DataFrame:
    """Nine features per question, all built-in expressions. ``schema_words``: names of the schema and their parts."""
    text = clean_text(text_col)
    low = F.lower(text)
    names = name_tokens(text_col)
    n = F.size(names)
    known = count_in(names, schema_words or fv.SCHEMA_WORDS)
    phrases = sum((low.contains(p).cast("int") for p in fv.VAGUE_PHRASES), F.lit(0))
    flags = {
        "token_count": n,
        "char_length": F.length(text),
        "has_time_reference": low.rlike(r"(?U)\b" + fv.TIME_REFERENCE_PATTERN + r"\b"),
        "has_metric_term": any_in(names, fv.METRIC_TERMS),
        "schema_term_overlap": F.coalesce(ratio(known, n), F.lit(0.0)),
        "has_wh_word": any_in(names, fv.WH_WORDS),
        "has_question_mark": text.contains("?"),
        "vagueness": phrases + count_in(word_tokens(text_col), fv.VAGUE_WORDS),
        "references_external_system": any_in(names, fv.EXTERNAL_SYSTEMS),
    }
    return questions.select("*", *[c.cast("double").alias(f) for f, c in flags.items()])


def heuristic_route(featured: DataFrame) -> DataFrame:
    """Route without a model. The probabilities are nominal marks, not estimates."""
    on = {f: F.col(f) > 0 for f in FEATURES}
    signals = sum((on[f].cast("int") for f in ("has_metric_term", "schema_term_overlap", "has_time_reference")), F.lit(0))
    hopeless = (F.col("token_count") == 0) | on["references_external_system"]
    unanchored = on["vagueness"] & ~on["has_metric_term"] & ~on["schema_term_overlap"]
    unsure = on["vagueness"] | (signals <= 1)

    def by_case(a, b, c, d) -> Column:
        return F.when(hopeless, a).when(unanchored, b).when(unsure, c).otherwise(d)

    return featured.withColumns(
        {"decision": by_case("reject", "reject", "human_review", "run"), "p_answerable": by_case(0.05, 0.15, 0.5, 0.9)}
    )


def probability_route(p: str = "p_answerable") -> Column:
    return (
        F.when(F.col(p) >= fv.RUN_THRESHOLD, "run")
        .when(F.col(p) <= fv.REJECT_THRESHOLD, "reject")
        .otherwise("human_review")
    )


def classifier_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy, and precision and recall for the noise class, from (label, predicted)."""
    said, truth = F.col("predicted") == "noise", F.col("label") == "noise"
    row = predictions.agg(
        F.count_if(F.col("label") == F.col("predicted")).alias("_right"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(said & truth).alias("_tp"),
        F.count_if(said).alias("_said"),
        F.count_if(truth).alias("_true"),
    )
    zero = F.lit(0.0)
    return row.select(
        ratio("_right", "_n", 4).alias("accuracy"),
        F.coalesce(ratio("_tp", "_said", 4), zero).alias("precision"),
        F.coalesce(ratio("_tp", "_true", 4), zero).alias("recall"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "predicted")


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion cells: each cell is counted to
    its true and its predicted class, so no join is needed."""
    cells = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("c"), hit.alias("tp"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("true_n")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("true_n")),
    )
    sums = cells.select(F.inline(sides)).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "said", "true_n")])
    zero = F.lit(0.0)
    return sums.select(
        F.col("c").alias("class"),
        F.coalesce(ratio("tp", "said", 4), zero).alias("precision"),
        F.coalesce(ratio("tp", "true_n", 4), zero).alias("recall"),
        F.coalesce(ratio(F.col("tp") * 2, F.col("said") + F.col("true_n"), 4), zero).alias("f1"),
        F.col("true_n").alias("support"),
    )


# ---- corpus ------------------------------------------------------------------------------------


def weak_metric(messages: DataFrame, id_col: str, vocabulary: list[str] | None = None) -> DataFrame:
    """The longest metric name that occurs in the SQL as a whole word, ``NONE`` otherwise. Metric names
    are single words, so the test is an overlap of the SQL's words with a fixed list."""
    names = sorted(vocabulary or fv.METRIC_VOCABULARY, key=lambda v: (-len(v), v))
    found = word_tokens("sql")
    first = F.coalesce(*[F.when(F.array_contains(found, v.lower()), F.lit(v)) for v in names], F.lit("NONE"))
    return messages.select(id_col, first.alias("target_metric"))


def harvest(messages: DataFrame) -> DataFrame:
    """Every non-empty message with its weak label, or the reason it gives none. A rating counts as
    positive or negative when it contains the word."""
    rating = F.upper(clean_text("feedback_rating"))
    no_sql = F.trim(clean_text("sql")) == ""
    outcome = (
        F.when(is_correction("content"), "correction_message")
        .when(rating.contains("POSITIVE"), "answerable")
        .when(rating.contains("NEGATIVE") & no_sql, "noise")
        .otherwise("no_weak_label")
    )
    return (
        messages.withColumn("question", F.trim(clean_text("content")))
        .where(F.col("question") != "")
        .withColumn("outcome", outcome)
    )


def corpus(seed: DataFrame, messages: DataFrame) -> DataFrame:
    """Seed questions plus weakly labelled telemetry, each question once; the earliest message decides.

    ``seed`` has (question, kind, label, target_metric)."""
    rows = harvest(messages).where(F.col("outcome").isin("answerable", "noise"))
    target = weak_metric(rows, "message_id").withColumnRenamed("target_metric", "_t")
    first = one_per_key(rows, ["question"], [F.col("ts"), F.col("message_id")])
    grown = (
        first.join(seed.select("question"), "question", "left_anti")
        .join(target, "message_id")
        .select(
            "question",
            F.lit("telemetry").alias("kind"),
            F.col("outcome").alias("label"),
            F.when(F.col("outcome") == "answerable", F.col("_t")).otherwise("NONE").alias("target_metric"),
            F.lit("telemetry").alias("source"),
        )
    )
    order = [F.col("kind"), F.col("label"), F.col("target_metric")]
    start = one_per_key(seed, ["question"], order).select("question", "kind", "label", "target_metric", F.lit("seed").alias("source"))
    return start.unionByName(grown)


def harvest_counts(seed: DataFrame, messages: DataFrame) -> DataFrame:
    """How many messages each rule took or skipped. Messages are counted by question and rule before they meet
    the seed, so a question that everybody asks is one row of the join."""
    counted = harvest(messages).groupBy("question", "outcome").agg(F.count(F.lit(1)).alias("n"))
    flagged = counted.join(seed.select("question").distinct().withColumn("_s", F.lit(True)), "question", "left")
    outcome = F.when(F.col("_s"), "duplicate_of_seed").otherwise(F.col("outcome"))
    return flagged.groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("messages"))


def corpus_summary(rows: DataFrame) -> DataFrame:
    target = F.when(F.col("label") == "answerable", F.col("target_metric"))
    sides = F.array_compact(
        F.array(
            F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value")),
            F.struct(F.lit("label").alias("dimension"), F.col("label").alias("value")),
            F.when(target.isNotNull(), F.struct(F.lit("target_metric").alias("dimension"), target.alias("value"))),
        )
    )
    return rows.select(F.inline(sides)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("corpus_id", F.substring(F.sha1("question"), 1, 16))


def stratified_split(rows: DataFrame, label: str, key: str, held_out: float = 0.25) -> DataFrame:
    """Mark ``held_out`` of each class as eval, by the order of a hash: exact and repeatable. Where a
    class has fewer than two rows (or there is one class) all rows serve both purposes.

    Hashes are even, so the ranges of ``cut_rows`` are their first three digits; the last held-out row of each class is
    found there, and every row is marked by comparing its hash with that of its class, a one-row map with one entry
    for each class. No row is moved, whatever share of them has one label.
    """
    name, order = F.col(label).cast("string"), F.struct(F.md5(key).alias("hash"), F.col(key).cast("string").alias("key"))
    keyed = rows.where(F.col(label).isNotNull()).select(name.alias("part"), F.substring(F.md5(key), 1, 3).alias("range"), order.alias("key"))
    last = cut_rows(keyed, lambda total: F.array(F.greatest(F.floor(total * held_out + 0.5), F.lit(1)), total))
    classes = last.groupBy("part").agg(F.min_by("key", "rank").alias("cut"), F.max("rank").alias("total"))
    known = classes.agg(
        F.map_from_entries(F.collect_list(F.struct("part", F.struct("cut", "total")))).alias("of"),
        ((F.min("total") >= 2) & (F.count(F.lit(1)) >= 2)).alias("splittable"),
    ).agg(F.first(F.struct("of", "splittable"))).scalar()
    own = F.try_element_at(known["of"], name)
    held = (F.floor(own["total"] * held_out + 0.5) >= 1) & (order <= own["cut"])
    part = F.when(~known["splittable"], "both").when(held, "eval").otherwise("train")
    return write_and_read(rows.withColumn("part", part), "split")  # a fit reads its rows many times


# ---- thresholds --------------------------------------------------------------------------------

STEPS = [round(0.05 * i, 2) for i in range(1, fv.SWEEP_STEPS + 1)]


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Noise leak and question loss per threshold from (label, p_answerable): one pass with two
    conditional counts per step, then the one result row is turned into steps."""
    noise, asked = F.col("label") == "noise", F.col("label") == "answerable"
    p = F.col("p_answerable")
    counts = [F.count_if(noise).alias("n_noise"), F.count_if(asked).alias("n_ans")]
    for i, t in enumerate(STEPS):
        counts += [F.count_if(noise & (p >= t)).alias(f"leak{i}"), F.count_if(asked & (p < t)).alias(f"loss{i}")]
    steps = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"leak{i}").alias("noise_passed"),
                F.col(f"loss{i}").alias("answerable_lost"),
                "n_noise",
                "n_ans",
            )
            for i, t in enumerate(STEPS)
        ]
    )
    zero = F.lit(0.0)
    return (
        scored.agg(*counts)
        .select(F.inline(steps))
        .select(
            "threshold",
            F.coalesce(ratio("noise_passed", "n_noise", 4), zero).alias("noise_leak_rate"),
            F.coalesce(ratio("answerable_lost", "n_ans", 4), zero).alias("question_loss_rate"),
            "noise_passed",
            "answerable_lost",
        )
    )


def chosen_thresholds(sweep: DataFrame) -> DataFrame:
    """``t_high``: the lowest step without leak. ``t_low``: the highest step without loss below it.
    Without such steps, or when they cross, the fixed thresholds apply."""
    no_leak = F.when(F.col("noise_leak_rate") == 0, F.col("threshold"))
    no_loss = F.when(F.col("question_loss_rate") == 0, F.col("threshold"))
    found = sweep.agg(
        F.coalesce(F.min(no_leak), F.lit(fv.RUN_THRESHOLD)).alias("high"),
        F.collect_set(no_loss).alias("lows"),  # at most one entry per step
    ).withColumn(
        "low", F.coalesce(F.array_max(F.filter("lows", lambda t: t < F.col("high"))), F.lit(fv.REJECT_THRESHOLD))
    )
    crossed = F.col("low") >= F.col("high")
    return found.select(
        F.when(crossed, fv.REJECT_THRESHOLD).otherwise(F.col("low")).alias("t_low"),
        F.when(crossed, fv.RUN_THRESHOLD).otherwise(F.col("high")).alias("t_high"),
    )


# ---- routing -----------------------------------------------------------------------------------


def poison_hits(questions: DataFrame, id_col: str, poison: DataFrame, text_col: str = "question") -> DataFrame:
    """Ambiguous terms each question uses, as one sorted text. The list per question is bounded by the
    words of that question."""
    hits = whole_word_hits(questions, [id_col], text_col, poison.select("term"), "term").distinct()
    return hits.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("phrase")), ", ").alias("poison"))


def route(scored: DataFrame, t_low: float, t_high: float) -> DataFrame:
    """Decision and reason from ``p_answerable``, ``metrics`` (array of struct(name, p)) and ``poison``.

    Order of rules: reject the unanswerable, ask about ambiguous terms, run the confident with a clear
    winner among the metrics, ask about the rest. Without metrics the ambiguity is 1."""
    top = F.slice(F.reverse(F.array_sort(F.transform("metrics", lambda m: F.struct(m["p"], m["name"])))), 1, 2)
    ranked = scored.withColumn("_top", F.coalesce(top, F.array()))
    one, two = F.try_element_at("_top", F.lit(1)), F.try_element_at("_top", F.lit(2))
    p1, p2 = F.coalesce(one["p"], F.lit(0.0)), F.coalesce(two["p"], F.lit(0.0))
    ranked = ranked.withColumns(
        {
            "target_metric": F.coalesce(one["name"], F.lit("UNKNOWN")),
            "p_ambiguous": F.when(p1 <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(p2, p1)))),
        }
    )
    p = F.col("p_answerable")
    cases = [
        (p <= t_low, "reject", "not answerable"),
        (F.coalesce("poison", F.lit("")) != "", "clarify", "ambiguous term"),
        ((p >= t_high) & (F.col("p_ambiguous") <= fv.AMBIGUITY_RATIO), "run", "confident"),
        (p >= t_high, "clarify", "ambiguous metric"),
    ]
    decision, reason = F.lit("clarify"), F.lit("uncertain")
    for test, verdict, why in reversed(cases):
        decision = F.when(test, verdict).otherwise(decision)
        reason = F.when(test, why).otherwise(reason)
    return ranked.withColumns(
        {"p_ambiguous": F.round("p_ambiguous", 4), "decision": decision, "reason": reason}
    ).drop("_top", "metrics")


def similar(rows: DataFrame, vector: Column, probe: Column, k: int) -> DataFrame:
    """The k rows most similar to one probe vector, exact cosine. The top k of every task are merged
    (TakeOrdered), so no row set larger than k times the tasks leaves the executors."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    probed = rows.withColumn("_q", probe)
    cosine = F.try_divide(dot(vector, F.col("_q")), F.sqrt(dot(vector, vector)) * F.sqrt(dot(F.col("_q"), F.col("_q"))))
    return probed.withColumn("similarity", F.round(cosine, 6)).drop("_q").orderBy(F.desc("similarity"), rows.columns[0]).limit(k)


# ---- arms --------------------------------------------------------------------------------------


def arm_counts(routed: DataFrame) -> DataFrame:
    """Deflected noise, passed, clarified and falsely rejected questions, and their rates."""
    d, ok = F.col("decision"), F.col("answerable")
    row = routed.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(~ok).alias("noise"),
        F.count_if(ok).alias("answerable"),
        F.count_if(~ok & d.isin("reject", "clarify")).alias("noise_deflected"),
        F.count_if(ok & (d == "run")).alias("passed"),
        F.count_if(ok & (d == "clarify")).alias("clarified"),
        F.count_if(ok & (d == "reject")).alias("false_rejects"),
    )
    return row.select(
        "*",
        F.coalesce(ratio("noise_deflected", "noise", 4), F.lit(0.0)).alias("deflection_rate"),
        F.coalesce(ratio("false_rejects", "answerable", 4), F.lit(0.0)).alias("false_reject_rate"),
    )


def decision_mix(routed: DataFrame) -> DataFrame:
    d = F.col("decision")
    return routed.where("answerable").groupBy("stratum").agg(
        *[F.count_if(d == x).alias(x) for x in ("run", "clarify", "reject")]
    )


def probe_check(routed: DataFrame, probe: str) -> DataFrame:
    """The ambiguous probe question must be asked back."""
    return routed.where(F.col("question") == probe).select(
        "question", "decision", (F.col("decision") == "clarify").alias("passed")
    ).distinct()


def stratum_accuracy(scores: DataFrame, run_id: str) -> DataFrame:
    """Accuracy per answerable stratum of a run; an absent stratum takes the ratio over those present.
    One row out of the scores, then a row per stratum."""
    mine = (F.col("run_id") == run_id) & F.col("stratum").isin(fv.ANSWERABLE_STRATA)
    cells = [F.sum(F.when(mine, F.col(c))).alias(c) for c in ("correct", "total")]
    for s in fv.ANSWERABLE_STRATA:
        cells.append(F.max(F.when(mine & (F.col("stratum") == s), F.col("accuracy"))).alias(f"acc_{s}"))
    overall = ratio("correct", "total", 4)
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(f"acc_{s}"), overall).alias("stratum_accuracy"))
            for s in fv.ANSWERABLE_STRATA
        ]
    )
    return scores.agg(*cells).select(F.inline(rows))


def arm_results(routed: DataFrame, accuracy: DataFrame) -> DataFrame:
    """One row per question: what each arm sends and the accuracy its stratum is known to have."""
    return routed.join(accuracy, "stratum", "left").select(
        "question",
        "stratum",
        "answerable",
        F.lit(True).alias("arm_a_sent"),
        F.col("decision").alias("arm_b_decision"),
        (F.col("decision") == "run").alias("arm_b_sent"),
        "p_answerable",
        "target_metric",
        "p_ambiguous",
        "stratum_accuracy",
        "reason",
    )


def usefulness(results: DataFrame) -> DataFrame:
    """Expected right answers plus deflected noise over all questions, per arm. Arm A sends everything
    and so deflects nothing."""
    ok, sent = F.col("answerable"), F.col("arm_b_sent")
    gain = F.coalesce("stratum_accuracy", F.lit(0.0)).cast("decimal(10,6)")
    sums = results.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(ok, gain)), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(ok & sent, gain)), F.lit(0)).alias("b"),
        F.count_if(~ok & ~sent).alias("held"),
    )
    arms = F.array(
        F.struct(F.lit("all").alias("arm"), F.col("a").cast("double").alias("expected_correct"), F.lit(0).cast("bigint").alias("deflected"), "n"),
        F.struct(F.lit("routed").alias("arm"), F.col("b").cast("double").alias("expected_correct"), F.col("held").alias("deflected"), "n"),
    )
    return sums.select(F.inline(arms)).select(
        "arm", "expected_correct", "deflected", F.col("n").alias("questions"),
        ratio(F.col("expected_correct") + F.col("deflected"), "n", 4).alias("usefulness"),
    )
