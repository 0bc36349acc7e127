"""Benchmark scoring, run comparison and the keep/rollback gate."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import ratio
from tallyloom.sources.suite import question_key


def graded(results: DataFrame, suite: DataFrame) -> DataFrame:
    """Results with the stratum of their question (matched without case and outer blanks)."""
    strata = (
        suite.where("answerable")
        .select(question_key("question").alias("_key"), "stratum")
        .groupBy("_key")
        .agg(F.min("stratum").alias("stratum"))
    )
    return (
        results.withColumn("_key", question_key("question"))
        .join(strata, "_key", "left")
        .drop("_key")
        .withColumns(
            {"stratum": F.coalesce("stratum", F.lit("unmatched")), "is_good": F.col("assessment") == "GOOD"}
        )
    )


def stratified(graded_rows: DataFrame) -> DataFrame:
    scores = graded_rows.groupBy("run_id", "phase", "stratum").agg(
        F.count_if("is_good").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.max("ts").alias("recorded_at"),
    )
    return scores.withColumn("accuracy", ratio("correct", "total", 4))


def failures(graded_rows: DataFrame) -> DataFrame:
    """The failed questions as rows; a list per stratum would have no bound."""
    return graded_rows.where(~F.col("is_good")).select("run_id", "stratum", F.trim("question").alias("question"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: total, good, review, bad (what is left of the finished ones) and accuracy."""
    good = F.count_if(F.col("assessment") == "GOOD")
    review = F.count_if(F.col("assessment") == "NEEDS_REVIEW")
    done = F.count("assessment")
    return (
        results.groupBy("run_id", "phase")
        .agg(
            F.max("ts").alias("ts"),
            F.count(F.lit(1)).alias("total"),
            good.alias("good"),
            F.greatest(F.lit(0), done - good - review).alias("bad"),
            review.alias("manual_review"),
        )
        .withColumn("accuracy", F.coalesce(ratio("good", "total", 4), F.lit(0.0)))
    )


def accuracy_of(condition: Column) -> Column:
    return F.coalesce(F.max(F.when(condition, F.col("accuracy"))), F.lit(0.0))


def keeps_accuracy(summary: DataFrame, before: str, after: str, min_gain: float = 0.0) -> DataFrame:
    old, new = (accuracy_of(F.col("run_id") == r) for r in (before, after))
    return summary.agg(old.alias("before"), new.alias("after")).withColumn(
        "keep", F.col("after") >= F.col("before") + min_gain
    )


def lift(scores: DataFrame, before: str, after: str) -> DataFrame:
    """One row: accuracies of both runs per stratum and the verdict. A run is kept when neither the
    jargon nor the clean stratum dropped; the collision stratum is shown but does not decide."""
    cells = {
        f"{s}_{label}": accuracy_of((F.col("run_id") == run) & (F.col("stratum") == s))
        for s in ("jargon", "clean", "collision")
        for label, run in (("before", before), ("after", after))
    }
    kept = (F.col("jargon_after") >= F.col("jargon_before")) & (F.col("clean_after") >= F.col("clean_before"))
    return scores.agg(*[c.alias(n) for n, c in cells.items()]).withColumn(
        "verdict", F.when(kept, "KEEP").otherwise("ROLLBACK")
    )


def variance(scores: DataFrame) -> DataFrame:
    a = F.col("accuracy")
    return scores.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg(a), 4).alias("mean_accuracy"),
        F.min(a).alias("min_accuracy"),
        F.max(a).alias("max_accuracy"),
    )


def latest_done(results: DataFrame) -> DataFrame:
    """The run id of the newest finished run; equal times are decided by the id."""
    done = results.where(F.col("run_status") == "DONE")
    return done.agg(F.max(F.struct("ts", "run_id")).alias("m")).select(F.col("m.run_id").alias("run_id"))


def deltas(summary: DataFrame) -> DataFrame:
    """Each run against the one before. One row per run, so the single window is bounded by the number
    of runs ever recorded."""
    prior = F.lag("accuracy").over(Window.orderBy("ts", "run_id"))
    delta = F.round(F.col("accuracy") - F.col("previous"), 4)
    return (
        summary.withColumn("previous", prior)
        .withColumn("delta", delta)
        .withColumn(
            "trend",
            F.when(F.col("previous").isNull(), "first").when(F.col("delta") > 0, "improved")
            .when(F.col("delta") < 0, "regressed").otherwise("flat"),
        )
        .select("run_id", "phase", "accuracy", "previous", "delta", "trend")
    )


def rollback_decision(scores: DataFrame, baseline: str, changed: str, recovery: str) -> DataFrame:
    """What the gate does after a change, and what the recovery run shows. The recovery verdict is
    reported beside the range of the baseline's stratum, since repeated runs differ."""
    gate = lift(scores, baseline, changed).select(F.col("verdict").alias("gate_verdict"))
    again = lift(scores, baseline, recovery).select(F.col("verdict").alias("recovery_verdict"))
    row = gate.unionByName(again, allowMissingColumns=True).agg(
        F.max("gate_verdict").alias("gate_verdict"), F.max("recovery_verdict").alias("recovery_verdict")
    )
    return row.select(
        "gate_verdict",
        "recovery_verdict",
        F.when(F.col("gate_verdict") == "ROLLBACK", "restore").otherwise("keep").alias("action"),
        F.when(F.col("gate_verdict") == "ROLLBACK", "rolled_back").otherwise("applied").alias("ledger_status"),
    )


def compare_answers(candidate: DataFrame, golden: DataFrame) -> DataFrame:
    """One row that says how a candidate answer differs from the golden one, as multisets of rows.

    Both sides are stacked with +1 and -1 and summed per row, which is one shuffle with map-side
    combine; two ``exceptAll`` would be two joins.
    """
    missing = [c for c in golden.columns if c not in candidate.columns]
    shared = [c for c in golden.columns if c in candidate.columns]
    if not shared:
        spark = golden.sparkSession
        return spark.createDataFrame([("missing columns", ",".join(missing), 0, 0)], COMPARISON)
    signed = candidate.select(*shared, F.lit(1).alias("_s")).unionByName(golden.select(*shared, F.lit(-1).alias("_s")))
    diff = signed.groupBy(*shared).agg(F.sum("_s").alias("_s"))
    extra = F.coalesce(F.sum(F.when(F.col("_s") > 0, F.col("_s"))), F.lit(0))
    absent = F.coalesce(F.sum(F.when(F.col("_s") < 0, -F.col("_s"))), F.lit(0))
    # with one row on each side the largest is that row; NULL is a value like any other
    one, other = (F.max(F.when(side, F.struct(*shared))) for side in (F.col("_s") > 0, F.col("_s") < 0))
    odd_rows = (
        diff.where(F.col("_s") != 0)
        .agg(extra.alias("extra_rows"), absent.alias("missing_rows"), one.alias("_one"), other.alias("_other"))
        .withColumn("_changed_columns", reduce(add, [(~F.equal_null(f"_one.{c}", f"_other.{c}")).cast("int") for c in shared]))
    )
    reason = (
        F.when(F.lit(bool(missing)), "missing columns")
        .when((F.col("extra_rows") == 0) & (F.col("missing_rows") == 0), "equal")
        .when((F.col("extra_rows") == 1) & (F.col("missing_rows") == 1) & (F.col("_changed_columns") == 1), "single cell difference")
        .when(F.col("missing_rows") == 0, "extra rows")
        .when(F.col("extra_rows") == 0, "missing rows")
        .otherwise("different rows")
    )
    return odd_rows.select(
        reason.alias("reason"), F.lit(",".join(missing)).alias("missing_columns"), "extra_rows", "missing_rows"
    )


COMPARISON = "reason STRING, missing_columns STRING, extra_rows BIGINT, missing_rows BIGINT"
