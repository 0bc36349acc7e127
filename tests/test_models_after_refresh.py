"""Models are fitted and applied in a session that has observed a write, as a refresh does."""

from pyspark.sql import functions as F

from tallyloom.operators import models, quality, router


def observe(spark) -> None:
    watched, seen = quality.observed(spark.range(3), {"small": F.col("id") < 2}, "before_models")
    watched.write.format("noop").mode("overwrite").save()
    assert dict(seen.get) == {"rows": 3, "small": 1}


def test_question_quality_is_scored_after_an_observed_write(spark):
    observe(spark)
    said = [("net revenue by country last month", "answerable"), ("total sales this week", "answerable"), ("why though", "noise"), ("any thoughts", "noise")]
    featured = router.with_features(spark.createDataFrame(said, "question STRING, label STRING"))
    got = models.p_answerable(models.quality_model(featured), featured)
    assert {r.question: r.p_answerable >= 0.5 for r in got.collect()} == {q: label == "answerable" for q, label in said}


def test_propensity_is_scored_after_an_observed_write(spark):
    observe(spark)
    rfm = spark.range(400).select(
        F.col("id").cast("string").alias("customer_id"), F.lit("UK").alias("country"), (F.col("id") % 90).alias("recency_days"),
        F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("frequency"), F.when(F.col("id") % 3 == 0, F.lit(90.0)).otherwise(F.lit(10.0)).alias("monetary"),
    )
    row = models.propensity(rfm).first()
    assert (row.rows, row.repeat_buyers, row.auc) == (400, 134, 1.0)
