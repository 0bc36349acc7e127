"""Benchmark suite rows: question, stratum, answerable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE_SCHEMA = "question STRING, trap STRING, answer_sql STRING, note STRING, certified BOOLEAN, rejected BOOLEAN"


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUITE_SCHEMA).json(path)


def question_key(c: str) -> Column:
    return F.lower(F.trim(c))


def with_strata(suite: DataFrame) -> DataFrame:
    """Every question with its stratum; one without an answer query is noise."""
    unanswerable = (F.col("trap") == "bad") | F.col("answer_sql").isNull() | (F.col("answer_sql") == "")
    stratum = (
        F.when(F.coalesce(unanswerable, F.lit(False)), "noise")
        .when(F.col("trap") == "true", "jargon")
        .when(F.col("trap") == "collision", "collision")
        .otherwise("clean")
    )
    return suite.select(F.trim("question").alias("question"), stratum.alias("stratum")).withColumn(
        "answerable", F.col("stratum") != "noise"
    )
