"""Defect labels from JSON files."""

from pyspark.sql import DataFrame, SparkSession


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event_id STRING, labels ARRAY<STRING>").json(path)
