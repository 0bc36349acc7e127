"""Rows of a one-file table reach more than one core where much is made of each."""

import pytest
from pyspark.sql import functions as F

from tallyloom.plans.marts import Marts
from tallyloom.sources.warehouse import Warehouse, telemetry


@pytest.fixture
def uncoalesced(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def test_feed_of_one_events_file_is_built_by_several_tasks(uncoalesced, tmp_path):
    ids = F.when(F.col("id") < 400, F.col("id")).otherwise(F.when(F.col("id") < 403, F.lit(7)))  # copies and nulls
    events = uncoalesced.range(410).select(
        ids.alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 9 + 1).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    marts = Marts(Warehouse(uncoalesced, str(tmp_path)))
    assert marts.injected_events.count() == 410
    sizes = marts.event_lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_questions_of_one_conversations_file_are_read_by_several_tasks(uncoalesced, tmp_path):
    turns = uncoalesced.range(300).select(
        F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("how much revenue "), "id").alias("text")
    )
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    asked = telemetry(Warehouse(uncoalesced, str(tmp_path)))
    assert asked.where(~F.col("message_id").endswith("-f")).count() == 300
    assert asked.groupBy(F.spark_partition_id()).count().count() > 1
