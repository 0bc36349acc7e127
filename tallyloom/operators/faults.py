"""Labelled fault injection over an event table.

Each fault is a deterministic column expression on the event's own number, so the same input always
gives the same dirty rows and the same labels, on any number of executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FaultPlan:
    """One event in N gets the fault; 0 switches it off."""

    bot_visitor_every: int = 25
    bot_views: int = 40
    leak_every: int = 101
    late_every: int = 50
    camel_every: int = 10
    envelope_every: int = 17
    truncate_every: int = 199
    copy_every: int = 33


CLEAN = FaultPlan(0, 0, 0, 0, 0, 0, 0, 0)


def hit(n: int, key: str = "fault_key") -> Column:
    return F.lit(False) if n == 0 else F.col(key) % n == 0


def inject(events: DataFrame, plan: FaultPlan = FaultPlan()) -> DataFrame:
    """Events with their faults: version 0 is a truncated line, 1 flat, 2 camel case, 3 envelope."""
    is_bot = hit(plan.bot_visitor_every, "visitor_seed")
    views = events.withColumn("is_bot_truth", is_bot).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.when(is_bot, plan.bot_views - 1).otherwise(0)))
    )
    bots = views.select(
        F.when(F.col("is_bot_truth"), F.concat_ws("-", "event_id", F.col("step").cast("string")))
        .otherwise(F.col("event_id"))
        .alias("event_id"),
        "session_id",
        "visitor_id",
        F.when(F.col("is_bot_truth"), "view").otherwise(F.col("event_type")).alias("event_type"),
        "stock_code",
        (F.col("event_ts") + F.make_dt_interval(secs=F.col("step") * 2)).alias("event_ts"),
        "referrer",
        F.col("visitor_seed"),
        F.when(F.col("is_bot_truth"), F.col("seed") * 64 + F.col("step")).otherwise(F.col("seed")).alias("fault_key"),
        "is_bot_truth",
    )
    late = hit(plan.late_every)
    leak = hit(plan.leak_every)
    version = (
        F.when(hit(plan.truncate_every), 0).when(hit(plan.envelope_every), 3).when(hit(plan.camel_every), 2).otherwise(1)
    )
    leaked = F.concat(
        F.lit("https://shop.example.com/track?email=user"), F.col("visitor_seed").cast("string"), F.lit("@example.com")
    )
    shift = F.make_dt_interval(hours=(F.col("fault_key") % 66 + 6).cast("int"))
    return bots.select(
        "event_id",
        "session_id",
        "visitor_id",
        "event_type",
        "stock_code",
        F.when(late, F.col("event_ts") - shift).otherwise(F.col("event_ts")).alias("event_ts"),
        F.when(leak, leaked).otherwise(F.col("referrer")).alias("referrer"),
        version.alias("schema_version"),
        F.when(hit(plan.copy_every), 2).otherwise(1).alias("copies"),
        F.array_compact(
            F.array(
                F.when(F.col("is_bot_truth"), "bot_session"),
                F.when(leak, "pii_leak"),
                F.when(late, "late"),
                F.when(version == 2, "schema_drift"),
                F.when(version == 0, "malformed"),
                F.when(version == 3, "schema_v3"),
            )
        ).alias("labels"),
    )


def as_lines(injected: DataFrame) -> DataFrame:
    """The dirty feed: one JSON text per line, copies repeated, truncated lines cut in half."""
    ts = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss")
    flat = F.to_json(
        F.struct(
            "event_id", "session_id", "visitor_id", "event_type", "stock_code", ts.alias("event_ts"), "referrer",
            F.lit("Mozilla/5.0").alias("user_agent"), F.lit(1).alias("schema_version"),
        )
    )
    camel = F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"), F.col("session_id").alias("sessionId"),
            F.col("visitor_id").alias("visitorId"), F.col("event_type").alias("eventType"),
            F.col("stock_code").alias("stockCode"), ts.alias("eventTs"), "referrer",
            F.lit("GBP").alias("currency"), F.lit(2).alias("schemaVersion"),
        )
    )
    envelope = F.to_json(
        F.struct(
            F.struct(F.col("event_id").alias("eventId"), ts.alias("ts"), F.lit(3).alias("sv")).alias("meta"),
            F.struct(F.col("visitor_id").alias("visitorId"), F.col("session_id").alias("sessionId")).alias("actor"),
            F.struct(F.col("event_type").alias("type"), F.col("stock_code").alias("sku")).alias("action"),
            F.struct("referrer", F.lit("web").alias("channel")).alias("context"),
        )
    )
    version = F.col("schema_version")
    line = (
        F.when(version == 3, envelope)
        .when(version == 2, camel)
        .when(version == 0, F.substring(flat, F.lit(1), F.floor(F.length(flat) / 2).cast("int")))
        .otherwise(flat)
    )
    return injected.select(line.alias("value"), F.explode(F.sequence(F.lit(1), "copies"))).select("value")


def ground_truth(injected: DataFrame) -> DataFrame:
    """Label rows ``(event_id, labels)``; an emitted copy has a row of its own."""
    copy_label = F.when(F.col("copies") > 1, F.array(F.lit("duplicate")))
    rows = F.filter(F.array_compact(F.array("labels", copy_label)), lambda one: F.size(one) > 0)
    return injected.select("event_id", F.explode(rows).alias("labels"))
