"""Admin monitoring over query history and the audit ledger, and dashboard datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent, ratio

PREVIEW, LABEL = 200, 120


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def recent(history: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Rows since ``now`` minus some days. The bound is a constant, so it reaches the scan."""
    return history.where(F.col("start_time") >= at(now) - F.expr(f"INTERVAL {days} DAYS"))


def top_users(history: DataFrame, now: str, n: int = 10) -> DataFrame:
    return (
        recent(history, now)
        .groupBy("executed_by")
        .agg(
            F.count(F.lit(1)).alias("statements"),
            F.sum("total_duration_ms").alias("total_duration_ms"),
            ratio(F.sum("total_duration_ms"), F.count("total_duration_ms"), 0).alias("avg_duration_ms"),
        )
        .orderBy(F.desc("total_duration_ms"), "executed_by")
        .limit(n)
    )


TIE = ["executed_by", "start_time", "statement_text"]


def slowest(history: DataFrame, now: str, n: int = 20) -> DataFrame:
    return (
        recent(history, now)
        .orderBy(F.desc("total_duration_ms"), *TIE)
        .limit(n)
        .select(
            "start_time", "executed_by", "client_application", "execution_status", "total_duration_ms",
            F.left("statement_text", F.lit(PREVIEW)).alias("statement_preview"),
        )
    )


def repeated_failures(history: DataFrame, now: str, days: int = 7, at_least: int = 2, n: int = 20, label: int = LABEL) -> DataFrame:
    """Failures by user and whole statement, compared in lower case with white space runs as one blank. The label shows
    the first ``label`` characters."""
    whole = F.trim(F.regexp_replace(F.lower("statement_text"), r"\s+", " "))
    return (
        recent(history, now, days)
        .where(F.col("execution_status") == "FAILED")
        .groupBy(F.sha2(whole, 256).alias("statement_fingerprint"), "executed_by")
        .agg(F.min(F.left("statement_text", F.lit(label))).alias("statement_label"), F.count(F.lit(1)).alias("failures"), F.max("start_time").alias("last_seen"))
        .where(F.col("failures") >= at_least)
        .orderBy(F.desc("failures"), "statement_fingerprint", "executed_by")
        .limit(n)
    )


def source_share(history: DataFrame, now: str, assistant: str = "Assistant") -> DataFrame:
    """Statements per client with their share. The window runs over one row per client."""
    client = F.when(F.col("client_application") == assistant, "assistant").otherwise(
        F.coalesce("client_application", F.lit("unknown"))
    )
    counts = recent(history, now).groupBy(client.alias("source")).agg(
        F.count(F.lit(1)).alias("statements"), F.sum("total_duration_ms").alias("total_duration_ms")
    )
    share = percent("statements", F.sum("statements").over(Window.partitionBy()), 2)
    return counts.select("source", "statements", share.alias("pct_of_statements"), "total_duration_ms").orderBy(
        F.desc("statements"), "source"
    )


def largest_scans(history: DataFrame, now: str, n: int = 20) -> DataFrame:
    return (
        recent(history, now)
        .orderBy(F.desc("read_bytes"), *TIE)
        .limit(n)
        .select(
            "start_time", "executed_by", "client_application", "read_bytes",
            F.round(F.col("read_bytes").cast("double") / F.pow(F.lit(1024.0), F.lit(3.0)), 2).alias("read_gib"),
            "total_duration_ms", F.left("statement_text", F.lit(PREVIEW)).alias("statement_preview"),
        )
    )


def healing_activity(ledger: DataFrame) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "ts"))
    return (
        ledger.groupBy(week.alias("week"), "approver", "action", "status")
        .agg(F.count(F.lit(1)).alias("healings"))
        .orderBy(F.desc("week"), F.desc("healings"), "approver", "action", "status")
    )


def ledger_status(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy("status")
        .agg(F.count(F.lit(1)).alias("actions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .orderBy(F.desc("actions"), "status")
    )


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.min("created_at").alias("oldest")).orderBy("status")


def oldest_pending(queue: DataFrame, n: int = 20) -> DataFrame:
    return (
        queue.where(F.col("status") == "pending")
        .orderBy("created_at", "id")
        .limit(n)
        .select("id", "kind", "term", "entity", "confidence", "distinct_users", "created_at")
    )


# ---- dashboards --------------------------------------------------------------------------------


def accuracy_trend(scores: DataFrame) -> DataFrame:
    return scores.select(
        "phase", "stratum", "correct", "total", ratio("correct", "total", 3).alias("accuracy"), "recorded_at"
    ).orderBy("recorded_at", "stratum")


def funnel_health(funnel: DataFrame) -> DataFrame:
    return funnel.select(
        "event_date", "sessions", "views", "add_to_carts", "purchases",
        F.round("session_conversion_rate", 4).alias("conversion"),
    ).orderBy("event_date")


def revenue_trend(daily: DataFrame) -> DataFrame:
    return daily.select("sale_date", "gross_revenue", "returns_value", "net_revenue", "invoices").orderBy("sale_date")


def latest_actions(ledger: DataFrame, n: int = 100) -> DataFrame:
    return (
        ledger.orderBy(F.desc("ts"), "proposal_key", "action", "target")
        .limit(n)
        .select("ts", "action", "target", "proposal_key", "status", "approver")
    )
