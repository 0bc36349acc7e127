"""Event dedup as a stream with a bound on its state, and a batch pass that makes the result whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.operators import clickstream
from tallyloom.operators.quality import clean_rows
from tallyloom.streaming.ingest import event_stream

COLUMNS = ["event_id", "session_id", "event_type", "event_ts"]


def deduplicated(lines: DataFrame, accept_v3: bool = False, bound_hours: int = fv.LATE_BOUND_HOURS) -> DataFrame:
    """Clean events, one per id among those that arrive within the bound. The state holds an id only
    until the watermark passes it, so it is bounded by the traffic of the bound and not by history.
    Events later than the bound do not get through here; ``settle`` finds them in what has landed. Addresses in
    referrers are redacted before a row is kept."""
    events = clean_rows(clickstream.tagged_events(lines, accept_v3)).withColumns(
        {"event_ts": F.col("event_ts").try_cast("timestamp"), "referrer": F.regexp_replace("referrer", fv.EMAIL_PATTERN, fv.REDACTION)}
    )
    return events.withWatermark("event_ts", f"{bound_hours} hours").dropDuplicatesWithinWatermark(["event_id"])


def run_dedup(spark: SparkSession, folder: str, out: str, checkpoint: str, bound_hours: int = fv.LATE_BOUND_HOURS) -> DataFrame:
    """Process what has arrived since the last run; returns the table of kept events."""
    query = (
        deduplicated(event_stream(spark, folder), bound_hours=bound_hours)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def settle(landed_lines: DataFrame, kept: DataFrame, accept_v3: bool = False) -> DataFrame:
    """Rows to add or to replace so that the stream's table equals the batch result, with ``settled_as``: ``late`` for
    events that came after the bound, ``replaced`` where another copy than the first to arrive is the one to keep.

    One anti join of the batch dedup of everything landed against the kept rows, by id and digest of the row.
    """
    whole = clickstream.silver_events(clickstream.tagged_events(landed_lines, accept_v3))
    digest = F.xxhash64(*COLUMNS)
    known = kept.select("event_id", digest.alias("_kept"))
    return (
        whole.withColumn("_now", digest).join(known, "event_id", "left")
        .where(F.col("_kept").isNull() | (F.col("_kept") != F.col("_now")))
        .withColumn("settled_as", F.when(F.col("_kept").isNull(), "late").otherwise("replaced"))
        .drop("_kept", "_now")
    )


def settled_events(kept: DataFrame, settled: DataFrame) -> DataFrame:
    """The stream's events with the settled rows put in: the same rows as the batch dedup."""
    rest = kept.select(*COLUMNS).join(settled.where("settled_as = 'replaced'").select("event_id"), "event_id", "left_anti")
    return rest.unionByName(settled.select(*COLUMNS))
