"""The deduplicated events as a table that every run of a stream merges into, reading the touched dates only."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.operators import clickstream
from tallyloom.operators.quality import clean_rows
from tallyloom.session import write_and_read
from tallyloom.streaming.ingest import event_stream

KEPT = [
    "event_id", "session_id", "visitor_id", "event_type", "stock_code", "event_ts", "referrer", "pii_detected", "is_v2",
]
SCHEMA = (
    "event_id STRING, session_id STRING, visitor_id STRING, event_type STRING, stock_code STRING, event_ts STRING, referrer STRING, "
    "pii_detected BOOLEAN, is_v2 BOOLEAN, merged_as STRING, event_date DATE, batch BIGINT"
)


def redacted(lines: DataFrame, accept_v3: bool = False) -> DataFrame:
    """Clean events with their date; addresses in referrers are gone before anything is kept."""
    address = F.coalesce(F.col("referrer").rlike(fv.EMAIL_PATTERN), F.lit(False))
    events = clean_rows(clickstream.tagged_events(lines, accept_v3)).withColumns(
        {"pii_detected": address, "referrer": F.regexp_replace("referrer", fv.EMAIL_PATTERN, fv.REDACTION)}
    )
    return events.select(*KEPT, F.col("event_ts").try_cast("date").alias("event_date"))


class MergedEvents:
    """A table under ``out``, one folder for each date and batch of the stream; nothing in it is ever changed.

    A batch adds the events that are new and the copies that come before the kept one in the total order of
    ``first_per_event``; a reader takes the first copy of each id. Copies of one event lie at most ``bound_days`` apart,
    so a batch reads the dates of its own rows and that many around them; ``settle`` in ``dedup`` looks further. The
    folders of a batch are its own, so a batch that is run again after a failure replaces what it had written.
    """

    def __init__(self, spark: SparkSession, out: str, bound_days: int = -(-fv.LATE_BOUND_HOURS // 24)):
        self.spark, self.out, self.bound = spark, out, bound_days

    def stored(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.out)
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(SCHEMA).parquet(self.out) if there else self.spark.createDataFrame([], SCHEMA)

    def near(self, dates: list[date], batch_id: int) -> DataFrame:
        """What earlier batches kept on these dates and around them; other folders are not opened."""
        window = sorted({d + timedelta(days=k) for d in dates for k in range(-self.bound, self.bound + 1)})
        return self.stored().where(F.col("event_date").isin(window) & (F.col("batch") != batch_id))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        fresh = write_and_read(clickstream.first_per_event(redacted(batch)), "batch")  # read for its dates and for its rows
        dates = [r[0] for r in fresh.select("event_date").distinct().collect()]
        if not dates:
            return
        last = self.stored().agg(F.max("event_date")).first()[0]  # of folder names alone
        old = self.near(dates, batch_id)
        both = fresh.withColumn("_new", F.lit(True)).unionByName(old.select(*KEPT, "event_date").withColumn("_new", F.lit(False)))
        known = old.select("event_id").distinct().withColumn("_known", F.lit(True))
        late = F.col("event_date") < F.lit(last - timedelta(days=self.bound) if last else None).cast("date")
        kind = F.when(F.col("_known"), "replaced").when(F.coalesce(late, F.lit(False)), "late").otherwise("new")
        # a kept row comes before an equal new one, so a copy adds nothing
        winners = clickstream.first_per_event(both, ["_new"]).where("_new").join(known, "event_id", "left")
        added = winners.select(*KEPT, kind.alias("merged_as"), "event_date", F.lit(batch_id).cast("long").alias("batch"))
        added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(self.out)

    def run(self, folder: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
        """Merge what has arrived since the last run; returns the events as they are now."""
        query = (
            event_stream(self.spark, folder, files_per_batch).writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.events()

    def events(self) -> DataFrame:
        """One row per event: the same rows as the batch dedup of everything that has landed."""
        return clickstream.first_per_event(self.stored(), ["batch"]).select(*KEPT).withColumn("event_ts", F.col("event_ts").try_cast("timestamp"))
