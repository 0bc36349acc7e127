"""The medallion refresh as a job: every layer is written once and the next one reads what was written.

A run writes into a folder of its own and is published at the end by one new file, so readers see the layers of one run
and a run that fails leaves the last published one in place. The rule counts of a run are observed while its rows flow
to their tables; landing file and time of a row go with it into quarantine.

On disk a run is its packed tables and the shuffles of the layers that are being written: a shuffle goes with its write.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.operators import clickstream, quality, sales
from tallyloom.plans.marts import Marts
from tallyloom.session import PACKED, writing
from tallyloom.sources.warehouse import Warehouse
from tallyloom.streaming import ingest

STORED = [
    "silver_sales", "quarantine_sales", "dim_products", "fact_sales", "daily_revenue", "customer_rfm",
    "silver_events", "quarantine_events", "sessions", "funnel_daily",
]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish(spark: SparkSession, root: str, run: str) -> None:
    """Name a finished run. Creating the file is the one step that readers can see."""
    files, place = _files(spark, f"{root}/_published/{run}")
    files.create(place, False).close()


def published(spark: SparkSession, root: str) -> str:
    """The folder of the last published run; runs are named by the time they began."""
    files, place = _files(spark, f"{root}/_published")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    if not names:
        raise FileNotFoundError(f"no published run under {root}")
    return f"{root}/{max(names)}"


def _store(df: DataFrame, home: str, name: str) -> DataFrame:
    path = f"{home}/{name}"
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split(tagged: DataFrame, rules: quality.Rules, home: str, name: str) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """Tag once, write by verdict, read the halves by partition: neither half repeats the tagging. The rows of each rule
    are counted on their way; returns the table, its quarantined half and (feed, rule, passed, failed). Every rule is
    tested once for a row, where its name comes into the list of reasons: verdict and counts read the list."""
    path = f"{home}/{name}"
    tagged = tagged.withColumn("is_quarantined", F.size("quarantine_reasons") > 0)
    listed = {rule: ~F.array_contains("quarantine_reasons", rule) for rule in rules}
    watched, seen = quality.observed(tagged, listed, f"{name}-{uuid.uuid4().hex}")
    watched.write.options(**PACKED).partitionBy("is_quarantined").parquet(path)
    failed = dict(seen.get)
    rows = failed.pop("rows")
    stored = tagged.sparkSession.read.schema(tagged.schema).parquet(path)
    return stored, stored.where(F.col("is_quarantined")), [(name.removeprefix("tagged_"), rule, rows - n, n) for rule, n in failed.items()]


def _together(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Independent branches side by side, so that one fills the cores that the last tasks of another leave free."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def refresh(
    bronze_sales: DataFrame, event_lines: DataFrame, root: str,
    accept_v3: bool = False, bot_min_views: int = fv.BOT_MIN_VIEWS,
) -> list[str]:
    """Bronze → tagged → silver and quarantine → gold, in a new run under ``root``. Returns the table names.

    ``expectations`` (feed, rule, passed, failed) is written beside them.
    """
    spark = bronze_sales.sparkSession
    run = f"run-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    home = f"{root}/{run}"
    counted: dict[str, list[tuple]] = {}

    def sales_layers() -> None:
        tagged, bad, counted["sales"] = _split(sales.tagged_sales(bronze_sales), quality.sales_rules(), home, "tagged_sales")

        def gold() -> None:
            silver = _store(sales.silver_sales(tagged), home, "silver_sales")

            def of_facts() -> None:
                facts = _store(sales.fact_sales(silver), home, "fact_sales")
                for name, of in (("daily_revenue", sales.daily_revenue), ("customer_rfm", sales.customer_rfm)):  # each shuffles much of the facts
                    _store(of(facts), home, name)

            _together(spark, of_facts, lambda: _store(sales.dim_products(silver), home, "dim_products"))

        _together(spark, gold, lambda: _store(bad, home, "quarantine_sales"))

    def event_layers() -> None:
        tagged, bad, counted["events"] = _split(clickstream.tagged_events(event_lines, accept_v3), quality.event_rules(), home, "tagged_events")

        def gold() -> None:
            silver = _store(clickstream.silver_events(tagged), home, "silver_events")
            sessions = _store(clickstream.sessions(silver, bot_min_views), home, "sessions")
            _store(clickstream.funnel_daily(sessions), home, "funnel_daily")

        _together(spark, gold, lambda: _store(bad, home, "quarantine_events"))

    with writing(spark):
        _together(spark, sales_layers, event_layers)
        counts = spark.createDataFrame(counted["sales"] + counted["events"], "feed STRING, rule STRING, passed BIGINT, failed BIGINT")
        _store(counts, home, "expectations")
    publish(spark, root, run)
    return STORED


def refresh_landed(
    spark: SparkSession, sales_folder: str, events_folder: str, root: str,
    accept_v3: bool = False, bot_min_views: int = fv.BOT_MIN_VIEWS,
) -> list[str]:
    """Take in the files that have landed since the last time, then refresh from all of bronze. Bronze tables and the
    checkpoints that tell new files from old ones lie under ``root``."""
    with writing(spark):
        bronze = ingest.ingest_sales(spark, sales_folder, f"{root}/bronze_sales", f"{root}/_marks/sales")
        lines = ingest.ingest_events(spark, events_folder, f"{root}/bronze_events", f"{root}/_marks/events")
    return refresh(bronze, lines, root, accept_v3, bot_min_views)


class StoredMarts(Marts):
    """The same graph read from the tables of the run that was published last when this was made; only what lies above
    them is derived."""

    def __init__(self, spark: SparkSession, root: str, tables: Warehouse):
        super().__init__(tables)
        self.home = published(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}")

    @property
    def expectations(self) -> DataFrame:
        return self.table("expectations")


def _stored(name: str) -> cached_property:
    prop = cached_property(lambda self: self.table(name))
    prop.__set_name__(StoredMarts, name)
    return prop


for _name in STORED:
    setattr(StoredMarts, _name, _stored(_name))


__all__ = ["STORED", "StoredMarts", "publish", "published", "refresh", "refresh_landed"]
