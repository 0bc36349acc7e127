"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}
# For a job that writes one table after the other: the files of a shuffle go with the write that made them instead of
# when the driver happens to collect garbage, and two folders are written side by side without a sort by folder. Tasks
# read ``SPLIT`` bytes at most: packed tables are several times as large in memory, and what a task sorts is not to spill.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "2",
}
SPLIT = 32 << 20
# Parquet tables that stay; cut by rows, since few packed bytes can be much work for one task.
PACKED = {"compression": "zstd", "maxRecordsPerFile": 1_000_000}


def build_session(app: str = "tallyloom", master: str | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of a job that writes one table after the other, for as long as the block runs."""
    split = min(SPLIT, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    settings = WRITING | {"spark.sql.files.maxPartitionBytes": str(split)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, for they need not find it where they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "tallyloom.zip")  # read by the driver alone, which serves it to all
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for written intermediates, deleted when the application ends.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``, or, where that is unset, beside the
    tables of the warehouse; both are shared by all executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        root = f"{base.rstrip('/')}/scratch-{app}"
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _scratch[app] = root
    return _scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a written table: later reads survive a lost executor, and a value that
    is fixed only at run time (such as a partition number) is the same for every reader."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
