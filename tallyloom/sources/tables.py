"""Table writes without a table format that knows MERGE: versioned snapshots and append-only logs.

A mutable table is a folder of complete versions. A change writes the next version into a fresh folder and publishes it
by a commit record; a reader always sees one whole version, and a job that dies half-way leaves a folder that nobody
reads and the next change does not meet. Two changes of one version cannot both commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ConcurrentChange(RuntimeError):
    """Another writer has published a version since this one read the table."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def _place(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first. This lists commit records, not data."""
        path, files = self._place()
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("commit="))

    def _folder(self, version: int) -> str:
        path, files = self._place(f"commit={version:08d}")
        record = files.open(path)
        try:
            return f"{self.root}/{record.readUTF()}"
        finally:
            record.close()

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(self._folder(known[-1] if version is None else version))

    def publish(self, df: DataFrame, base: int | None = None) -> int:
        """Write the version after ``base`` (the latest unless named); also how a full rebuild replaces rows and
        schema. The commit record is created only if no other writer has created it."""
        version = ((self.versions() or [0])[-1] if base is None else base) + 1
        name = f"data-{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        path, files = self._place(f"commit={version:08d}")
        if files.exists(path):
            raise ConcurrentChange(f"version {version} of {self.root} was published by another writer")
        try:
            record = files.create(path, False)
        except Exception as error:  # created between the two calls
            raise ConcurrentChange(f"version {version} of {self.root} was published by another writer") from error
        record.writeUTF(name)
        record.close()
        return version

    def change(self, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        base = (self.versions() or [0])[-1]
        self.publish(step(self.read(base or None)), base)
        return self.read()

    def restore(self, version: int) -> int:
        return self.publish(self.read(version))


class AppendLog:
    """Append-only table whose schema may gain columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def append_unseen(self, df: DataFrame, key: str) -> None:
        """Append the rows whose key the log does not hold yet, once each: a retry adds nothing."""
        fresh = df.dropDuplicates([key])
        self.append(fresh.join(self.read().select(key), key, "left_anti").select(*df.columns) if self.exists() else fresh)

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)


def row_id(*columns: str) -> Column:
    """A digest of the named columns, NULL and its neighbours told apart."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


# ---- merges: pure functions of (old rows, new rows) ----------------------------------------------


def one_per_key(batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; the cut happens in every task before the shuffle as well."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return batch.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def insert_only(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old rows stay untouched; unseen keys are added once."""
    fresh = one_per_key(new, key, order).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert(
    old: DataFrame, new: DataFrame, key: list[str], refresh: list[str], keep: dict[str, object] | None = None
) -> DataFrame:
    """Matched rows take ``refresh`` from the new side and keep their ``keep`` columns; unmatched new
    rows start with the ``keep`` defaults. Both sides hold one row per key."""
    keep = keep or {}
    left = old.withColumn("_old", F.lit(True)).alias("o")
    right = new.withColumn("_new", F.lit(True)).alias("n")
    joined = left.join(right, key, "full_outer")
    taken = [
        F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in refresh
    ]
    kept = [F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.lit(v)).alias(c) for c, v in keep.items()]
    return joined.select(*key, *taken, *kept)


def update_only(old: DataFrame, changes: DataFrame, key: list[str], guard: Column | None = None) -> DataFrame:
    """Listed keys take the changed columns; no row is added or removed. ``guard`` is a condition on
    the old row that must hold too."""
    changed = [c for c in changes.columns if c not in key]
    guarded = old.withColumn("_open", F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    joined = guarded.alias("o").join(changes.withColumn("_hit", F.lit(True)).alias("n"), key, "left")
    moved = F.coalesce(F.col("n._hit") & F.col("o._open"), F.lit(False))

    def after(c: str) -> Column:
        if c in key:
            return F.col(c)
        if c in changed:
            return F.when(moved, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.col(f"o.{c}")

    return joined.select(*[after(c) for c in old.columns])


def guarded_transition(
    old: DataFrame, moves: DataFrame, key: list[str], expected: str, state: str = "status"
) -> DataFrame:
    """Only rows now in the expected state move, so a decision made earlier is never overwritten.
    ``moves`` has one row per key and the new values."""
    return update_only(old, moves, key, F.col(state) == expected)


def change_log(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a change did: (key, change, before, after), one row for each key that came, went or got other values. Both
    sides hold one row per key; NULLs are values like any other."""
    rest = [c for c in old.columns if c not in key]
    before = old.select(*key, F.struct(*rest).alias("before"))
    after = new.select(*key, F.struct(*rest).alias("after"))
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return before.join(after, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(*key, kind.alias("change"), "before", "after")


def undo(now: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """The table without a logged change, and with all that has changed since.

    A column goes back to what it was where it still holds what the change gave it; a row that the change added goes if
    nothing has touched it since, and a row it removed comes back if its key is free. Undoing twice is undoing once.
    """
    rest = [c for c in now.columns if c not in key]
    current = now.select(*key, F.struct(*rest).alias("_now"))
    met = current.join(log, key, "full_outer")
    kind, was, became = F.col("change"), F.col("before"), F.col("after")

    def settled(c: str) -> Column:
        back = (kind == "update") & F.col("_now")[c].eqNullSafe(became[c])
        return F.when(F.col("_now").isNull(), was[c]).when(back, was[c]).otherwise(F.col("_now")[c]).alias(c)

    gone = F.coalesce((kind == "insert") & F.col("_now").eqNullSafe(became), F.lit(False))
    there = F.col("_now").isNotNull() | (kind == "delete")
    return met.where(there & ~gone).select(*key, *[settled(c) for c in rest]).select(*now.columns)


def with_columns_of(spark: SparkSession, table: str, wanted: dict[str, str]) -> DataFrame:
    """Read a catalog table defensively: a missing table gives no rows, a missing column gives NULL.
    The check looks at the schema while the plan is built and reads no data."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in wanted.items()))
    df = spark.table(table)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def table_from_query(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """CREATE OR REPLACE TABLE name AS the query; with a path as an external table there."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
