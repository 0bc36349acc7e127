"""Exact global ranks and tiles without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import write_and_read


def ranged_table(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """The rows range partitioned on the whole order key and written out with their range number.

    Ties on the leading column are split by the rest of the key, so a value shared by a third of the
    rows cannot fill one range. The number is only known at run time and is used twice, hence the write.
    """
    return write_and_read(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)


def numbered(ranged: DataFrame, order: list[Column]) -> DataFrame:
    """Number the rows inside each range and shift by the row counts of the earlier ranges. The
    offsets have one row per range, so broadcasting them is bounded by the partition count."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy()))
        .drop("_n")
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_range", "_before")
    )


def global_rank(df: DataFrame, order: list[Column], label: str = "rank") -> DataFrame:
    """Add ``_rank`` (1-based, exact) and ``_total`` in the given total order. A window without
    PARTITION BY would pull every row into one task; here many tasks share the work."""
    return numbered(ranged_table(df, order, label), order)


SPLITTERS = 128  # rows drawn to cut the table into ranges; a range with a wanted rank is sorted by one task


def cut_rows(keyed: DataFrame, ranks: Callable[[Column], Column]) -> DataFrame:
    """(part, rank, key): the rows that stand at the wanted ranks of each part. ``keyed``: (part, range, key), where
    ranges are numbered in the order of the keys; ``ranks``: a part's number of rows -> array of ranks from 1 on.

    Ranges are counted (one row for each part and range), and only those that hold a wanted rank are sorted.
    """
    counts = keyed.groupBy("part", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("range")) - F.col("n")
    placed = counts.select("part", "range", "n", before.alias("before"), F.sum("n").over(Window.partitionBy("part")).alias("total"))
    wanted = placed.select("part", "range", "before", "n", F.explode(F.array_distinct(ranks(F.col("total")))).alias("rank"))
    wanted = wanted.where("rank > before and rank <= before + n").select("part", "range", "rank", (F.col("rank") - F.col("before")).alias("_at"))
    inside = F.row_number().over(Window.partitionBy("part", "range", "rank").orderBy("key"))
    return keyed.join(wanted, ["part", "range"]).withColumn("_nth", inside).where("_nth = _at").select("part", "rank", "key")


def tiles_by_cuts(df: DataFrame, measures: dict[str, Column], tie: list[str], tiles: int) -> DataFrame:
    """NTILE over the whole table for several numeric measures at once: adds a column for each, rows in ascending order
    of the measure and then of the ``tie`` columns; the first ``total % tiles`` tiles take one row more.

    The rows stay where they are: the rows at the tiles' last ranks are found by counting ranges, and a row's tile is
    the number of those below it. The ranges come from ``SPLITTERS`` rows drawn by a hash of their keys, so a value that
    a third of the rows share is split by the rest of the key. All of it is one plan, without a table in between.
    Rows that agree in the whole key are in one tile.
    """
    keys = [F.struct(c.cast("decimal(38,6)").alias("measure"), *[F.col(t) for t in tie]) for c in measures.values()]
    drawn = df.select(F.array(*keys).alias("k")).orderBy(F.xxhash64("k"), "k").limit(SPLITTERS)
    lists = drawn.select(F.posexplode("k").alias("part", "key")).groupBy("part").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    splitters = lists.agg(F.array_sort(F.collect_list(F.struct("part", "keys")))).scalar()
    stacked = df.select(F.posexplode(F.array(*keys)).alias("part", "key")).withColumn("_all", splitters)
    below = F.size(F.filter(F.element_at("_all", F.col("part") + 1)["keys"], lambda s: s <= F.col("key")))

    def last_ranks(total: Column) -> Column:
        return F.array(*[F.floor(total / tiles) * t + F.least(F.lit(t), total % tiles) for t in range(1, tiles)])

    cuts = cut_rows(stacked.withColumn("range", below).drop("_all"), last_ranks)
    ends = cuts.groupBy("part").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ends = ends.agg(F.map_from_entries(F.collect_list(F.struct("part", "keys")))).scalar()

    def tile(part: int, key: Column) -> Column:
        return (1 + F.size(F.filter(F.try_element_at("_ends", F.lit(part)), lambda c: c < key))).cast("int")

    with_ends = df.withColumn("_ends", ends)
    return with_ends.withColumns({name: tile(part, key) for part, (name, key) in enumerate(zip(measures, keys, strict=True))}).drop("_ends")
