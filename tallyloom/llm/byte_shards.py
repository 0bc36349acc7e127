"""Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import written

ROW_OVERHEAD = 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus a fixed 16) and the text's unsigned CRC-32; null text: no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard(rows: DataFrame, shards: int = 40, key: str = "doc_id", size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard) in the order of ``key``.

    Rows are range partitioned on the key and written once with their partition number, for a range boundary
    is sampled anew each time it is computed. The totals per partition (one row for each partition) are summed
    up in front of each partition, and a running sum within it gives every row's global byte position. A row
    belongs to the shard in which its first byte lies: shard k holds positions from k/shards to (k+1)/shards of
    the total, so no shard differs from the target by more than one row at each end. Rows with one key keep any
    order among themselves, fixed by the other columns; no rows give no rows.
    """
    others = sorted(c for c in rows.columns if c != key)
    cut = rows.repartitionByRange(key, *others).withColumn("_part", F.spark_partition_id())
    cut, _ = written(cut, "sized")
    per_part = cut.groupBy("_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(key, *others)
    placed = (
        cut.withColumn("_sum", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn("_from", F.col("_bytes_before") + F.col("_sum") - F.col(size))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(_from * {shards} div greatest(_total, 1) as int)")))
        .withColumn("_at", F.col("_rows_before") + F.col("_row") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        *rows.columns, "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )
