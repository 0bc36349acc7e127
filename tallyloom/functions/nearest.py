"""Exact nearest rows for a whole table of probes: blocks of probes against blocks of rows, the best of each block merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROBES = 4096  # probes that one task holds
ROWS = 65_536  # rows, about, that stream past them in one task
LEAST_ROWS = 4096  # fewer rows are not worth a task of their own
AT_ONCE = 512
DIGITS = 6  # of a similarity; equal ones are in the order of the keys


def _directions(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors in double precision; null vectors and those with null or non-finite components or no length
    have no direction and take no part. Neither do rows without a key."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v")).where("key is not null and v is not null").where(sound)


def _unit(column: pa.ListArray) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Best:
    """The first ``k`` rows of each probe by (similarity descending, key), of what has been added."""

    def __init__(self, k: int):
        self.k, self.probe, self.key, self.near = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, probe: np.ndarray, key: np.ndarray, near: np.ndarray) -> None:
        probe, key, near = np.append(self.probe, probe), np.append(self.key, key), np.append(self.near, near)
        order = np.lexsort((key, -near, probe))
        probe, key, near = probe[order], key[order], near[order]
        kept = np.arange(len(probe)) - np.searchsorted(probe, probe) < self.k
        self.probe, self.key, self.near = probe[kept], key[kept], near[kept]


def nearest(rows: DataFrame, probes: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(probe, place, row, similarity): for each probe the ``k`` rows with the largest cosine, its own key left out.

    All vectors have one length. A task holds one block of probes and streams one block of rows past it, keeping ``k``
    rows for each probe, so memory is bounded and no result is lost: each side is written once for each block of the
    other, and what is merged is ``k`` rows for each probe and block. Fewer rows than ``k`` give all of them.
    """
    spark = rows.sparkSession
    all_rows, asked = _directions(rows, key, vector), _directions(probes, key, vector)
    n = rows.count()
    row_blocks = max(1, -(-n // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS))
    probe_blocks = max(1, -(-probes.count() // PROBES))
    one = asked.select(
        F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.xxhash64("key"), F.lit(probe_blocks)).cast("int").alias("pb"), "key", "v"
    )
    two = all_rows.select(
        F.lit(1).alias("side"), F.pmod(F.xxhash64("key"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(probe_blocks - 1))).alias("pb"), "key", "v"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, vectors, best = None, [], [], _Best(k)

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(best.probe, pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.near, pa.float64())], ["probe", "row", "similarity"])

        for batch in batches:
            place = np.stack([batch[c].to_numpy() for c in ("rb", "pb", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if tuple(place[begin, :2]) != held:
                    yield result()
                    held, keys, vectors, best = tuple(place[begin, :2]), [], [], _Best(k)
                part = batch.slice(begin, end - begin)
                if place[begin, 2] == 0:
                    keys.append(part["key"].to_numpy())
                    vectors.append(_unit(part["v"]))
                    continue
                if not keys:
                    continue
                if len(keys) > 1:
                    keys, vectors = [np.concatenate(keys)], [np.concatenate(vectors)]
                ids, units = part["key"].to_numpy(), _unit(part["v"])
                for at in range(0, len(keys[0]), AT_ONCE):
                    names = keys[0][at : at + AT_ONCE]
                    near = np.round(units @ vectors[0][at : at + AT_ONCE].T, DIGITS)
                    near[ids[:, None] == names[None, :]] = -np.inf
                    least = np.partition(near, max(0, len(ids) - k), axis=0)[max(0, len(ids) - k)]
                    row, probe = np.nonzero((near >= least[None, :]) & (near > -np.inf))  # ties stay together
                    best.add(names[probe], ids[row], near[row, probe])
        yield result()

    met = one.unionByName(two).repartition(row_blocks * probe_blocks, "rb", "pb").sortWithinPartitions("rb", "pb", "side")
    found = met.mapInArrow(compare, "probe long, row long, similarity double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("similarity"), "row"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("probe", "place", "row", "similarity")
