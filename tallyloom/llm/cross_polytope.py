"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations turn each unit vector, and the nearest signed axis is its bucket, one for each table.
A query looks into its nearest axes of every table (multiprobe); what lies there is ranked by the exact inner product
of the original vectors. Longer vectors reach a large inner product at wider angles: they are kept in bands by length,
and a longer band is probed wider, the longest compared with every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import written

ROUNDS = 3  # sign flips and Hadamard transforms of one rotation
BLOCK = 4096  # members of a bucket that one task holds
AT_ONCE = 256  # queries that are compared with them at once
EVEN = 1.001  # lengths up to this multiple of the median are one band
STEP = 1.15  # from one longer band to the next
ALL = -1  # the turn of what every query is compared with


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, in d log d steps."""
    out, width = rows.copy(), 1
    while width < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(rows), -1)
        width *= 2
    return out / np.sqrt(out.shape[1])


def rotated(rows: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """The rows, padded to a power of two, under the pseudo-rotation of one table."""
    width = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    random = np.random.default_rng([seed, turn])
    for _ in range(ROUNDS):
        out = _hadamard(out * random.choice([-1.0, 1.0], width))
    return out


def axes(rows: np.ndarray, turn: int, seed: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first; axis i and, for the negative side, width + i."""
    turned = rotated(rows, turn, seed)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def band_probes(dim: int, probes: int) -> list[int]:
    """Axes probed of each band below the one that is compared with every query; the first is that of usual lengths.

    ``probes`` is meant for up to 128 axes and grows in proportion to more. A vector of u times the usual length has the
    same inner product at 1/u of the cosine; probes grow with the square of u.
    """
    both = 2 << max(0, dim - 1).bit_length()
    first = min(both, -(-probes * max(both, 128) // 128))
    bands, u = [first], EVEN * STEP
    while first * u * u < both:
        bands.append(int(np.ceil(first * u * u)))
        u *= STEP
    return bands


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles. A null vector or id, null or non-finite components and zero take no part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, is_query: str, top: int = 20, tables: int = 4, probes: int = 28, seed: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row (``is_query`` over ``vec_id``) the nearest other rows found.

    Nearest means largest inner product in double precision, ties to the smaller vec_id. Equal vectors are one class:
    of a class only the ``top`` + 1 smallest ids can be in a result, so these are all that is kept of it, however many
    copies there are; every query keeps its own answer. Vectors of another length than the commonest take no part.
    Only directions are hashed. Vectors longer than the median are dealt to bands of their own (``band_probes``), those
    beyond the last band are compared with every query. Where scores tie, ids decide, in each block and between blocks. A query that gets
    fewer than ``top`` rows, or all others if they are fewer, is compared with all rows. A bucket beyond ``BLOCK``
    members is dealt to several tasks, and its queries to each of them; queries stream through in blocks. The classes
    are sent once for each table and the query classes once for each probe, band and block. No rows, or no queries,
    give no rows.
    """
    found, v = usable(vectors, key, vector), F.col("v")
    dim = found.select(F.size(v).alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dim["d"]
    found = found.where(F.size(v) == dim)
    own = Window.partitionBy("v").orderBy("vec_id")
    classes, _ = written(
        found.withColumn("at", F.row_number().over(own)).where(f"at <= {top + 1}").groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
        .withColumn("rep", F.element_at("members", 1)),
        "vectors",
    )
    asked, _ = written(found.where(is_query).join(classes.select("v", "rep"), "v").select("vec_id", "rep"), "asked")
    long = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    n_rows, median = classes.agg(F.sum(F.size("members")), F.percentile_approx(long, 0.5, 10000)).first()
    wide = band_probes(dim, probes)
    band = F.lit(len(wide))  # the band without hashing
    for b in reversed(range(len(wide))):
        band = F.when(long <= median * EVEN * STEP**b, b).otherwise(band)
    banded = classes.select("rep", "v", band.cast("int").alias("band"))
    present = sorted(r["band"] for r in banded.select("band").distinct().collect())  # a few, whatever the data

    def placed(as_query: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    part = batch.slice(begin, 1024)
                    rows, own = _matrix(part["v"], dim), part["band"].to_numpy()
                    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither overflow nor underflow in the length
                    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
                    for turn in [ALL, *range(tables)]:
                        for b in present:
                            if (b == len(wide)) != (turn == ALL):
                                continue
                            some = np.arange(part.num_rows) if as_query else np.flatnonzero(own == b)
                            if not len(some):
                                continue
                            near = np.zeros((len(some), 1), int) if turn == ALL else axes(rows[some], turn, seed, wide[b] if as_query else 1)
                            picked = pa.array(np.repeat(some, near.shape[1]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(near.size, turn), pa.int32()), pa.array(np.full(near.size, b), pa.int32()), pa.array(near.reshape(-1), pa.int32()), part["rep"].take(picked), part["v"].take(picked)],
                                ["turn", "band", "axis", "rep", "v"],
                            )

        return place

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, rows = None, [], []
        matrix = names = None
        for batch in batches:
            buckets = np.stack([batch[c].to_numpy() for c in ("turn", "band", "axis", "block")], axis=1)
            asks, reps = batch["asks"].to_numpy(zero_copy_only=False), batch["rep"].to_numpy()
            values = _matrix(batch["v"], dim)
            edges = np.flatnonzero(np.any(buckets[1:] != buckets[:-1], axis=1) | (asks[1:] != asks[:-1])) + 1
            for begin, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin == stop:
                    continue
                bucket = tuple(buckets[begin])
                if bucket != held:
                    held, ids, rows, matrix = bucket, [], [], None
                if not asks[begin]:
                    ids.append(reps[begin:stop])
                    rows.append(values[begin:stop])
                    continue
                if not rows:
                    continue
                if matrix is None:
                    matrix, names = np.concatenate(rows), np.concatenate(ids)
                for one in range(begin, stop, AT_ONCE):
                    q, own = values[one : min(one + AT_ONCE, stop)], reps[one : min(one + AT_ONCE, stop)]
                    rough = q @ matrix.T
                    n = min(top + 1, rough.shape[1])
                    kth = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
                    # rough products differ from exact ones by rounding; what may tie with the last one stays until ids decide
                    slack = 4e-16 * (dim + 1) * np.linalg.norm(q, axis=1) * np.linalg.norm(matrix, axis=1).max()
                    asked_at, found_at = np.nonzero(rough >= (kth - 2 * slack)[:, None])
                    score = np.zeros(len(asked_at))
                    for d in range(dim):  # one order of summation, so that a pair has one score wherever it meets
                        score += q[asked_at, d] * matrix[found_at, d]
                    order = np.lexsort((names[found_at], -score, asked_at))
                    asked_at, found_at, score = asked_at[order], found_at[order], score[order]
                    kept = np.arange(len(asked_at)) - np.searchsorted(asked_at, asked_at) <= top
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[asked_at[kept]]), pa.array(names[found_at[kept]]), pa.array(score[kept])], ["asked", "rep", "score"]
                    )

    def searched(members: DataFrame, queries: DataFrame, asked: DataFrame) -> DataFrame:
        bucket = ["turn", "band", "axis"]
        # one row for each bucket: tables times bands times twice the padded dimension, whatever the data
        blocks = members.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = members.join(F.broadcast(blocks), bucket).select(
            *bucket, F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "rep", "v"
        )
        asking = queries.join(F.broadcast(blocks), bucket).select(
            *bucket, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "rep", "v"
        )
        pairs = (
            dealt.unionByName(asking).repartition(*bucket, "block").sortWithinPartitions(*bucket, "block", "asks")
            .mapInArrow(compare, "asked long, rep long, score double")
        )
        best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
        ranked = pairs.repartition("asked").distinct().withColumn("at", F.row_number().over(best)).where(f"at <= {top + 1}")
        listed = ranked.join(classes.select("rep", "members"), "rep").select("asked", "score", F.explode("members").alias("vec_id"))
        best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
        listed = listed.withColumn("at", F.row_number().over(best)).where(f"at <= {top + 1}")
        # a query that is in its own list moves those behind it up by one
        mine = Window.partitionBy("query_id").orderBy("at")
        return (
            asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("asked")).join(listed, "asked").where("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(mine)).where(f"rank <= {top}").select("query_id", "rank", "vec_id", "score")
        )

    shape = "turn int, band int, axis int, rep long, v array<double>"
    members = banded.mapInArrow(placed(False), shape)
    queries = banded.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v", "band").mapInArrow(placed(True), shape)
    result, _ = written(searched(members, queries, asked), "nearest")
    full = result.groupBy("query_id").count().where(F.col("count") >= min(top, (n_rows or 1) - 1))
    short, _ = written(asked.join(full, asked.vec_id == full.query_id, "left_anti"), "short")
    if short.isEmpty():
        return result
    everything = classes.select(F.lit(ALL).alias("turn"), F.lit(0).alias("band"), F.lit(0).alias("axis"), "rep", "v")
    again = searched(everything, everything.join(short.select("rep").distinct(), "rep", "left_semi").select(everything.columns), short)
    return result.join(short, result.query_id == short.vec_id, "left_anti").unionByName(again)
