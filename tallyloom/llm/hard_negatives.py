"""Hard negatives by rotated one-bit codes with a deterministic interval around every estimate.

A vector is rotated and its signs are a code of one bit for each dimension. Stored beside it is its alignment, the
length of the vector along the code's direction; what is left over is rotated and coded again, for a few layers. The
inner product with an anchor is estimated from popcounts of the codes with the bit planes of the rotated, quantised
anchor. By Cauchy-Schwarz the remainder adds at most its length times the anchor's; with the anchor's quantisation error this gives an interval that holds the true score always. Rows whose
interval misses what is asked for are dropped, all others are scored in integers: no result is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import written

SCALE = 256
LARGEST = 1 << 26  # components from here on take no part: their scores need not fit a long
LAYERS = 4
PLANES = 6  # bits of an anchor's quantised component
ANCHORS = 8192  # anchors that one task holds
ROWS = 65_536  # rows, about, that stream past them in one task
LEAST_ROWS = 4096  # fewer rows are not worth a task of their own
AT_ONCE = 64  # anchors compared with rows at once
BATCH = 4096
FIRST, MOST = 128, 1024  # rows compared at once: few as long as nothing is known that later ones must reach
SEED = 11
EMPTY = np.iinfo(np.int64).min


@lru_cache(maxsize=4)
def rotations(width: int) -> list[np.ndarray]:
    """Orthogonal matrices of the layers. Anchors and rows meet in tasks of other workers, so bits must not depend on
    the machine: codes are only compared with anchors rotated anew, and the slack for rounding covers the difference."""
    return [np.linalg.qr(np.random.default_rng([SEED, width, k]).standard_normal((width, width)))[0] for k in range(LAYERS)]


def padded(dim: int) -> int:
    return -(-max(dim, 1) // 64) * 64


def codes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, remainders) of rows as wide as a multiple of 64: for each layer the signs as 64-bit words
    and the length along the code (over the root of the width), and the length of what is left."""
    n, width = vectors.shape
    left = vectors.astype(np.float64)
    codes, aligned = np.empty((n, LAYERS, width // 64), np.uint64), np.empty((n, LAYERS))
    for k, turn in enumerate(rotations(width)):
        left = left @ turn.T
        up = left >= 0
        codes[:, k] = np.packbits(up, axis=1).view(np.uint64)
        aligned[:, k] = np.abs(left).mean(axis=1)
        left = left - aligned[:, k, None] * np.where(up, 1.0, -1.0)
    return codes, aligned, np.sqrt((left * left).sum(axis=1))


class Probe:
    """Anchors ready to be compared with codes: per layer the rotated anchor on a grid of 2 ** PLANES steps."""

    def __init__(self, anchors: np.ndarray):
        turned = anchors.astype(np.float64)
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.layers = []
        for turn in rotations(anchors.shape[1]):
            turned = turned @ turn.T
            low = turned.min(axis=1)
            step = np.maximum(turned.max(axis=1) - low, 1e-300) / (2**PLANES - 1)
            grid = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
            error = np.abs(turned - low[:, None] - step[:, None] * grid).sum(axis=1)
            planes = [np.packbits(grid >> b & 1, axis=1).view(np.uint64) for b in range(PLANES)]
            self.layers.append((low, step, grid.sum(axis=1), error, planes))

    def interval(self, of: slice, codes: np.ndarray, aligned: np.ndarray, remainder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products, rows by anchors."""
        n, words = codes.shape[0], codes.shape[2]
        width, length = words * 64, self.length[of]
        shape = (n, len(length))
        both, count, part = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape)
        shared = np.empty(shape, np.uint16 if width << PLANES <= 1 << 16 else np.uint32)  # as narrow as the sums allow
        ones = np.bitwise_count(codes).sum(axis=2, dtype=np.int64)
        low, step, total, error = (np.stack([layer[k][of] for layer in self.layers]) for k in range(4))
        middle = (aligned * (2 * ones - width)) @ low - aligned @ (total * step)
        for k, layer in enumerate(self.layers):
            shared.fill(0)
            for plane in reversed(layer[4]):
                np.left_shift(shared, 1, out=shared)
                for w in range(words):
                    np.bitwise_and(codes[:, k, w, None], plane[None, of, w], out=both)
                    np.add(shared, np.bitwise_count(both, out=count), out=shared)
            np.multiply(shared, 2 * step[None, k], out=part)
            part *= aligned[:, k, None]
            middle += part
        size = np.sqrt((aligned**2).sum(axis=1) * width + remainder**2)
        half = np.outer(remainder, length) + aligned @ error
        half = half * (1 + 1e-9) + 1e-9 * (np.outer(size, length) + 1)  # rounding
        return middle - half, middle + half


def rows_of(vectors: DataFrame, label: Column | str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(256 * x), x as double.

    Rows with a null id, label or vector, with a null or non-finite component or one of 2 ** 18 and more take no part.
    The rows of a repeated id count as one, that with the least (label, v).
    """
    named = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), named.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(sound)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c * SCALE).cast("int")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.*")


def coded(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, label, v, codes, aligned, remainder): the vectors with their codes; shorter ones are filled up with zeros."""
    width = padded(dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                v = np.zeros((part.num_rows, width), np.int32)
                sizes = part["v"].value_lengths().to_numpy(zero_copy_only=False)
                v[np.arange(width) < sizes[:, None]] = part["v"].flatten().to_numpy(zero_copy_only=False)
                codes, aligned, remainder = codes_of(v)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["label"], *(pa.array([r.tobytes() for r in c], pa.binary()) for c in (v, codes, aligned)), pa.array(remainder)],
                    ["vec_id", "label", "v", "codes", "aligned", "remainder"],
                )

    return rows.mapInArrow(code, "vec_id long, label long, v binary, codes binary, aligned binary, remainder double")


def _stacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


class _Best:
    """The first ``k`` rows of each slot by (score descending, id), of what has been added."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, EMPTY)
        self.slot, self.row, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        slot, row, score = np.append(self.slot, slot), np.append(self.row, row), np.append(self.score, score)
        order = np.lexsort((row, -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.k
        last = rank == self.k - 1
        self.floor[slot[last]] = score[last]  # what is below it can be left out from now on
        self.slot, self.row, self.score = slot[kept], row[kept], score[kept]


class _Block:
    """A block of anchors, past which rows stream. Anchors stand by label, so that those that look for positives meet
    the rows of their own label alone."""

    def __init__(self, k: int):
        self.k, self.parts, self.best = k, [], None

    def anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _ready(self) -> None:
        table = pa.Table.from_batches(self.parts)
        column = {n: table[n].combine_chunks() for n in ("vec_id", "label", "v", "bounds")}
        order = np.argsort(column["label"].to_numpy(zero_copy_only=False), kind="stable")
        self.id, self.label = (column[n].to_numpy(zero_copy_only=False)[order] for n in ("vec_id", "label"))
        width = len(column["v"][0].as_py()) // 4
        self.v = _stacked(column["v"], np.int32, width).astype(np.int64)[order]
        self.probe, self.width = Probe(self.v), width
        bounds = column["bounds"].take(pa.array(order)).to_pylist()
        most = max((len(b or ()) for b in bounds), default=0)  # slots of an anchor; none: positives are looked for
        self.positives, self.wide = not most, max(most, 1)
        whole = np.iinfo(np.int64)
        self.low, self.high = (np.full((len(bounds), self.wide), fill, np.int64) for fill in ((whole.min, whole.max) if self.positives else (1, 0)))
        for i, one in enumerate(bounds):
            for j, of in enumerate(one or ()):
                self.low[i, j], self.high[i, j] = of["low"], of["high"]
        starts = [0, *(np.flatnonzero(np.diff(self.label)) + 1).tolist()] if self.positives else [0]
        self.slices = [slice(at, min(at + AT_ONCE, end)) for begin, end in zip(starts, [*starts[1:], len(self.id)]) for at in range(begin, end, AT_ONCE)]
        self.best = [_Best((of.stop - of.start) * self.wide, self.k) for of in self.slices]

    def rows(self, batch: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.best is None:
            self._ready()
        ids, labels = (batch[n].to_numpy(zero_copy_only=False) for n in ("vec_id", "label"))
        v = _stacked(batch["v"], np.int32, self.width)
        codes = _stacked(batch["codes"], np.uint64, LAYERS, self.width // 64)
        aligned, remainder = _stacked(batch["aligned"], np.float64, LAYERS), batch["remainder"].to_numpy()
        if self.positives:  # rows by label too
            order = np.argsort(labels, kind="stable")
            ids, labels, v, codes, aligned, remainder = (x[order] for x in (ids, labels, v, codes, aligned, remainder))
        for of, best in zip(self.slices, self.best):
            own = self.label[of.start]
            begin, end = (int(np.searchsorted(labels, own, side=s)) for s in ("left", "right")) if self.positives else (0, len(ids))
            step = FIRST
            while begin < end:
                part = slice(begin, min(begin + step, end))
                self._compare(of, best, ids[part], labels[part], v[part], codes[part], aligned[part], remainder[part])
                begin, step = part.stop, min(2 * step, MOST)

    def _compare(self, of, best, ids, labels, v, codes, aligned, remainder) -> None:
        """Score in integers what the intervals leave for any slot of an anchor, once for all of its slots: a row whose
        upper bound lies below what each slot asks for, or below k scores that it has, cannot be among its best."""
        low, high, floor = self.low[of], self.high[of], best.floor.reshape(-1, self.wide)
        open_ = low <= high
        reach = np.where(open_, np.maximum(low, floor).astype(np.float64), np.inf).min(axis=1)
        top = np.where(open_, high.astype(np.float64), -np.inf).max(axis=1)
        lower, upper = self.probe.interval(of, codes, aligned, remainder)
        row, anchor = np.nonzero((upper >= reach[None, :]) & (lower <= top[None, :]))
        here = of.start + anchor
        kept = ids[row] != self.id[here] if self.positives else labels[row] != self.label[here]
        row, anchor, here = row[kept], anchor[kept], here[kept]
        score = np.einsum("ij,ij->i", v[row].astype(np.int64), self.v[here])
        one = score[:, None]
        at, slot = np.nonzero((one >= low[anchor]) & (one <= high[anchor]) & (one >= floor[anchor]))
        if len(at):
            best.add(anchor[at] * self.wide + slot, ids[row[at]], score[at])

    def result(self) -> pa.RecordBatch:
        found = [
            (self.id[of.start + best.slot // self.wide], best.slot % self.wide, best.row, best.score) for of, best in zip(self.slices, self.best)
        ] if self.best is not None else []
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "slot", "row_id", "score"])


def _meet(anchors: DataFrame, codes: DataFrame, k: int, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """(anchor_id, slot, row_id, score): the best rows of each anchor and slot out of each block of rows.

    ``anchors``: (vec_id, label, v, bounds), the bounds being the (low, high) scores of each slot or null. A task holds
    one block of anchors and streams one block of rows past it, so both sides are written once for each block of the other.
    """
    kept = ["vec_id", "label", "v"]
    one = anchors.select(
        F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.xxhash64("vec_id"), F.lit(anchor_blocks)).cast("int").alias("ab"),
        *kept, "bounds", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("aligned"), F.lit(None).cast("double").alias("remainder"),
    )
    two = codes.select(
        F.lit(1).alias("side"), F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab"),
        *kept, F.lit(None).cast(anchors.schema["bounds"].dataType).alias("bounds"), "codes", "aligned", "remainder",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, _Block(k)
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("rb", "ab", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                key, part = tuple(keys[begin, :2].tolist()), batch.slice(begin, end - begin)
                if key != held:
                    yield block.result()
                    held, block = key, _Block(k)
                if keys[begin, 2] == 0:
                    block.anchors(part)
                else:
                    for at in range(0, part.num_rows, BATCH):
                        block.rows(part.slice(at, BATCH))
        yield block.result()

    met = one.unionByName(two).repartition(row_blocks * anchor_blocks, "rb", "ab").sortWithinPartitions("rb", "ab", "side")
    return met.mapInArrow(compare, "anchor_id long, slot long, row_id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90),
    label: Column | str = "label", key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` (a
    condition on vec_id) selects.

    Scores are integer inner products; higher ones come first, ties by smaller vec_id. The positives of an anchor are
    its first other rows of the same label, the negatives of a pair the first rows of other labels whose score is
    between ``band`` hundredths of the positive's. Pairs without such rows and anchors without positives have no rows.
    """
    rows = rows_of(vectors, label, key, vector)
    dim = vectors.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0
    codes, _ = written(coded(rows, dim), "codes")
    n = codes.count()
    chosen = codes.where(anchors).select("vec_id", "label", "v")
    row_blocks = max(1, -(-n // ROWS), min(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS))
    anchor_blocks = max(1, -(-chosen.count() // ANCHORS))
    bounds = "array<struct<low:long,high:long>>"
    found = _meet(chosen.withColumn("bounds", F.lit(None).cast(bounds)), codes, positives, row_blocks, anchor_blocks)
    pairs, _ = written(_first(found, ["anchor_id"], positives).select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    least, most = F.ceil(score * band[0] / 100), F.floor(score * band[1] / 100)
    listed = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", least.cast("long").alias("low"), most.cast("long").alias("high")))).alias("b")
    )  # at most ``positives`` of each anchor
    listed = listed.select("vec_id", F.transform("b", lambda x: F.struct(x.low.alias("low"), x.high.alias("high"))).alias("bounds"))
    found = _meet(chosen.join(listed, "vec_id"), codes, negatives, row_blocks, anchor_blocks)
    best = _first(found, ["anchor_id", "slot"], negatives).withColumnRenamed("rank", "place")
    slots = pairs.select(F.col("anchor_id").alias("_anchor"), (F.col("rank") - 1).alias("_slot"), "positive_id", "positive_score")
    return best.join(slots, (best.anchor_id == slots._anchor) & (best.slot == slots._slot)).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
