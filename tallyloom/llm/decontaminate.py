"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a fingerprint of its five-word shingles. A document's windows of the item's length are
fingerprinted from running sums; multi-index Hamming blocks give all items within the radius; the exact weighted
shingle similarity of window and item decides.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
# Fingerprints of pairs with similarity 0.8 differ in 9.6 of 64 bits on average, with a deviation of 2.9; the radius is
# more than four deviations off.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
NEIGHBOUR = RADIUS // BLOCKS  # some block differs in so many bits at most if all differ in RADIUS at most
ITEMS_AT_ONCE = 10_000  # benchmark items that one pass over the documents compares; larger benchmarks take more passes
SLICE = 128
MEMO_WORDS = 300_000
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 8)
        return value


_hashes = _Hashes()
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles, in order; words are runs of word characters in lower case. Texts of
    fewer words have one of the whole sequence, those without words none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = one[:n].copy()
    for k in range(1, min(SHINGLE, len(words))):
        out = out * _FACTOR + one[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item_ids: list[int] = []
        self.weights: list[Counter] = []
        prints = []
        self.by_length: dict[int, list[int]] = defaultdict(list)  # in shingles
        self.with_shingle: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            hashes = shingles(text)
            if not len(hashes):
                continue
            i = len(self.item_ids)
            self.item_ids.append(item_id)
            self.weights.append(Counter(hashes.tolist()))
            prints.append(_packed(_signs(hashes).sum(axis=0, keepdims=True))[0])
            self.by_length[len(hashes)].append(i)
            for h in self.weights[i]:
                self.with_shingle[h].append(i)
        self.known = np.array(sorted(self.with_shingle), np.uint64)
        self.table = np.zeros(1 << 20, bool)  # of the hashes' first bits, to look up most shingles at once
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.prints, self.blocks = {}, {}
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= NEIGHBOUR
        for length, own in self.by_length.items():
            octets = np.stack([prints[i] for i in own])
            self.prints[length] = octets
            self.blocks[length] = [near[:, octets[:, b]] for b in range(BLOCKS)]  # block value -> items with a close block

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        places = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(places):
            return places
        found = np.searchsorted(self.known, hashes[places])
        return places[self.known[np.minimum(found, len(self.known) - 1)] == hashes[places]]

    def search(self, hashes: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, words, distance, similarity) of the best window for each item found.

        Windows that share no shingle with any item have similarity zero and are not built.
        """
        places = self.hits(hashes)
        if not len(places):
            return []
        lengths = sorted({len_ for p in places for i in self.with_shingle[int(hashes[p])] for len_ in (self.weights[i].total(),)})
        best: dict[int, tuple[float, int, int, int]] = {}
        for length in lengths:
            size = min(length, len(hashes))
            last = len(hashes) - size
            starts = np.unique(np.clip((places[:, None] - np.arange(size)).reshape(-1), 0, last))
            for part in np.array_split(starts, max(1, len(starts) // 4096)):
                own, where = np.unique((part[:, None] + np.arange(size + 1)).reshape(-1).clip(0, len(hashes)), return_inverse=True)
                where = where.reshape(len(part), -1)
                signs = np.zeros((len(own), 64), np.int32)
                inside = own < len(hashes)
                signs[inside] = _signs(hashes[own[inside]])
                sums = np.concatenate([np.zeros((1, 64), np.int32), signs.cumsum(axis=0, dtype=np.int32)])
                # the places of a window are neighbours in ``own``
                octets = _packed(sums[where[:, 0] + size] - sums[where[:, 0]])
                close = np.zeros((len(part), len(self.by_length[length])), bool)
                for b in range(BLOCKS):
                    close |= self.blocks[length][b][octets[:, b]]
                for w, j in zip(*np.nonzero(close), strict=True):
                    distance = int(np.bitwise_count(octets[w] ^ self.prints[length][j]).sum())
                    if distance > RADIUS:
                        continue
                    start, i = int(part[w]), self.by_length[length][j]
                    window = Counter(hashes[start : start + size].tolist())
                    item = self.weights[i]
                    common = sum(min(n, item[h]) for h, n in window.items() if h in item)
                    similarity = common / (window.total() + item.total() - common)
                    if similarity >= SIMILARITY and (i not in best or (similarity, -start) > (best[i][0], -best[i][1])):
                        best[i] = (similarity, start, size + SHINGLE - 1, distance)
        return [(self.item_ids[i], start, words, distance, similarity) for i, (similarity, start, words, distance) in sorted(best.items())]


SHAPE = "doc_id long, item_id long, start_word int, n_words int, distance int, similarity double"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of ``ITEMS_AT_ONCE`` items in the order of their ids."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    items = ((r["item_id"], r["text"]) for r in rows.toLocalIterator())
    while block := list(itertools.islice(items, ITEMS_AT_ONCE)):
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): each item found in a document, in its best window.

    Similarity is the weighted Jaccard of five-word shingles, a shingle's weight being its number of occurrences. A
    document shorter than the item is one window; a text of fewer than five words is one shingle, so such an item is
    found in documents of the same words alone. Null and empty texts match nothing; item rows with one id count each; repeated document rows come back each. Each block of the benchmark
    is broadcast and takes one pass over the documents; a worker searches one block at a time, while the blocks' broadcasts
    stay until the result has been read.
    """
    found: DataFrame | None = None

    def search(items: list[tuple[int, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(sent.value)
            for batch in batches:
                for begin in range(0, batch.num_rows, SLICE):
                    part = batch.slice(begin, SLICE)
                    out = [
                        (doc_id, item, start, min(words, len(_WORD.findall(text))), *near)
                        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)
                        if text
                        for item, start, words, *near in ready.search(shingles(text))
                    ]
                    if out:
                        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SHAPE.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(scan, SHAPE)

    for block in _blocks(benchmark):
        found = search(block) if found is None else found.unionByName(search(block))
    return found if found is not None else docs.sparkSession.createDataFrame([], SHAPE)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; rows and columns stay as they are."""

    def sieve(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(sent.value)
            for batch in batches:
                for begin in range(0, batch.num_rows, SLICE):
                    part = batch.slice(begin, SLICE)
                    yield part.filter(pa.array([not (t and ready.search(shingles(t))) for t in part["text"].to_pylist()], pa.bool_()))

        return rows.mapInArrow(choose, docs.schema)

    for block in _blocks(benchmark):
        docs = sieve(docs, block)
    return docs
