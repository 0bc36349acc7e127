"""Jaccard self-join of word n-gram sets by prefix trees.

A set's n-grams are held in one global order, rare ones first. Two sets of similarity t share an n-gram among the first
n - ceil(t n) + 1 of each, so sets meet in buckets of such n-grams. In a bucket the sets stand in a trie; a set that is
compared with all of them walks down level by level, takes the overlap of a shared beginning along to all sets below it,
and leaves a subtree as soon as what remains of both cannot reach the least overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.simhash_groups import words_of
from tallyloom.llm.tables import discard, written

GRAM = 5
T_UP, T_DOWN = 4, 5  # the least similarity, 0.8, as a fraction
SLOTS = 1 << 22  # counters of the order table, whatever the data: it takes 4 MB
PORTION = 1 << 16
LEVEL_BITS = 6
TURNS = 2  # smallest n-grams under other orders, by which most links are found first
BLOCK = 2_000_000  # n-grams of the sets that one task holds, twice
BITS = 256  # of a set's parities at least; larger sets have as many as n-grams, rounded up to a power of two
ROOM = 1 << 20  # bits of parities that one task holds, twice
SIEVE = 1 << 20  # remainders of ids by which texts are sorted out before they are shuffled
SLICE = 256
SEEN = 1 << 17  # sets that a task remembers, to list the beginning of each once
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str | None, gram: int = GRAM) -> np.ndarray:
    """64 bits for each n-gram of the words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < gram:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(one) - gram + 1
    out = one[:last].copy()
    for k in range(1, gram):
        out = _mixed(out) + one[k : last + k]
    return _mixed(out)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def order_table(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """The level of each slot: 0 for usual ones, and one more for each quarter of a doubling beyond what chance makes of
    the mean (three deviations).

    Counts go over all texts, in a table of fixed width; n-grams that fall into one slot share its level. Any such
    table gives a right order; it only keeps the n-grams of widespread passages out of the beginnings of sets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                for text in batch["text"].slice(begin, SLICE).to_pylist():
                    held.append(_slots(gram_hashes(text, gram)))
                    size += len(held[-1])
                    if size > SLOTS:
                        totals += np.bincount(np.concatenate(held), minlength=SLOTS)
                        held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=SLOTS)
        for part in range(SLOTS // PORTION):
            counts = totals[part * PORTION : (part + 1) * PORTION]
            used = np.flatnonzero(counts)
            if len(used):
                kind = np.min_scalar_type(int(counts.max()))  # a byte for each count, mostly
                dense = len(used) * 3 > PORTION
                listed = b"" if dense else used.astype(np.uint16).tobytes()
                row = [pa.array([part], pa.int32()), pa.array([listed], pa.binary()), pa.array([(counts if dense else counts[used]).astype(kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row, pa.array([kind.itemsize], pa.int32())], ["part", "used", "counts", "width"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, used, counts, width in zip(*(batch[c].to_pylist() for c in ("part", "used", "counts", "width")), strict=True):
                at = np.frombuffer(used, np.uint16) if used else slice(None)  # all of them
                total = sums.setdefault(part, np.zeros(PORTION, np.int64))
                total[at] += np.frombuffer(counts, f"u{width}").astype(np.int64)
        for part, total in sums.items():
            quarters = np.ceil(4 * np.log2(total + 1.0)).astype(np.uint8)  # to a fifth is enough for a level
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([quarters.tobytes()], pa.binary())], ["part", "total", "quarters"])

    portions = docs.select("text").where("text is not null").mapInArrow(count, "part int, used binary, counts binary, width int")
    sums = portions.repartition(SLOTS // PORTION, "part").mapInArrow(add, "part int, total long, quarters binary")
    stored, place = _stored(sums, "counts")  # what the tasks counted goes with its shuffle
    quarters, total = np.zeros(SLOTS, np.uint8), 0
    for row in stored.collect():  # 64 rows of 64 KB
        quarters[row.part * PORTION : (row.part + 1) * PORTION] = np.frombuffer(row.quarters, np.uint8)
        total += row.total
    discard(docs.sparkSession, place)
    mean = total / SLOTS
    usual = 4 * np.log2(mean + 3 * np.sqrt(mean) + 2)
    return np.clip(np.ceil(quarters - usual), 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def ordered_set(text: str | None, levels: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The distinct n-grams as numbers in the global order: the level, then bits of the hash."""
    hashes = gram_hashes(text, gram)
    return np.unique(levels[_slots(hashes)].astype(np.uint64) << np.uint64(64 - LEVEL_BITS) | hashes >> np.uint64(LEVEL_BITS))


def mark_of(digest: bytes) -> int:
    """A class's digest as a number, its first 64 bits."""
    return int.from_bytes(digest[:8], "big", signed=True)


def beginning(n: int) -> int:
    """How many of the first n-grams are listed: a partner shares at least ceil(t n), so one of these."""
    return n - -(-T_UP * n // T_DOWN) + 1


def similar(overlap: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
    """Whether the similarity reaches the least one: overlap / (sizes - overlap) >= t, ``sizes`` being the sum of both."""
    return (T_UP + T_DOWN) * overlap >= T_UP * sizes


class Trie:
    """Ordered sets in a trie whose edges are stretches of n-grams, each stretch twice as long as the one above it."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(flat, np.cumsum(sizes)[:-1])
        self.has = np.zeros(int(flat.max()) + 1, bool)
        self.sizes = sizes
        order = sorted(range(len(sets)), key=lambda k: self.ids[k].astype(">i4").tobytes())
        parent, begin, end, source = [-1], [0], [0], [0]
        self.leaf = np.zeros(len(sets), np.int64)
        stack, before = [0], None
        for k in order:
            ids = self.ids[k]
            shared = 0
            if before is not None:
                m = min(len(ids), len(before))
                differ = np.flatnonzero(ids[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            under = None
            while end[stack[-1]] > shared:
                under = stack.pop()
            if end[stack[-1]] < shared:  # the edge is cut where the sets part
                parent.append(stack[-1]), begin.append(end[stack[-1]]), end.append(shared), source.append(source[under])
                parent[under], begin[under] = len(parent) - 1, shared
                stack.append(len(parent) - 1)
            at, length = shared, 16
            while at < len(ids):
                to = min(len(ids), at + length)
                parent.append(stack[-1]), begin.append(at), end.append(to), source.append(k)
                stack.append(len(parent) - 1)
                at, length = to, 2 * length
            self.leaf[k] = stack[-1]
            before = ids
        self.parent, self.end = np.array(parent), np.array(end)
        depth = np.zeros(len(parent), np.int64)
        at = self.parent.copy()
        while (at >= 0).any():
            depth[at >= 0] += 1
            at = np.where(at >= 0, self.parent[at], -1)
        rank = np.argsort(depth, kind="stable")  # parents before children
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        self.parent, self.end = np.where(self.parent[rank] >= 0, place[self.parent[rank]], -1), self.end[rank]
        self.leaf = place[self.leaf]
        self.levels = np.searchsorted(depth[rank], np.arange(depth.max() + 2))
        lengths = self.end - np.array(begin)[rank]
        self.edge = np.concatenate([self.ids[source[r]][begin[r] : end[r]] for r in rank])
        self.edge_end = np.cumsum(lengths)
        self.edge_begin = self.edge_end - lengths
        self.last = np.where(lengths > 0, self.edge[np.maximum(self.edge_end - 1, 0)], -1)
        self.most, self.least = np.zeros(len(rank), np.int64), np.full(len(rank), np.iinfo(np.int64).max)
        np.maximum.at(self.most, self.leaf, sizes)
        np.minimum.at(self.least, self.leaf, sizes)
        for k in range(len(rank) - 1, 0, -1):
            self.most[self.parent[k]] = max(self.most[self.parent[k]], self.most[k])
            self.least[self.parent[k]] = min(self.least[self.parent[k]], self.least[k])
        self.alive = np.zeros(len(rank), np.int64)
        self.there = np.ones(len(sets), bool)
        for k in self.leaf:
            self._count(k, 1)

    def _count(self, node: int, change: int) -> None:
        while node >= 0:
            self.alive[node] += change
            node = self.parent[node]

    def remove(self, k: int) -> None:
        if self.there[k]:
            self.there[k] = False
            self._count(self.leaf[k], -1)

    def partners(self, k: int) -> np.ndarray:
        """The sets still there that are similar to set ``k``."""
        ids, n = self.ids[k], len(self.ids[k])
        self.has[ids] = True
        overlap = np.full(len(self.parent), -1, np.int64)  # -1: not reached
        overlap[0] = 0
        for first, until in zip(self.levels[1:], self.levels[2:]):
            nodes = first + np.flatnonzero((overlap[self.parent[first:until]] >= 0) & (self.alive[first:until] > 0))
            if not len(nodes):
                break
            lengths = self.edge_end[nodes] - self.edge_begin[nodes]
            ends = np.cumsum(lengths)
            where = np.repeat(self.edge_begin[nodes] - (ends - lengths), lengths) + np.arange(ends[-1])
            found = overlap[self.parent[nodes]] + np.add.reduceat(self.has[self.edge[where]].astype(np.int64), ends - lengths)
            ahead = np.minimum(self.most[nodes] - self.end[nodes], n - np.searchsorted(ids, self.last[nodes], side="right"))
            go = similar(found + ahead, self.least[nodes] + n)
            overlap[nodes[go]] = found[go]
        self.has[ids] = False
        reached = np.flatnonzero(self.there & (overlap[self.leaf] >= 0))
        return reached[similar(overlap[self.leaf[reached]], self.sizes[reached] + n)]


def forest(reps: list[int], known: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(high, low) edges that connect exactly what the links among the sets connect, beyond the components known.

    Sets of all components but that with the most sets look for partners; what is found joins the search at once.
    """
    of: dict[int, list[int]] = {}
    for k, c in enumerate(known):
        of.setdefault(c, []).append(k)
    if len(of) < 2:
        return []
    trie, edges = Trie(sets), []
    most = max(of, key=lambda c: (len(of[c]), c))
    for c in sorted(of, key=lambda c: (len(of[c]), c)):
        if c == most or not trie.there[of[c][0]]:
            continue
        met = False
        frontier = list(of[c])
        for k in frontier:
            trie.remove(k)
        while frontier:
            k = frontier.pop()
            for other in trie.partners(k).tolist():
                if known[other] == most:
                    if not met:
                        edges.append((reps[k], reps[other]))
                        met = True
                elif trie.there[other]:
                    edges.append((reps[k], reps[other]))
                    for one in of[known[other]]:
                        trie.remove(one)
                        frontier.append(one)
    return [(max(a, b), min(a, b)) for a, b in edges if a != b]


def parities(grams: np.ndarray) -> bytes:
    """For each remainder by the number of bits, whether an odd number of n-grams has it. Where two sets' parities differ
    there is an n-gram of one set alone, so sets differ by at least as many n-grams as bits. Twice as many bits fold into
    those of half the width by exclusive or."""
    width = max(BITS, 1 << (len(grams) - 1).bit_length())
    return np.packbits((np.bincount((_mixed(grams) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool)).tobytes()


def plausible(sizes: np.ndarray, known: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which sets can be near enough to one of another component, by sizes and parities: 9 times the difference is at
    most the sum of both sizes. Sets whose widths differ by more than a factor of two differ too much in size."""
    widths = np.array([len(b) for b in bits])
    kept = np.zeros(len(bits), bool)
    for width in np.unique(widths):
        own, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        one = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), width // 8)
        two = np.frombuffer(b"".join(bits[k] for k in wider), np.uint64).reshape(len(wider), 2, width // 8)
        other, all_bits = np.append(own, wider), np.concatenate([one, two[:, 0] ^ two[:, 1]])
        step = max(1, (1 << 22) // max(1, all_bits.size))
        for begin in range(0, len(own), step):
            at = own[begin : begin + step]
            differ = np.bitwise_count(one[begin : begin + step, None, :] ^ all_bits[None, :, :]).sum(axis=2, dtype=np.int64)
            both = sizes[at, None] + sizes[None, other]
            small, large = np.minimum(sizes[at, None], sizes[None, other]), np.maximum(sizes[at, None], sizes[None, other])
            near = (known[at, None] != known[None, other]) & ((T_UP + T_DOWN) * differ <= (T_DOWN - T_UP) * both) & (T_DOWN * small >= T_UP * large)
            kept[at] |= near.any(axis=1)
            kept[other] |= near.any(axis=0)
    return kept


def _stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written``, and the shuffle files of the write go as soon as it has ended, for later steps read the table alone."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN)
    conf.set(CLEAN, "true")
    try:
        return written(df, label)
    finally:
        conf.set(CLEAN, before)


def _dealt(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """The members of each bucket in blocks of about ``limit``, once for each block (``one``, ``two``) they are compared with."""
    bucket = Window.partitionBy("key")
    before = F.coalesce(F.sum(weight).over(bucket.orderBy("rep", "mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = members.withColumn("block", (before / limit).cast("int")).withColumn("blocks", F.max("block").over(bucket))
    other = numbered.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks), x -> x <> block or blocks = 0)")))
    return other.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("block", "blocks", "other")


def _by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((key, one, two), rows) of sorted batches."""
    held, rows = None, []
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            for key, one, two, *row in zip(*(part[c].to_pylist() for c in ("key", "one", "two", *columns)), strict=True):
                if (key, one, two) != held:
                    if rows:
                        yield held, rows
                    held, rows = (key, one, two), []
                rows.append(row)
    if rows:
        yield held, rows


def _together(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "rep")


def _plausible(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """The members (key, mark, rep, n, known) that ``plausible`` leaves in their buckets.

    Members are dealt by the room that their parities take; unless they have their parities with them, these join them
    where they are compared.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), rows in _by_group(batches, ("mark", "rep", "n", "known", "bits")):
            marks, reps, sizes, known = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            kept = plausible(sizes, known, [r[4] for r in rows])
            found = [np.full(int(kept.sum()), key, np.int64), *(c[kept] for c in (marks, reps, sizes, known))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["key", "mark", "rep", "n", "known"])

    dealt = _dealt(members, F.col("room"), ROOM)
    if "bits" not in members.columns:
        dealt = dealt.join(candidates.select("mark", "rep", "bits"), ["mark", "rep"])
    flagged = _together(dealt.select("key", "one", "two", "mark", "rep", "n", "known", "bits")).mapInArrow(judge, "key long, mark long, rep long, n long, known long")
    kept, _ = _stored(flagged.distinct(), "plausible")
    return kept


def _links(members: DataFrame, candidates: DataFrame, docs: DataFrame, levels: Broadcast, gram: int) -> DataFrame:
    """(high, low) edges out of the buckets of ``members`` (key, mark, rep, n, room, known, and bits or not), written.

    The members of a bucket are numbered by their sizes in n-grams; beyond ``BLOCK`` of them, blocks are compared with
    one another in tasks of their own, so that no task holds more than two blocks and all pairs still meet. Sets are
    taken from the texts again, of members alone that parities leave: they would fill more room than the texts do.
    """
    dealt, place = _stored(_dealt(_plausible(members, candidates), F.col("n"), BLOCK).drop("n"), "dealt")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams, mark = None, b"", None
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                right, sets = [], []
                for text, wanted in zip(part["text"].to_pylist(), part["mark"].to_pylist(), strict=True):
                    if text != last:  # rows of one text follow one another
                        last, grams = text, ordered_set(text, levels.value, gram).tobytes()
                        mark = mark_of(xxhash.xxh3_128_digest(grams))
                    right.append(mark == wanted)  # another text of a repeated id does not belong to the class
                    sets.append(grams if right[-1] else None)
                columns = [part["key"], part["one"], part["two"], part["rep"], part["known"], pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "one", "two", "rep", "known", "grams"]).filter(pa.array(right))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, ("rep", "known", "grams")):
            edges = forest([r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["high", "low"])

    def remainder(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("int").alias("remainder")

    wanted = dealt.select(remainder("rep")).distinct()  # at most SIEVE rows of four bytes
    own = docs.select("doc_id", "text", remainder("doc_id")).join(F.broadcast(wanted), "remainder", "left_semi")
    texts = own.join(dealt, F.col("doc_id") == F.col("rep")).select("key", "one", "two", "rep", "known", "text", "mark")
    full = texts.mapInArrow(gather, "key long, one int, two int, rep long, known long, grams binary")
    compared = _together(full).mapInArrow(compare, "high long, low long")
    found, _ = _stored(compared.distinct(), "links")
    discard(docs.sparkSession, place)
    return found


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one known component, one bucket for each set of members."""
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "rep", "mark")).alias(f"mark{k}") for k in (0, 1)]
    buckets = members.groupBy("key").agg(F.count("*").alias("many"), F.min("known").alias("low"), F.max("known").alias("high"), *mark).where("low < high")
    kept, _ = _stored(buckets.groupBy("many", "mark0", "mark1").agg(F.min("key").alias("key")).select("key"), "buckets")
    return members.join(kept, "key")


def _shared(listed: DataFrame) -> DataFrame:
    """The distinct (key, mark) whose key more than one mark has. All rows are shuffled once, by key; the few that are
    left stay where they are."""
    bucket = Window.partitionBy("key")
    return listed.select("key", "mark", F.min("mark").over(bucket).alias("a"), F.max("mark").over(bucket).alias("b")).where("a < b").select("key", "mark").distinct()


def groups(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set of distinct n-grams, and the smallest doc_id
    reachable over links of similarity 0.8 and more, for every row.

    Documents with fewer words than an n-gram have the whole sequence as their only one; those without words have an
    empty set and are linked with nothing. Equal sets are one class with the smallest id as its representative, so copies
    never meet in pairs. Rows with a repeated doc_id come back as often as they are, each under its own text; a null doc_id
    has no component of its own (null, unless its class has an id). An empty table gives no rows.

    Links are found in steps that all compare sets exactly: in buckets of the smallest n-gram under one order after the
    other, which find nearly all, and then in the buckets of all n-grams at the beginnings of sets. Of the buckets of each
    step only those are looked at that hold more than one component by then.
    """
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(order_table(docs, gram))
    turns = [f"least{turn}" for turn in range(TURNS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def listed(doc_id: int | None, digest: bytes | None, grams: np.ndarray) -> np.ndarray | list:
            if digest is None or doc_id is None or digest in seen:
                return []
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
            return grams[: beginning(len(grams))].view(np.int64)

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                sets = [ordered_set(t, levels.value, gram) for t in part["text"].to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                least = [[int(_mixed(s ^ np.uint64(turn + 1)).min().view(np.int64)) if len(s) else None for s in sets] for turn in range(TURNS)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                        pa.array([d and mark_of(d) for d in digests], pa.int64()),
                        pa.array([listed(*one) for one in zip(part["doc_id"].to_pylist(), digests, sets)], pa.list_(pa.int64())),
                        pa.array([parities(s) if len(s) else None for s in sets], pa.binary()), *(pa.array(x, pa.int64()) for x in least),
                    ],
                    ["doc_id", "n", "digest", "mark", "first", "bits", *turns],
                )

    shape = "doc_id long, n long, digest binary, mark long, first array<long>, bits binary, " + ", ".join(f"{t} long" for t in turns)
    described, sets_place = _stored(docs.select("doc_id", "text").mapInArrow(describe, shape), "sets")
    known = described.where("digest is not null and doc_id is not null")
    classes, _ = _stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), F.min("n").alias("n"), *(F.min(t).alias(t) for t in turns)), "classes")

    postings, _ = _stored(_shared(known.select(F.explode("first").alias("key"), "mark")), "postings")
    chosen = postings.select("mark").distinct().join(classes, "mark")
    own = known.select("digest", F.col("doc_id").alias("rep"), "bits", (8 * F.octet_length("bits")).cast("long").alias("room")).join(chosen, ["digest", "rep"])
    candidates, _ = _stored(own.dropDuplicates(["digest", "rep"]), "candidates")
    rows, _ = _stored(described.select("doc_id", "n", "digest"), "rows")
    discard(spark, sets_place)  # all that is read from here on is in tables of its own

    edges, roots = None, None
    for turn in (*turns, None):  # the last step looks at all n-grams of the beginnings
        sets = candidates.select("mark", "rep", "n", "room", *([F.col(turn).alias("key"), "bits"] if turn else []))
        if roots is None:
            sets = sets.withColumn("known", F.col("rep"))
        else:
            sets = sets.join(roots, sets.rep == roots.node, "left").withColumn("known", F.coalesce("component", "rep")).drop("node", "component")
        members, place = (sets, None) if turn else _stored(postings.join(sets, "mark"), "members")  # many a set, so without parities
        found = _links(_mixed_buckets(members), candidates, docs, levels, gram)
        if place:
            discard(spark, place)
        edges = found if edges is None else edges.unionByName(found)
        roots, _ = _stored(components(edges), "roots")
    named, _ = _stored(classes.join(roots, classes.rep == roots.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "named")
    return rows.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("digest").isNull(), F.col("doc_id"))).alias("component_id")
    )
