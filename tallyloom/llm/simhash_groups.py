"""SimHash near-duplicate groups: a byte-position inverted index with count filtering.

A fingerprint of eight bytes whose partner differs in at most r bits shares at least 8 - r positional bytes with
it. The index lists fingerprints by combinations of positional bytes chosen so that every pair with that many
shared bytes meets under at least one combination; there the shared bytes are tallied, pairs that reach the
guaranteed minimum are kept, and their distance is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.tables import written

SEED = 42
POSITIONS = 8
SLICE = 256
BLOCK = 1024  # members of a bucket that are compared in one task
FEW = 12
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, all other characters as they are."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words: of the whole; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([hashed(joined, SEED)], np.uint64)
    starts = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    return np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def contract_print(text: str | None) -> tuple[int, bytes]:
    """Of 4-word shingles; nothing to check but the fingerprint itself."""
    return majority(shingle_hashes(words_of(text), 4)), b""


def wide_print(text: str | None) -> tuple[int, bytes]:
    """For near copies by 5-word shingles: a fingerprint of the distinct words to find them by (one changed word
    moves one feature of it), and 256 bits of the 5-word shingles to verify them by."""
    words = words_of(text)
    five = np.unique(shingle_hashes(words, 5))
    found = majority(np.array([xxhash.xxh64_intdigest(w, SEED) for w in sorted(set(words))], np.uint64))
    return found, b"".join(majority(_mixed(five, turn)).to_bytes(8, "big") for turn in range(4))


def fingerprints(docs: DataFrame, printer=contract_print) -> DataFrame:
    """(doc_id, fp, proof) of every document, null text as empty; ``fp`` holds the 64 bits as a signed long."""

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, proofs = batch["doc_id"], [], []
            for begin in range(0, batch.num_rows, SLICE):
                for text in batch["text"].slice(begin, SLICE).to_pylist():
                    fp, proof = printer(text)
                    prints.append(fp)
                    proofs.append(proof)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(proofs, pa.binary())], ["doc_id", "fp", "proof"]
            )

    return docs.select("doc_id", "text").mapInArrow(stamp, "doc_id long, fp long, proof binary")


def cover(least: int) -> list[tuple[int, ...]]:
    """Position combinations of which every set of ``least`` shared positions contains one.

    Up to three positions: all combinations of that size. From four on: 20 triples are enough. Deal the positions
    to three rings; of any four positions two triples' worth lie in one ring or in a ring and the next.
    """
    if least <= 3:
        return list(itertools.combinations(range(POSITIONS), least))
    ring = [p % 3 for p in range(POSITIONS)]
    kept = []
    for triple in itertools.combinations(range(POSITIONS), 3):
        count = [sum(ring[p] == r for p in triple) for r in range(3)]
        if 3 in count or any(count[r] == 2 and count[(r + 1) % 3] == 1 for r in range(3)):
            kept.append(triple)
    return kept


def _keys(fp: Column, combinations: list[tuple[int, ...]]) -> Column:
    def byte(p: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * (POSITIONS - 1 - p)).bitwiseAND(F.lit(255))

    def key(i: int, combination: tuple[int, ...]) -> Column:
        value = F.lit(i).cast("long")
        for p in combination:
            value = F.shiftleft(value, 8).bitwiseOR(byte(p))
        return value

    return F.array(*[key(i, c) for i, c in enumerate(combinations)])


def _forest(ids: list[int], prints: list[int], proofs: list[bytes], least: int, radius: int, apart: int | None) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links among the members connect: a spanning forest, not all pairs."""
    if len(ids) <= FEW:
        edges, group = [], list(range(len(ids)))
        for i, j in itertools.combinations(range(len(ids)), 2):
            if group[i] != group[j]:
                differ = prints[i] ^ prints[j]
                shared = sum(not (differ >> (8 * p)) & 255 for p in range(POSITIONS))
                if shared >= least and differ.bit_count() <= radius and (
                    apart is None or (int.from_bytes(proofs[i], "big") ^ int.from_bytes(proofs[j], "big")).bit_count() <= apart
                ):
                    edges.append((ids[i], ids[j]))
                    old, new = group[j], group[i]
                    group = [new if g == old else g for g in group]
        return edges
    fp = np.array(prints, np.uint64)
    octets = fp.astype(">u8").view(np.uint8).reshape(-1, POSITIONS)
    proof = np.frombuffer(b"".join(proofs), np.uint64).reshape(len(ids), -1) if apart is not None else None
    edges, left = [], np.arange(len(ids))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = ((octets[left] == octets[x]).sum(axis=1) >= least) & (np.bitwise_count(fp[left] ^ fp[x]) <= radius)
            if proof is not None:
                near &= np.bitwise_count(proof[left] ^ proof[x]).sum(axis=1, dtype=np.int64) <= apart
            reached, left = left[near], left[~near]
            edges += [(ids[x], ids[y]) for y in reached]
            frontier += list(reached)
    return edges


def links(classes: DataFrame, radius: int, least: int | None = None, apart: int | None = None) -> DataFrame:
    """(high, low) edges between class representatives, connecting exactly what all links connect.

    ``classes``: (rep, fp, proof), one row for each distinct fingerprint. A link: at most ``radius`` differing
    bits and at least ``least`` shared positional bytes (8 - radius, which ``radius`` guarantees, unless named), and
    at most ``apart`` differing bits of the proof, if named. Members of a bucket are numbered; buckets beyond
    ``BLOCK`` members are compared block against block in tasks of their own, so no task holds more than two
    blocks and every pair of the bucket still meets. Each comparison emits a spanning forest of its links.
    """
    least = POSITIONS - radius if least is None else least
    if least < 1:
        raise ValueError("with so large a radius no shared byte is guaranteed")
    combinations = cover(least)
    posted = classes.select("rep", "fp", "proof", F.explode(_keys(F.col("fp"), combinations)).alias("key"))
    bucket = Window.partitionBy("key")
    numbered = posted.select(
        "*", F.count("*").over(bucket).alias("n"), (F.row_number().over(bucket.orderBy("rep")) - 1).alias("at")
    ).where("n > 1")
    dealt = (
        numbered.withColumn("block", F.expr(f"cast(at div {BLOCK} as int)"))
        .withColumn("blocks", F.expr(f"cast((n - 1) div {BLOCK} as int)"))
        .withColumn("other", F.explode(F.expr("filter(sequence(0, blocks), x -> x <> block or blocks = 0)")))
        .select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "rep", "fp", "proof")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        high, low = [], []

        def close() -> None:
            if len(rows) > 1:
                for a, b in _forest([r[0] for r in rows], [r[1] & (1 << 64) - 1 for r in rows], [r[2] for r in rows], least, radius, apart):
                    high.append(max(a, b))
                    low.append(min(a, b))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["high", "low"])
            high.clear()
            low.clear()
            return out

        for batch in batches:
            for key, one, two, *row in zip(*(batch[c].to_pylist() for c in ("key", "one", "two", "rep", "fp", "proof")), strict=True):
                if (key, one, two) != held:
                    close()
                    held = (key, one, two)
                    rows.clear()
                rows.append(row)
            yield flush()
        close()
        yield flush()

    return (
        dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "rep")
        .mapInArrow(compare, "high long, low long").distinct()
    )


def groups(docs: DataFrame, printer=contract_print, radius: int = 4, least: int | None = None, apart: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, for every document.

    Documents with one fingerprint (and proof) are one class with the smallest id as its representative, so
    exact copies never meet in pairs. Documents without words have the fingerprint zero and are linked like any
    other. Rows with a repeated doc_id come back as often as they are; a null doc_id has no component of its own
    (null, unless its class has an id). An empty table gives no rows.
    """
    stamped, _ = written(fingerprints(docs, printer), "prints")
    # written, so that the join at the end meets plain rows on both sides and a class with very many copies can be split
    classes, _ = written(stamped.groupBy("fp", "proof").agg(F.min("doc_id").alias("rep")), "classes")
    edges = links(classes.where("rep is not null"), radius, least, apart)
    roots = components(edges)
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", "proof", F.coalesce("component", "rep").alias("component_id"))
    return stamped.join(named, ["fp", "proof"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, printer=contract_print, radius: int = 4, least: int | None = None, apart: int | None = None) -> DataFrame:
    """The documents without those whose group has a smaller id; columns stay as they are.

    Rows of one doc_id are one document and stay or go together; rows without an id are not compared and stay.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    gone = groups(known, printer, radius, least, apart).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
