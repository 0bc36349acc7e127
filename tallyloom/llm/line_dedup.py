"""Substring dedup by hashing lines, paragraphs or sentences: the earliest occurrence of a unit stays, the others go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import written

UNITS = {
    "line": r"[^\n]+",
    "paragraph": r"[^\n](?:[^\n]|\n(?!\n))*",
    "sentence": r"[^\n.!?]*[.!?]+|[^\n.!?]+",  # a line break ends one, too; the blank in front belongs to it
}
LEAST_RUN = 25  # words of a run of neighbouring repeated units that goes: half of a passage of 50 words
SLICE = 256


def units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """(doc_id, at, start, end, words, digest): all units that hold a word, numbered in each text, with code-point offsets.

    A unit is normalised (lower case, white space runs as one blank) before its 128-bit digest is taken. Null and
    empty texts have no units; rows without an id take no part.
    """
    pattern = re.compile(UNITS[unit])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                ids, numbers, starts, ends, sizes, digests = [], [], [], [], [], []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    at = 0
                    for one in pattern.finditer(text):
                        words = one[0].lower().split()
                        if words:
                            ids.append(doc_id)
                            numbers.append(at)
                            starts.append(one.start())
                            ends.append(one.end())
                            sizes.append(len(words))
                            digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
                            at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in (numbers, starts, ends, sizes)), pa.array(digests, pa.binary())],
                    ["doc_id", "at", "start", "end", "words", "digest"],
                )

    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return known.mapInArrow(cut, "doc_id long, at int, start int, end int, words int, digest binary")


def repeated(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """Every unit that stands in an earlier place: (doc_id, start, end, words, kept_doc_id, kept_start, run_words).

    Of units with one digest the earliest by (doc_id, start) is kept, whatever their length; ``run_words`` counts the
    words of the neighbouring repeated units a unit stands among. Rows of one doc_id are one document. The texts are
    cut once, into a table. The earliest place is a minimum, so a unit that stands in a third of all documents is
    aggregated in each task before the shuffle; the join back has that one row on its other side, and adaptive
    execution splits the side of the occurrences. Runs are taken per document, which bounds them.
    """
    found, _ = written(units(docs, unit), "units")
    kept = (
        found.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1").select("digest", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))
    )
    kept, _ = written(kept, "kept")  # so that the join stands alone and a very common unit's side can be split
    again = found.join(kept, "digest").where("doc_id <> kept_doc_id or start <> kept_start").drop("digest").distinct()
    run = again.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "start", "end")))
    return run.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "run"))).select(
        "doc_id", "start", "end", "words", "kept_doc_id", "kept_start", "run_words"
    )


def removals(docs: DataFrame, unit: str = "sentence", least_run: int = LEAST_RUN) -> DataFrame:
    """The repeated units that go: those in runs of at least ``least_run`` words (0: all of them)."""
    return repeated(docs, unit).where(F.col("run_words") >= least_run)


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without the removed units, those of a line with the line break behind it; the columns stay as
    they are, and a column ``removed_spans`` (or, if there is one, ``removed_spans_1`` and so on) keeps the original
    offsets.

    A document whose units all go stays as an empty text. The spans of one document are gathered in one row,
    which is bounded by the document itself.
    """
    name, turn = "removed_spans", 0
    while name in docs.columns:
        turn += 1
        name = f"removed_spans_{turn}"
    spans = removed.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                texts = []
                for text, gone in zip(part["text"].to_pylist(), part[name].to_pylist(), strict=True):
                    if gone and text:
                        pieces, at, fresh = [], 0, True  # fresh: nothing of this line is kept so far
                        for span in gone:
                            if before := text[at : span["start"]]:
                                pieces.append(before)
                                fresh = before.endswith("\n")
                            at = span["end"]
                            if fresh and text[at : at + 1] == "\n":
                                at += 1
                        text = "".join(pieces) + text[at:]
                    texts.append(text)
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    joined = packed.join(spans, "_id", "left").select("_row.*", F.col("_spans").alias(name))
    return joined.mapInArrow(rebuild, joined.schema)
