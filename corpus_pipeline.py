"""From raw documents to token ids: five stages, each one operator of tallyloom.llm.

Every stage works on all rows its predecessor kept, and is written as Parquet before the next one reads it. All but
the last return the columns of ``documents``. Null and empty texts, repeated rows and extra columns pass through the
stages as their operators define; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, piece_codec, quality_ordinal, secret_ledger, simhash_groups
from tallyloom.llm.queries import GRADES, ratings, register
from tallyloom.llm.tables import discard, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a probability of 0.8 and more, by a model fitted on the graded labels."""
    model = quality_ordinal.learn(docs, ratings(spark, sf_dir), GRADES)
    return quality_ordinal.selected(docs, model, GRADES - 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: fingerprints of 4-word shingles, linked at
    four differing bits or fewer."""
    return simhash_groups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in the texts; n_chars stays the length of the original text."""
    ledger, _ = written(secret_ledger.scan(docs), "secret-ledger")
    return secret_ledger.redact(docs, ledger)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return piece_codec.tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("piece_encoding", pieces),
]

# A fitted model, fingerprints and merges cannot be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return docs
