"""Text column helpers. All of them are built-in expressions; there is no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import col_of


def clean_text(value: Column | str) -> Column:
    return F.coalesce(col_of(value), F.lit(""))


def tokens(value: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(clean_text(value)), F.lit(pattern), F.lit(0))


def plain_tokens(value: Column | str) -> Column:
    return tokens(value, "[a-z0-9]+")


def name_tokens(value: Column | str) -> Column:
    return tokens(value, "[a-z0-9_]+")


def word_tokens(value: Column | str) -> Column:
    """Unicode words, the unit of a whole-word match."""
    return tokens(value, r"(?U)\w+")


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_in(found: Column, values: list[str]) -> Column:
    return F.arrays_overlap(found, words(values))


def count_in(found: Column, values: list[str]) -> Column:
    return F.size(F.filter(found, lambda t: t.isin(values)))


def singular(word: Column) -> Column:
    """Naive singular: ``countries -> country``, ``sales -> sale``, ``gross`` stays."""
    return (
        F.when(word.endswith("ies") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def correction_pairs(value: Column | str) -> Column:
    """Array with the struct(term, entity) of an "X means Y" sentence, empty when the text is not one.

    The text and the pair are bound as lambda variables, so each pattern is matched once per row even
    though the pair is tested and used several times; the full pattern only runs on texts that hold one
    of its phrases at all.
    """
    text = clean_text(value)
    candidate = F.when(text.rlike(fv.CORRECTION_PHRASES), F.array(text)).otherwise(F.array().cast("array<string>"))

    def pair(t: Column) -> Column:
        term = F.btrim(F.trim(F.regexp_extract(t, fv.CORRECTION_PATTERN, 1)), F.lit("'\""))
        entity = F.btrim(F.trim(F.regexp_extract(t, fv.CORRECTION_PATTERN, 2)), F.lit("'\"`"))
        return F.struct(F.lower(term).alias("term"), F.lower(entity).alias("entity"))

    return F.filter(
        F.transform(candidate, pair),
        lambda p: (p["term"] != "") & (p["entity"] != "") & (p["term"] != p["entity"]),
    )


def is_correction(value: Column | str) -> Column:
    return F.size(correction_pairs(value)) > 0


def keyed_map(values: dict) -> Column:
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.create_map(*pairs)


def mapped(key: Column | str, values: dict, default=None) -> Column:
    """Look a key up in a small fixed map: a literal, so no join and no shuffle."""
    found = F.try_element_at(keyed_map(values), col_of(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def whole_word_hits(texts: DataFrame, keep: list[str], text_col: str, phrases: DataFrame, phrase_col: str) -> DataFrame:
    """Rows ``(*keep, phrase)`` for every phrase that occurs in the text as a whole word or words.

    A phrase is cut at its word edges into words and what stands between them; a text gives every run of as many
    neighbouring parts, for the numbers of parts that phrases have. The two meet in an equi-join on a digest of the whole
    run, so a frequent first word is no hot key, nothing but the ids and a digest is carried, and no pattern is run per
    candidate. The phrase side goes through the size check of the adaptive planner. Phrases that do not start and end
    with a word character are no words and match nothing.
    """
    edge = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"

    def parts(text: Column) -> Column:
        return F.split(text, edge, -1)

    keyed = (
        phrases.select(F.col(phrase_col).alias("phrase")).distinct()
        .withColumn("_low", F.lower("phrase")).where(F.col("_low").rlike(r"(?U)^\w(.*\w)?$"))
        .select("phrase", F.size(parts(F.col("_low"))).alias("_n"), F.xxhash64("_low").alias("_digest"))
    )
    lengths = keyed.agg(F.collect_set("_n")).scalar()  # as many as phrases have lengths
    cut = texts.select(*keep, parts(F.lower(clean_text(text_col))).alias("_parts"), F.explode(lengths).alias("_n"))
    starts = F.when(F.size("_parts") >= F.col("_n"), F.sequence(F.lit(1), F.size("_parts") - F.col("_n") + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_parts", i, F.col("_n")), "")))
    exploded = cut.select(*keep, "_n", F.explode(runs).alias("_digest"))
    return exploded.join(keyed, ["_n", "_digest"]).select(*keep, "phrase").distinct()
