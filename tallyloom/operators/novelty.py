"""Novel terms: vocabulary that users keep using in failed questions and that nobody has defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.text import clean_text, is_correction, plain_tokens, singular


def is_filler(word: str) -> Column:
    return F.col(word).isin(fv.STOPWORDS) | F.col(word).rlike("^[0-9]+$")


def candidate_terms(rows: DataFrame, text_col: str) -> DataFrame:
    """One row per input row and distinct candidate: single words and word pairs that carry content
    and are not governed vocabulary. The lists are hash-set tests on the exploded words."""
    t = plain_tokens(text_col)
    followers = F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1)))
    # the last word has no follower: zip_with pads it with NULL, concat makes NULL of the pair. Grams are strings, which
    # a hash set makes distinct; structs would be compared pair by pair
    pairs = F.zip_with(t, followers, lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.array_distinct(F.concat(t, F.array_compact(pairs)))
    exploded = rows.select("*", F.explode(grams).alias("term"))
    split = exploded.withColumns({"_a": F.substring_index("term", " ", 1), "_b": F.when(F.contains("term", F.lit(" ")), F.substring_index("term", " ", -1))})
    governed_a = singular(F.col("_a")).isin(fv.GOVERNED_WORDS)
    governed_b = F.col("_b").isNull() | singular(F.col("_b")).isin(fv.GOVERNED_WORDS)
    content = ~is_filler("_a") & (F.col("_b").isNull() | ~is_filler("_b"))
    return split.where(content & ~(governed_a & governed_b) & ~F.col("term").isin(fv.KNOWN_TERMS)).drop("_a", "_b")


def is_negative(rows: DataFrame, ratings: list[str]) -> Column:
    """True when a rating column holds a negative number or, as text, one of the negative words."""
    kinds = dict(rows.dtypes)
    out = F.lit(False)
    for name in ratings:
        if kinds[name] == "boolean":
            continue
        is_word = kinds[name] == "string"
        test = F.lower(F.trim(name)).isin(fv.NEGATIVE_RATINGS) if is_word else F.col(name) < 0
        out = out | F.coalesce(test, F.lit(False))
    return out


def failed_questions(rows: DataFrame, text_col: str, ratings: list[str], only_negative: bool = True) -> DataFrame:
    """Rows to mine: not a correction sentence, and rated negative or carrying a correction."""
    mined = rows.where(~is_correction(text_col))
    if not only_negative:
        return mined
    corrected = clean_text("correction") != "" if "correction" in rows.columns else F.lit(False)
    return mined.where(is_negative(mined, ratings) | corrected)


def novel_terms(rows: DataFrame, text_col: str, user_col: str, min_occurrences: int = 2) -> DataFrame:
    """Terms with their occurrences (once per row) and distinct users. A qualifying pair hides its two
    words: the pair's rows are sent to its words in the same aggregation, so the term counts are
    computed once and not joined back to themselves."""
    user = F.when(F.col(user_col) != "", F.col(user_col))
    counted = (
        candidate_terms(rows.select(text_col, user.alias("_user")), text_col)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("_user").alias("distinct_users"))
        .where(F.col("occurrences") >= min_occurrences)
    )
    is_pair = F.col("term").contains(" ")
    own = F.struct(F.col("term").alias("w"), F.col("occurrences").alias("o"), F.col("distinct_users").alias("u"))
    shade = F.transform(
        F.split("term", " "),
        lambda w: F.struct(w.alias("w"), F.lit(None).cast("bigint").alias("o"), F.lit(None).cast("bigint").alias("u")),
    )
    spread = counted.select(F.explode(F.concat(F.array(own), F.when(is_pair, shade).otherwise(F.array()))).alias("x"))
    return (
        spread.groupBy(F.col("x.w").alias("term"))
        .agg(
            F.max("x.o").alias("occurrences"),
            F.max("x.u").alias("distinct_users"),
            F.count_if(F.col("x.o").isNull()).alias("_shades"),
        )
        .where(F.col("occurrences").isNotNull() & (F.col("_shades") == 0))
        .drop("_shades")
        .orderBy(F.desc("distinct_users"), F.desc("occurrences"), "term")
    )


def example_questions(rows: DataFrame, text_col: str, order: list[str], n: int = 3) -> DataFrame:
    """Up to n distinct example questions per term in order of arrival.

    Each question is brought to one row with its first arrival and a digest; the terms carry digests alone, the first
    n per term are cut in every task before the shuffle, and the texts are fetched for what is left."""
    arrival = F.struct(*order)
    asked = rows.groupBy(F.col(text_col).alias("question")).agg(F.min(arrival).alias("_first")).withColumn("_digest", F.sha2(clean_text("question"), 256))
    turn = F.row_number().over(Window.partitionBy("term").orderBy("_first", "_digest"))
    firsts = candidate_terms(asked, "question").select("term", "_first", "_digest").withColumn("_turn", turn).where(F.col("_turn") <= n)
    return (
        firsts.join(asked.select("_digest", "question"), "_digest")
        .groupBy("term")
        .agg(F.sort_array(F.collect_list(F.struct("_turn", "question"))).alias("_q"))
        .select("term", F.col("_q.question").alias("example_questions"))
    )


def with_examples(terms: DataFrame, examples: DataFrame) -> DataFrame:
    return terms.join(examples, "term", "left")
