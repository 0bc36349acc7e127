"""Named data-quality rules: tagging, clean/quarantine split, scorecards.

A rule is a Boolean column that is true for a good row. NULL counts as a failure, so a row with a NULL
invoice or event type is quarantined under that rule's name instead of vanishing from both outputs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import ratio

Rules = dict[str, Column]


def sales_rules() -> Rules:
    quantity = F.col("quantity").try_cast("int")
    price = F.col("price").try_cast("decimal(12,2)")
    code = F.col("stock_code")
    return {
        "parseable_quantity": quantity.isNotNull(),
        "parseable_price": price.isNotNull(),
        "parseable_date": F.col("invoice_date").try_cast("timestamp").isNotNull(),
        "not_adjustment_invoice": ~F.col("invoice").startswith("A"),
        # an unparseable number is reported once, by its own rule
        "no_negative_qty_outside_returns": quantity.isNull() | (quantity > 0) | F.col("invoice").startswith("C"),
        "positive_price_or_return": price.isNull() | (price > 0),
        "product_stock_code": ~code.isin(fv.NON_PRODUCT_CODES) & ~code.like(fv.GIFT_CODE_LIKE),
    }


def event_rules() -> Rules:
    return {
        "has_event_id": F.col("event_id").isNotNull(),
        "known_event_type": F.col("event_type").isin(fv.EVENT_TYPES),
        "parseable_ts": F.col("event_ts").try_cast("timestamp").isNotNull(),
    }


def passes(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def tag(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the failed rules and the verdict. The verdict is a plain conjunction of the rules and not a
    test on the list, so a filter on it splits into simple predicates that move towards the scan."""
    failed = F.array_compact(F.array(*[F.when(~passes(rule), F.lit(name)) for name, rule in rules.items()]))
    good = reduce(and_, [passes(rule) for rule in rules.values()])
    return df.withColumns({"quarantine_reasons": failed, "is_quarantined": ~good})


def clean_rows(tagged: DataFrame) -> DataFrame:
    return tagged.where(~F.col("is_quarantined")).drop("is_quarantined", "quarantine_reasons")


def quarantined_rows(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("is_quarantined"))


def without_copies(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the smallest by its other columns in their order, a row as it was. Copies are combined before
    the shuffle, however many there are."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first")).select(*key, "_first.*").select(*df.columns)


def expectation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows ``(rule, passed, failed)`` from one pass and one aggregate row."""
    pairs = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(passes(rule)).alias("passed"),
            F.count_if(~passes(rule)).alias("failed"),
        )
        for name, rule in rules.items()
    ]
    return df.agg(F.array(*pairs).alias("r")).select(F.inline("r"))


def observed(df: DataFrame, rules: Rules, name: str) -> tuple[DataFrame, Observation]:
    """Rows and failures of each rule, collected while the rows flow to their sink (no extra pass)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~passes(rule)).alias(n) for n, rule in rules.items()]), seen


def reason_mix(quarantined: DataFrame) -> DataFrame:
    return (
        quarantined.select(F.explode("quarantine_reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "reason")
    )


def labelled(truth: DataFrame, label: str, key: str = "event_id") -> DataFrame:
    return truth.where(F.array_contains("labels", label)).select(key).distinct()


def scorecard(flags: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row of true positives, flagged, labelled, precision and recall.

    ``flags`` has the flagged keys and ``truth`` the labelled ones. Both are tagged, stacked and reduced
    by key, which needs one shuffle and no join.
    """
    stacked = flags.select(key, F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(
        truth.select(key, F.lit(0).alias("f"), F.lit(1).alias("t"))
    )
    return score_flags(stacked.groupBy(key).agg(F.max("f").alias("f"), F.max("t").alias("t")))


def score_flags(per_key: DataFrame) -> DataFrame:
    """The scorecard of rows that are flagged (f = 1) and labelled (t = 1) or not."""
    both = F.count_if((F.col("f") == 1) & (F.col("t") == 1))
    return per_key.agg(
        both.alias("tp"), F.count_if(F.col("f") == 1).alias("flagged"), F.count_if(F.col("t") == 1).alias("labeled")
    ).select("tp", "flagged", "labeled", ratio("tp", "flagged", 4).alias("precision"), ratio("tp", "labeled", 4).alias("recall"))
