"""Metric views: named fields and measures over a star join, aggregated at any grain asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import mean, money, ratio, sum_if
from tallyloom.functions.text import whole_word_hits

Measure = Callable[[], Column]


@dataclass(frozen=True)
class Dimension:
    """A dimension joined N:1 on one shared column name.

    A ``hashed`` one grows with the facts. Both sides are shuffled by the key, and each partition looks its facts up in
    a table of its part of the dimension, one row per key, so the facts are not sorted by a text that many of them share.
    """

    table: str
    key: str
    hashed: bool = False


@dataclass(frozen=True)
class MetricView:
    source: str
    fields: dict[str, str]  # field name -> "column" of the source, or "dimension.column"
    measures: dict[str, Measure]
    joins: dict[str, Dimension] = field(default_factory=dict)


def total(c: str) -> Measure:
    return lambda: F.sum(c)


def average(c: str) -> Measure:
    return lambda: mean(c)


VIEWS: dict[str, MetricView] = {
    "revenue_metrics": MetricView(
        source="fact_sales",
        joins={"product": Dimension("dim_products", "stock_code", hashed=True)},
        fields={
            "sale_date": "sale_date", "country": "country", "is_return": "is_return",
            "product_name": "product.product_name",
        },
        measures={
            "net_revenue": total("line_amount"),
            "gross_revenue": lambda: sum_if(~F.col("is_return"), "line_amount"),
            "returns_value": lambda: sum_if(F.col("is_return"), -F.col("line_amount")),
            "aov": lambda: ratio(F.sum("line_amount"), F.countDistinct("invoice_id")),
            "units": total("quantity"),
        },
    ),
    "funnel_metrics": MetricView(
        source="funnel_daily",
        fields={"event_date": "event_date"},
        measures={
            "total_sessions": total("sessions"),
            "total_purchases": total("purchases"),
            "avg_view_to_cart_rate": lambda: F.avg("view_to_cart_rate"),
            "avg_cart_to_purchase_rate": lambda: F.avg("cart_to_purchase_rate"),
            "avg_session_conversion_rate": lambda: F.avg("session_conversion_rate"),
        },
    ),
    "transactions_metrics": MetricView(
        source="bank_transactions",
        joins={"customer": Dimension("bank_customers", "customer_id")},
        fields={"account_type": "account_type", "posted_date": "posted_date", "segment": "customer.segment"},
        measures={
            "total_amount": lambda: F.sum(money("amount")),
            "total_available_balance": lambda: F.sum(money("available_balance")),
            "avg_available_balance": lambda: mean(money("available_balance")),
        },
    ),
    "wealth_metrics": MetricView(
        source="bank_portfolios",
        joins={"customer": Dimension("bank_customers", "customer_id")},
        fields={"segment": "customer.segment", "last_valuation_date": "last_valuation_date"},
        measures={
            "total_liquid_assets": lambda: F.sum(money("liquid_cash_assets")),
            "avg_liquid_assets": lambda: mean(money("liquid_cash_assets")),
            "total_invested_value": lambda: F.sum(money("invested_market_value")),
        },
    ),
}


def query(
    marts,
    view: str | MetricView,
    measures: list[str],
    by: list[str] | None = None,
    where: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One join + groupBy + agg for the request.

    Only dimensions whose fields are named are joined (the joins are N:1 and outer, so leaving one out
    cannot change a row count). Measures are recomputed at the requested grain: AOV is a ratio of
    aggregates at every level.
    """
    spec = VIEWS[view] if isinstance(view, str) else view
    by, where = by or [], where or {}
    unknown = [n for n in (*by, *where) if n not in spec.fields] + [m for m in measures if m not in spec.measures]
    if unknown:
        raise KeyError(f"not in this metric view: {unknown}")
    rows: DataFrame = getattr(marts, spec.source)
    needed: dict[str, dict[str, str]] = {}
    names: dict[str, str] = {}
    for name in dict.fromkeys((*by, *where)):
        path = spec.fields[name].split(".")
        names[name] = path[-1]
        if len(path) == 2:
            needed.setdefault(path[0], {})[path[1]] = path[1]
    for dim, columns in needed.items():
        join = spec.joins[dim]
        looked_up = getattr(marts, join.table).select(join.key, *columns)
        rows = rows.join(looked_up.hint("shuffle_hash") if join.hashed else looked_up, join.key, "left")
    for name, test in where.items():
        rows = rows.where(test(F.col(names[name])))
    outputs = [spec.measures[m]().alias(m) for m in measures]
    keys = [F.col(names[n]).alias(n) for n in by]
    return rows.groupBy(*keys).agg(*outputs) if keys else rows.agg(*outputs)


# ---- synonyms ----------------------------------------------------------------------------------


def merge_synonyms(
    existing: DataFrame, learned: DataFrame, owner: list[str], fold_case: bool = True, cap: int = fv.MAX_SYNONYMS
) -> DataFrame:
    """Existing synonyms stay, learned ones follow in order while the owner has room (``cap`` synonyms); the learned
    ones beyond it come back with ``held_back``, numbered on.

    Both inputs have ``(*owner, synonym, position)``. Learned spellings that repeat an existing or an
    earlier learned one are left out; with ``fold_case`` the comparison ignores case.
    """
    same = F.lower("synonym") if fold_case else F.col("synonym")
    key = [*owner, "_same"]
    old = existing.withColumn("_same", same)
    room = old.groupBy(*owner).agg(F.count(F.lit(1)).alias("_held"), F.max("position").alias("_last"))
    fresh = (
        learned.withColumn("_same", same)
        .groupBy(*key)
        .agg(F.min(F.struct("position", "synonym")).alias("_first"))
        .join(old.select(*key), key, "left_anti")
        .select(*owner, F.col("_first.position").alias("position"), F.col("_first.synonym").alias("synonym"))
    )
    turn = F.row_number().over(Window.partitionBy(*owner).orderBy("position", "synonym"))
    fitted = (
        fresh.withColumn("_turn", turn)
        .join(room, owner, "left")
        .select(
            *owner, "synonym", (F.coalesce("_last", F.lit(0)) + F.col("_turn")).alias("position"),
            (F.col("_turn") + F.coalesce("_held", F.lit(0)) > cap).alias("held_back"),
        )
    )
    return existing.select(*owner, "synonym", "position", F.lit(False).alias("held_back")).unionByName(fitted)


def resolve_synonyms(questions: DataFrame, synonyms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Questions to the view measures whose synonym they use as whole words."""
    hits = whole_word_hits(questions, [id_col], text_col, synonyms, "synonym")
    targets = synonyms.select("view", "name", F.col("synonym").alias("phrase"))
    return hits.join(targets, "phrase").select(id_col, "view", "name", F.col("phrase").alias("synonym")).distinct()
