"""Certified KPI tables over the gold layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import mean, percent, ratio, share, sum_if
from tallyloom.functions.ranking import tiles_by_cuts


def month_of(c: str) -> Column:
    return F.trunc(c, "month").alias("month")


def week_of(c: str) -> Column:
    return F.to_date(F.date_trunc("week", c)).alias("week")


def monthly_sums(daily: DataFrame) -> DataFrame:
    sums = ["gross_revenue", "net_revenue", "returns_value", "invoices"]
    return daily.groupBy(month_of("sale_date")).agg(*[F.sum(c).alias(c) for c in sums])


def monthly_summary(daily: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per month. The window over all months is bounded by the calendar, not by the data.

    Anonymous lines have no customer id, so the distinct count leaves them out without a filter; both
    branches then read the same deduplicated lines and Spark reuses their shuffle."""
    known = F.nullif(F.countDistinct("customer_id"), F.lit(0))
    customers = facts.groupBy(month_of("sale_date")).agg(known.alias("known_customers"))
    prior = F.lag("net_revenue").over(Window.orderBy("month"))
    return (
        monthly_sums(daily)
        .join(customers, "month", "left")
        .select(
            "month",
            "gross_revenue",
            "net_revenue",
            "returns_value",
            percent("returns_value", "gross_revenue", 2).alias("return_rate_pct"),
            "invoices",
            ratio("net_revenue", "invoices", 2).alias("aov"),
            "known_customers",
            percent(F.col("net_revenue") - prior, prior, 2).alias("mom_net_revenue_growth_pct"),
        )
    )


def customer_health(rfm: DataFrame) -> DataFrame:
    """Monetary quartiles (Q1 = top) plus the 'all' row, both from one pass over the scored customers."""
    scored = tiles_by_cuts(rfm, {"quartile": -F.col("monetary")}, ["customer_id", "country"], 4)
    segment = F.explode(F.array(F.concat(F.lit("Q"), F.col("quartile").cast("string")), F.lit("all")))
    return (
        scored.select(segment.alias("segment"), "monetary", "recency_days", "frequency")
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            mean("monetary", 2).alias("avg_monetary"),
            mean("recency_days", 1).alias("avg_recency_days"),
            F.round(share(F.col("frequency") > 1) * 100, 2).alias("repeat_purchase_rate_pct"),
            F.count_if(F.col("recency_days") > fv.CHURN_RECENCY_DAYS).alias("churn_risk_count"),
        )
        .orderBy(F.when(F.col("segment") == "all", "").otherwise(F.col("segment")))
    )


def is_bounce() -> Column:
    return (F.col("n_views") == 1) & (F.col("n_carts") == 0) & (F.col("n_purchases") == 0)


def funnel_weekly(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    per_week = (
        sessions.where(~F.col("is_bot"))
        .groupBy(week_of("started_at"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_if("converted").alias("converted_sessions"),
            F.count_if(is_bounce()).alias("bounce_sessions"),
        )
    )
    revenue = daily.groupBy(week_of("sale_date")).agg(F.sum("net_revenue").alias("net_revenue"))
    return (
        per_week.join(revenue, "week", "left")
        .select(
            "week",
            "sessions",
            "converted_sessions",
            ratio("converted_sessions", "sessions", 4).alias("session_conversion_rate"),
            "bounce_sessions",
            percent("bounce_sessions", "sessions", 2).alias("bounce_rate_pct"),
            "net_revenue",
            ratio("net_revenue", "sessions", 2).alias("revenue_per_session"),
        )
        .orderBy("week")
    )


def country_performance(facts: DataFrame) -> DataFrame:
    """League table; ranks leave gaps after ties. The ranking window is bounded by the country list."""
    sold = ~F.col("is_return")
    sums = facts.groupBy("country").agg(
        F.sum("line_amount").alias("net_revenue"),
        sum_if(sold, "line_amount").alias("gross_revenue"),
        sum_if(~sold, -F.col("line_amount")).alias("returns_value"),
        F.countDistinct("invoice_id").alias("invoices"),
    )
    return sums.select(
        "country",
        "net_revenue",
        percent("returns_value", "gross_revenue", 2).alias("return_rate_pct"),
        ratio("net_revenue", "invoices", 2).alias("aov"),
        F.rank().over(Window.orderBy(F.desc("net_revenue"))).alias("revenue_rank"),
    )


def monthly_trend(daily: DataFrame) -> DataFrame:
    return monthly_sums(daily).orderBy("month")


def product_sums(facts: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    """Sold lines per product. Facts are reduced to one row per stock code before the dimension join,
    so the join carries products and not lines, and a hot stock code is combined map-side."""
    per_code = (
        facts.where(~F.col("is_return"))
        .groupBy("stock_code")
        .agg(
            F.sum("line_amount").alias("net_revenue"),
            F.sum("quantity").alias("units_sold"),
            F.countDistinct("invoice_id").alias("invoices"),
        )
    )
    return per_code.join(products.select("stock_code", "product_name"), "stock_code", how)


def top_products(facts: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    named = product_sums(facts, products, "left").withColumn(
        "product_name", F.coalesce("product_name", F.lit("(unknown)"))
    )
    return named.orderBy(F.desc("net_revenue"), "stock_code").limit(n).select(
        "stock_code", "product_name", "net_revenue", "units_sold", "invoices"
    )


def return_rates(facts: DataFrame) -> DataFrame:
    sold = ~F.col("is_return")
    return facts.agg(
        share(F.col("is_return"), 4).alias("line_return_rate"),
        ratio(sum_if(~sold, -F.col("line_amount")), sum_if(sold, "line_amount"), 4).alias("value_return_rate"),
    )


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Three quartile scores per customer, found together."""
    measures = {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}
    return tiles_by_cuts(rfm, measures, ["customer_id", "country"], 4)


def rfm_segments(rfm: DataFrame) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    champions, loyal, at_risk, lapsing, hibernating, casual = fv.RFM_SEGMENTS
    segment = (
        F.when((r >= 3) & (f >= 3) & (m >= 3), champions)
        .when((r >= 3) & (f >= 2), loyal)
        .when((r <= 2) & (f >= 3), at_risk)
        .when((r <= 2) & (m >= 3), lapsing)
        .when(r == 1, hibernating)
        .otherwise(casual)
    )
    return (
        rfm_scores(rfm)
        .groupBy(segment.alias("segment"))
        .agg(F.count(F.lit(1)).alias("customers"), mean("monetary", 2).alias("avg_monetary"))
        .orderBy(F.desc("customers"), "segment")
    )
