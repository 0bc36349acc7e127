"""Certified business questions, declared as data and run by one function.

Each entry names a mart, optional conditions, the grain, the measures and an order. Paraphrases of the
same question are aliases of one entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.numbers import mean, money, ratio, share, sum_if
from tallyloom.operators.kpi import is_bounce

Make = Callable[[], Column]


@dataclass(frozen=True)
class Certified:
    mart: str
    measures: dict[str, Make] = field(default_factory=dict)
    by: dict[str, Make] = field(default_factory=dict)
    where: tuple[Make, ...] = ()
    having: tuple[Make, ...] = ()
    order: tuple[Make, ...] = ()
    limit: int | None = None
    dimension: tuple[str, str] | None = None  # (mart, key): inner join N:1
    reduce: tuple[tuple[str, ...], str] | None = None  # (keys, summed column): shrink facts before the join


def c(name: str) -> Make:
    return lambda: F.col(name)


def total(name: str) -> Make:
    return lambda: F.sum(name)


def rows() -> Make:
    return lambda: F.count(F.lit(1))


def distinct(name: str) -> Make:
    return lambda: F.countDistinct(name)


def is_true(name: str) -> Make:
    return lambda: F.col(name)


def is_false(name: str) -> Make:
    return lambda: ~F.col(name)


def equals(name: str, value: str) -> Make:
    return lambda: F.col(name) == value


def dates(name: str, start: str, end: str) -> Make:
    """Half-open date range on a bare column, so that it can be pushed to the scan."""

    def inside() -> Column:
        low, high = (F.lit(v).cast("date") for v in (start, end))
        return (F.col(name) >= low) & (F.col(name) < high)

    return inside


def down(name: str) -> Make:
    return lambda: F.desc(name)


def month() -> Make:
    return lambda: F.trunc("sale_date", "month")


def columns(mart: str, *names: str, order: str | None = None, rename: dict[str, str] | None = None) -> Certified:
    """A plain column list of a mart."""
    rename = rename or {}
    return Certified(mart, by={rename.get(n, n): c(n) for n in names}, order=(c(order),) if order else ())


AOV = lambda: ratio(F.sum("line_amount"), F.countDistinct("invoice_id"))
LINES = lambda: ratio(F.count(F.lit(1)), F.countDistinct("invoice_id"))
GROSS = lambda: sum_if(~F.col("is_return"), "line_amount")
SOLD = is_false("is_return")
HUMAN = is_false("is_bot")
PRODUCT = ("dim_products", "stock_code")
LAPSED = lambda: F.col("recency_days") > fv.CHURN_RECENCY_DAYS


def retail(country: str, first: str, last: str, quarter: tuple[str, str]) -> dict[str, Certified]:
    """The retail questions; the country and the date ranges are the questions' parameters."""
    daily, facts, rfm, summary = "daily_revenue", "fact_sales", "customer_rfm", "monthly_summary"
    return {
        "net_revenue_by_country": Certified(facts, {"net_revenue": total("line_amount")}, {"country": c("country")}),
        "daily_net_revenue": Certified(
            daily, by={"sale_date": c("sale_date"), "net_revenue": c("net_revenue")},
            where=(dates("sale_date", first, last),), order=(c("sale_date"),),
        ),
        "invoices_per_day": columns(daily, "sale_date", "invoices", order="sale_date"),
        "known_customers_per_country": Certified(rfm, {"customers": rows()}, {"country": c("country")}),
        "returns_by_country": Certified(
            facts, {"returns_value": lambda: F.sum(-F.col("line_amount"))}, {"country": c("country")},
            (is_true("is_return"),),
        ),
        "mean_session_duration": Certified("sessions", {"avg_duration_s": lambda: mean("duration_s")}, where=(HUMAN,)),
        "sessions_and_purchases_per_day": columns("funnel_daily", "event_date", "sessions", "purchases", order="event_date"),
        "gmv_by_month": Certified(daily, {"gmv": total("gross_revenue")}, {"month": month()}),
        "average_basket": Certified(facts, {"aov": AOV}, where=(equals("country", country),)),
        "returns_take_rate": Certified(
            daily, {"returns_take_rate": lambda: ratio(F.sum("returns_value"), F.sum("gross_revenue"))}
        ),
        "daily_shoppers": columns(daily, "sale_date", "known_customers", order="sale_date"),
        "conversion_by_day": columns("funnel_daily", "event_date", "session_conversion_rate", order="event_date"),
        "bounce_share": Certified("sessions", {"bounce_rate": lambda: share(is_bounce())}, where=(HUMAN,)),
        "whales": Certified(
            rfm, by={"customer_id": c("customer_id"), "country": c("country"), "monetary": c("monetary")},
            order=(down("monetary"), c("customer_id"), c("country")), limit=20,
        ),
        "churn_risks": Certified(
            rfm, by={"customer_id": c("customer_id"), "country": c("country"), "recency_days": c("recency_days")},
            where=(LAPSED,), order=(down("recency_days"), c("customer_id")),
        ),
        "basket_attach": Certified(facts, {"lines_per_invoice": LINES}, where=(SOLD,)),
        "gross_sales_total": Certified(daily, {"gross_sales": total("gross_revenue")}),
        "gross_sales_by_country": Certified(facts, {"gross_net_sales": GROSS}, {"country": c("country")}),
        "gross_sales_in_country": Certified(facts, {"gross_sales": GROSS}, where=(equals("country", country),)),
        "anonymous_revenue_share": Certified(
            facts,
            {"anonymous_revenue_share": lambda: ratio(sum_if(F.col("is_anonymous"), "line_amount"), F.sum("line_amount"))},
        ),
        "repeat_rate_by_segment": columns("customer_health", "segment", "repeat_purchase_rate_pct"),
        "known_customers_by_month": columns(summary, "month", "known_customers", order="month"),
        "known_buyers_by_month": columns(
            summary, "month", "known_customers", order="month", rename={"known_customers": "known_buyers"}
        ),
        "products_first_seen": Certified(
            "dim_products",
            by={n: c(n) for n in ("stock_code", "product_name", "first_seen")},
            where=(dates("first_seen", *quarter),), order=(c("first_seen"), c("stock_code")),
        ),
        "weekly_bounce_rate": columns("funnel_weekly", "week", "bounce_rate_pct", order="week"),
        "aov_by_month": columns(summary, "month", "aov", order="month"),
        "revenue_split_by_month": columns(summary, "month", "gross_revenue", "returns_value", "net_revenue", order="month"),
        "return_rate_by_month": columns(summary, "month", "return_rate_pct", order="month"),
        "top_countries": Certified(
            "country_performance",
            by={n: c(n) for n in ("country", "net_revenue", "revenue_rank")},
            where=(lambda: F.col("revenue_rank") <= 5,), order=(c("revenue_rank"),),
        ),
        "run_rate": Certified(
            summary, {"annualized_run_rate": lambda: F.max_by("net_revenue", "month") * 12}
        ),
        "ticket_size": Certified(facts, {"avg_ticket": AOV}),
        "repeat_rate": Certified(rfm, {"repeat_rate": lambda: share(F.col("frequency") > 1)}),
        "lapsed_customers": Certified(rfm, {"lapsed_customers": rows()}, where=(LAPSED,)),
        "one_and_done": Certified(
            rfm, {"one_and_done_customers": rows()}, where=(LAPSED, lambda: F.col("frequency") == 1)
        ),
        "stickiness": Certified("sessions", {"stickiness": lambda: share(F.col("converted"))}, where=(HUMAN,)),
        "asp": Certified(facts, {"asp": lambda: ratio(F.sum("line_amount"), F.sum("quantity"))}, where=(SOLD,)),
        "units_per_invoice": Certified(
            facts, {"units_per_invoice": lambda: ratio(F.sum("quantity"), F.countDistinct("invoice_id"))}, where=(SOLD,)
        ),
        "top_line_by_month": columns(summary, "month", "gross_revenue", order="month"),
        "net_by_month": columns(summary, "month", "net_revenue", order="month"),
        "cart_abandonment": Certified(
            "sessions", {"cart_abandonment_rate": lambda: share(F.col("n_purchases") == 0)},
            where=(HUMAN, lambda: F.col("n_carts") > 0),
        ),
        "sku_count": Certified("dim_products", {"sku_count": distinct("stock_code")}),
        "daily_add_to_cart_rate": columns("funnel_daily", "event_date", "view_to_cart_rate", order="event_date"),
        "mom_growth": columns(summary, "month", "mom_net_revenue_growth_pct", order="month"),
        "invoices_by_month": columns(summary, "month", "invoices", order="month"),
        "total_known_customers": Certified(rfm, {"known_customers": rows()}),
        "revenue_per_session": columns("funnel_weekly", "week", "revenue_per_session", order="week"),
        "top_products_by_units": Certified(
            facts, {"units": total("quantity")}, {"product_name": c("product_name")}, (SOLD,),
            order=(down("units"), c("product_name")), limit=10, dimension=PRODUCT, reduce=(("stock_code",), "quantity"),
        ),
        "best_sellers": Certified(
            facts, {"gross_revenue": total("line_amount")}, {"product_name": c("product_name")}, (SOLD,),
            order=(down("gross_revenue"), c("product_name")), limit=5, dimension=PRODUCT, reduce=(("stock_code",), "line_amount"),
        ),
        "sell_through": Certified(
            facts,
            {"units_per_day": lambda: ratio(F.sum("quantity"), F.countDistinct("sale_date"))},
            {"product_name": c("product_name")}, (SOLD,),
            order=(down("units_per_day"), c("product_name")), limit=10, dimension=PRODUCT, reduce=(("stock_code", "sale_date"), "quantity"),
        ),
    }


SEGMENT = ("bank_customers", "customer_id")


def banking(start: str, end: str) -> dict[str, Certified]:
    moves, books = "bank_transactions", "bank_portfolios"

    def amount(name: str) -> Make:
        return lambda: F.sum(money(name))

    def average(name: str) -> Make:
        return lambda: mean(money(name))

    wealthy = equals("segment", "High Net Worth")
    by_segment = {"segment": c("segment")}
    return {
        "amount_by_account_type": Certified(moves, {"total_amount": amount("amount")}, {"account_type": c("account_type")}),
        "customers_per_segment": Certified("bank_customers", {"customers": rows()}, by_segment),
        "invested_high_net_worth": Certified(
            books, {"total_invested": amount("invested_market_value")}, where=(wealthy,), dimension=SEGMENT
        ),
        "liquid_mass_affluent": Certified(
            books, {"total_liquid_assets": amount("liquid_cash_assets")},
            where=(equals("segment", "Mass Affluent"),), dimension=SEGMENT,
        ),
        "mean_liquid_high_net_worth": Certified(
            books, {"avg_liquid_assets": average("liquid_cash_assets")}, where=(wealthy,), dimension=SEGMENT
        ),
        "balance_high_net_worth": Certified(
            moves, {"total_available_balance": amount("available_balance")}, where=(wealthy,), dimension=SEGMENT
        ),
        "mean_checking_balance_by_segment": Certified(
            moves, {"avg_available_balance": average("available_balance")}, by_segment,
            (equals("account_type", "Checking"),), dimension=SEGMENT,
        ),
        "large_daily_movers": Certified(
            moves, {"moved": lambda: F.sum(F.abs(money("amount")))},
            {"customer_id": c("customer_id"), "posted_date": c("posted_date")}, having=(lambda: F.col("moved") > 50000,),
        ),
        "savings_in_month": Certified(
            moves, {"total_amount": amount("amount")},
            where=(equals("account_type", "Savings"), dates("posted_date", start, end)),
        ),
        "top_invested_customers": Certified(
            books, {"invested": amount("invested_market_value")}, {"customer_name": c("customer_name")},
            order=(down("invested"), c("customer_name")), limit=5, dimension=SEGMENT,
        ),
        "portfolios_per_segment": Certified(books, {"portfolios": rows()}, by_segment, dimension=SEGMENT),
        "liquid_by_segment": Certified(
            books, {"total_liquid_assets": amount("liquid_cash_assets")}, by_segment, dimension=SEGMENT
        ),
    }


def run(marts, entry: Certified) -> DataFrame:
    data: DataFrame = getattr(marts, entry.mart)
    if entry.reduce:
        keys, summed = entry.reduce
        for condition in entry.where:
            data = data.where(condition())
        data = data.groupBy(*keys).agg(F.sum(summed).alias(summed))
    if entry.dimension:
        mart, key = entry.dimension
        data = data.join(getattr(marts, mart), key)
    for condition in () if entry.reduce else entry.where:
        data = data.where(condition())
    keys = [make().alias(name) for name, make in entry.by.items()]
    if entry.measures:
        outputs = [make().alias(name) for name, make in entry.measures.items()]
        data = data.groupBy(*keys).agg(*outputs) if keys else data.agg(*outputs)
    else:
        data = data.select(*keys)
    for condition in entry.having:
        data = data.where(condition())
    if entry.order:
        data = data.orderBy(*[make() for make in entry.order])
    return data.limit(entry.limit) if entry.limit else data


def repeat_visitor_rate(sessions: DataFrame) -> DataFrame:
    """Share of buying visitors who bought in more than one session."""
    buyers = sessions.where((F.col("n_purchases") > 0) & ~F.col("is_bot")).groupBy("visitor_id").agg(
        F.count(F.lit(1)).alias("bought")
    )
    return buyers.agg(share(F.col("bought") > 1).alias("repeat_visitor_rate"))


def repurchase_gaps(facts: DataFrame) -> DataFrame:
    """Median, P75 and P90 of the days between a customer's consecutive purchase dates.

    Dates are made distinct per customer first, so a window holds at most one row per calendar day,
    whatever the customer's volume. The percentiles are computed from a histogram of whole days: exact,
    and no larger than the calendar.
    """
    dates = facts.where(~F.col("is_anonymous") & ~F.col("is_return")).select("customer_id", "sale_date").distinct()
    prior = F.lag("sale_date").over(Window.partitionBy("customer_id").orderBy("sale_date"))
    gaps = dates.select(F.datediff("sale_date", prior).alias("gap")).where(F.col("gap").isNotNull())
    histogram = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))

    def at(q: float) -> Column:
        return F.percentile("gap", F.lit(q), F.col("n"))

    return histogram.agg(
        F.sum("n").alias("gaps"), at(0.5).alias("median_days"), at(0.75).alias("p75_days"), at(0.9).alias("p90_days")
    )
