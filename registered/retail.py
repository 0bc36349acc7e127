"""Sales, clickstream, KPI, metric-view and certified-question cases."""

from pyspark.sql import functions as F

from registered.base import add_case, case
from tallyloom.operators import certified, clickstream, kpi, metric_view, quality
from tallyloom.operators.faults import as_lines
from tallyloom.plans.marts import Marts

D = "CAST({0} AS DOUBLE) AS {0}"


def d(*names: str) -> str:
    return ", ".join(D.format(n) for n in names)


JOIN = "array_to_string({0}, ',')"

# ---- data quality --------------------------------------------------------------------------------


@case(
    "dq01_rule_verdicts",
    "SELECT count(*) AS rows, "
    + ", ".join(f"count(*) FILTER (WHERE r{i}) AS pass_{i}" for i in range(1, 8))
    + " FROM ruled_sales",
)
def _(m: Marts):
    rules = list(quality.sales_rules().values())
    passed = [F.count_if(quality.passes(r)).alias(f"pass_{i}") for i, r in enumerate(rules, 1)]
    return m.tagged_sales.agg(F.count(F.lit(1)).alias("rows"), *passed)


@case(
    "dq02_tagged_rows",
    "SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, bad AS is_quarantined FROM tagged_sales",
)
def _(m: Marts):
    return m.tagged_sales.drop("quarantine_reasons")


@case(
    "dq03_failed_rule_names",
    "SELECT array_to_string(reasons, ',') AS reasons, count(*) AS rows FROM tagged_sales GROUP BY 1",
)
def _(m: Marts):
    return m.tagged_sales.groupBy(F.concat_ws(",", "quarantine_reasons").alias("reasons")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@case(
    "dq04_quarantine_sales",
    "SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, "
    "array_to_string(reasons, ',') AS reasons FROM tagged_sales WHERE bad",
)
def _(m: Marts):
    return m.quarantine_sales.withColumn("reasons", F.concat_ws(",", "quarantine_reasons")).drop(
        "quarantine_reasons", "is_quarantined"
    )


@case(
    "dq05_exact_copies_removed",
    "SELECT (SELECT count(*) FROM bronze_sales) AS landed, (SELECT count(*) FROM typed_sales) AS kept",
)
def _(m: Marts):
    landed = m.bronze_sales.agg(F.count(F.lit(1)).alias("landed"))
    kept = m.tagged_sales.agg(F.count(F.lit(1)).alias("kept"))
    return clickstream.stacked_sum([landed, kept], ["landed", "kept"])


@case(
    "dq06_silver_sales",
    f"SELECT invoice_id, stock_code, description, CAST(quantity AS BIGINT) AS quantity, invoiced_at, {d('unit_price')}, "
    "customer_id, country, is_return, is_anonymous FROM silver_sales",
)
def _(m: Marts):
    return m.silver_sales


RULE_NAMES = [
    "parseable_quantity", "parseable_price", "parseable_date", "not_adjustment_invoice",
    "no_negative_qty_outside_returns", "positive_price_or_return", "product_stock_code",
]


@case(
    "dq07_expectation_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE r{i}) AS passed, count(*) FILTER (WHERE NOT r{i}) AS failed FROM ruled_sales"
        for i, n in enumerate(RULE_NAMES, 1)
    ),
)
def _(m: Marts):
    return quality.expectation_counts(m.tagged_sales, quality.sales_rules())


EVENT_COLS = "event_id, session_id, visitor_id, event_type, stock_code, event_ts, referrer, is_v2"


def _typed_ts(df):
    return df.withColumn("event_ts", F.col("event_ts").try_cast("timestamp"))


@case("dq08_unified_events", f"SELECT {EVENT_COLS} FROM seen_events")
def _(m: Marts):
    return _typed_ts(m.tagged_events.drop("_rescued", "quarantine_reasons", "is_quarantined"))


@case("dq09_envelope_flattened", f"SELECT {EVENT_COLS} FROM seen_events_v3")
def _(m: Marts):
    wide = Marts(m.tables, accept_v3=True)
    return _typed_ts(wide.tagged_events.drop("_rescued", "quarantine_reasons", "is_quarantined"))


@case(
    "dq10_event_rules",
    "SELECT array_to_string(reasons, ',') AS reasons, count(*) AS rows FROM tagged_events GROUP BY 1",
)
def _(m: Marts):
    return m.tagged_events.groupBy(F.concat_ws(",", "quarantine_reasons").alias("reasons")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@case(
    "dq11_one_row_per_event",
    "SELECT event_id, session_id, visitor_id, event_type, stock_code, event_ts FROM silver_events",
)
def _(m: Marts):
    return m.silver_events.select("event_id", "session_id", "visitor_id", "event_type", "stock_code", "event_ts")


@case("dq12_redacted_referrers", "SELECT event_id, pii_detected, referrer, is_v2 FROM silver_events")
def _(m: Marts):
    return m.silver_events.select("event_id", "pii_detected", "referrer", "is_v2")


@case(
    "dq13_quarantine_events",
    f"SELECT {EVENT_COLS}, array_to_string(reasons, ',') AS reasons FROM tagged_events WHERE len(reasons) > 0",
)
def _(m: Marts):
    flat = m.quarantine_events.withColumn("reasons", F.concat_ws(",", "quarantine_reasons"))
    return _typed_ts(flat.drop("_rescued", "quarantine_reasons", "is_quarantined"))


@case(
    "dq14_quarantine_mix",
    "SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM tagged_sales) GROUP BY reason",
)
def _(m: Marts):
    return quality.reason_mix(m.quarantine_sales)


@case(
    "dq15_feed_counts",
    "SELECT (SELECT count(*) FROM feed) AS bronze_events, (SELECT count(*) FROM silver_events) AS silver_events, "
    "(SELECT count(*) FROM tagged_events WHERE len(reasons) > 0) AS quarantined, "
    "(SELECT count(*) FROM silver_events WHERE pii_detected) AS pii_caught, (SELECT count(*) FROM sessions WHERE is_bot) AS bot_sessions",
)
def _(m: Marts):
    return clickstream.feed_counts(m.tagged_events, m.bot_min_views)


def score_sql(flagged: str, labelled: str, key: str) -> str:
    return (
        f"SELECT tp, flagged, labeled, round(tp / CAST(nullif(flagged, 0) AS DOUBLE), 4) AS precision, "
        f"round(tp / CAST(nullif(labeled, 0) AS DOUBLE), 4) AS recall FROM (SELECT "
        f"(SELECT count(*) FROM (SELECT {key} FROM {flagged} INTERSECT SELECT {key} FROM {labelled})) AS tp, "
        f"(SELECT count(DISTINCT {key}) FROM {flagged}) AS flagged, (SELECT count(DISTINCT {key}) FROM {labelled}) AS labeled)"
    )


@case(
    "dq16_leak_scorecard",
    score_sql(
        "(SELECT event_id FROM silver_events WHERE pii_detected)",
        "(SELECT event_id FROM event_truth WHERE list_contains(labels, 'pii_leak'))",
        "event_id",
    ),
)
def _(m: Marts):
    flags = m.silver_events.where("pii_detected").select("event_id")
    return quality.scorecard(flags, quality.labelled(m.event_truth, "pii_leak"), "event_id")


@case(
    "dq17_bot_scorecard",
    score_sql(
        "(SELECT session_id FROM sessions WHERE is_bot)",
        "(SELECT s.session_id FROM silver_events s JOIN event_truth g ON s.event_id = g.event_id WHERE list_contains(g.labels, 'bot_session'))",
        "session_id",
    ),
)
def _(m: Marts):
    return clickstream.bot_scorecard(m.silver_events, quality.labelled(m.event_truth, "bot_session"), m.bot_min_views)


@case(
    "dq18_reconciliation",
    "SELECT (SELECT count(*) FROM event_truth WHERE list_contains(labels, 'duplicate')) AS labeled_duplicates, "
    "(SELECT count(*) FROM tagged_events WHERE len(reasons) = 0) - (SELECT count(*) FROM silver_events) AS removed, "
    "(SELECT count(*) FROM event_truth WHERE list_contains(labels, 'malformed')) AS labeled_malformed, "
    "(SELECT count(*) FROM tagged_events WHERE len(reasons) > 0) AS quarantined",
)
def _(m: Marts):
    return clickstream.reconciliation(m.event_truth, m.tagged_events, m.silver_events)


@case(
    "dq19_envelope_fix_scorecard",
    score_sql(
        "(SELECT event_id FROM silver_events_v3 EXCEPT SELECT event_id FROM silver_events)",
        "(SELECT event_id FROM event_truth WHERE list_contains(labels, 'schema_v3'))",
        "event_id",
    ),
)
def _(m: Marts):
    wide = Marts(m.tables, accept_v3=True)
    rescued = wide.silver_events.select("event_id").join(m.silver_events.select("event_id"), "event_id", "left_anti")
    return quality.scorecard(rescued, quality.labelled(m.event_truth, "schema_v3"), "event_id")


@case(
    "dq20_injected_labels",
    "SELECT event_id, array_to_string(labels, ',') AS labels FROM event_truth",
)
def _(m: Marts):
    return m.event_truth.select("event_id", F.concat_ws(",", "labels").alias("labels"))


@case(
    "dq20_dirty_rows",
    "SELECT event_id, session_id, visitor_id, event_type, stock_code, event_ts, referrer, CAST(ver AS BIGINT) AS schema_version, "
    "CAST(copies AS BIGINT) AS copies FROM injected",
)
def _(m: Marts):
    return m.injected_events.drop("labels")


@case("dq20_dirty_lines")
def _(m: Marts):
    return as_lines(m.injected_events)


# ---- gold ----------------------------------------------------------------------------------------


@case("gld01_dim_products", "SELECT * FROM dim_products")
def _(m: Marts):
    return m.dim_products


@case(
    "gld02_fact_sales",
    f"SELECT invoice_id, stock_code, customer_id, country, CAST(quantity AS BIGINT) AS quantity, {d('unit_price', 'line_amount')}, "
    "sale_date, invoiced_at, is_return, is_anonymous FROM fact_sales",
)
def _(m: Marts):
    return m.fact_sales


REVENUE = d("gross_revenue", "returns_value", "net_revenue")


@case("gld03_daily_revenue", f"SELECT sale_date, {REVENUE}, invoices, known_customers FROM daily_revenue")
def _(m: Marts):
    return m.daily_revenue


@case(
    "gld04_customer_rfm",
    f"SELECT customer_id, country, recency_days, frequency, {d('monetary')} FROM customer_rfm",
)
def _(m: Marts):
    return m.customer_rfm


@case("gld05_sessions", "SELECT * FROM sessions")
def _(m: Marts):
    return m.sessions


@case("gld06_funnel_daily", "SELECT * RENAME (sessions_ AS sessions) FROM funnel_daily")
def _(m: Marts):
    return m.funnel_daily


# ---- KPI views -----------------------------------------------------------------------------------

MONTHLY = (
    f"SELECT month, {REVENUE}, return_rate_pct, invoices, aov, known_customers, mom_net_revenue_growth_pct FROM monthly_summary"
)


@case("kpi01_monthly_summary", MONTHLY)
def _(m: Marts):
    return m.monthly_summary


@case("kpi02_customer_health", "SELECT * FROM customer_health")
def _(m: Marts):
    return m.customer_health


@case("kpi03_funnel_weekly", "SELECT * FROM funnel_weekly")
def _(m: Marts):
    return m.funnel_weekly


@case(
    "kpi04_country_performance",
    f"SELECT country, {d('net_revenue')}, return_rate_pct, aov, revenue_rank FROM country_performance",
)
def _(m: Marts):
    return m.country_performance


@case(
    "kpi05_monthly_trend",
    f"SELECT month, {REVENUE}, invoices FROM monthly_summary",
)
def _(m: Marts):
    return kpi.monthly_trend(m.daily_revenue)


@case(
    "kpi06_top_products",
    "SELECT f.stock_code, coalesce(p.product_name, '(unknown)') AS product_name, CAST(sum(line_amount) AS DOUBLE) AS net_revenue, "
    "CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT invoice_id) AS invoices FROM fact_sales f "
    "LEFT JOIN dim_products p ON f.stock_code = p.stock_code WHERE NOT is_return GROUP BY 1, 2 ORDER BY sum(line_amount) DESC, 1 LIMIT 10",
)
def _(m: Marts):
    return kpi.top_products(m.fact_sales, m.dim_products)


@case(
    "kpi07_return_rates",
    "SELECT round(count(*) FILTER (WHERE is_return) / CAST(count(*) AS DOUBLE), 4) AS line_return_rate, "
    "round(CAST(sum(CASE WHEN is_return THEN -line_amount ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN is_return THEN 0 ELSE line_amount END) AS DOUBLE), 4) "
    "AS value_return_rate FROM fact_sales",
)
def _(m: Marts):
    return kpi.return_rates(m.fact_sales)


@case(
    "kpi08_rfm_segments",
    "SELECT CASE WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Champions' WHEN r >= 3 AND f >= 2 THEN 'Loyal / Growing' "
    "WHEN r <= 2 AND f >= 3 THEN 'At Risk (was loyal)' WHEN r <= 2 AND m >= 3 THEN 'Big spender, lapsing' "
    "WHEN r = 1 THEN 'Hibernating' ELSE 'Casual' END AS segment, count(*) AS customers, "
    "round(CAST(sum(monetary) AS DOUBLE) / count(*), 2) AS avg_monetary FROM (SELECT monetary, "
    "ntile(4) OVER (ORDER BY recency_days DESC, customer_id, country) AS r, ntile(4) OVER (ORDER BY frequency, customer_id, country) AS f, "
    "ntile(4) OVER (ORDER BY monetary, customer_id, country) AS m FROM customer_rfm) GROUP BY 1",
)
def _(m: Marts):
    return kpi.rfm_segments(m.customer_rfm)


# ---- metric views --------------------------------------------------------------------------------

NET = "CAST(sum(line_amount) AS DOUBLE)"
AOV = "CAST(sum(line_amount) AS DOUBLE) / count(DISTINCT invoice_id)"


@case(
    "mv01_two_grains",
    f"SELECT 'all' AS grain, round({AOV}, 6) AS aov FROM fact_sales UNION ALL SELECT country, round({AOV}, 6) FROM fact_sales GROUP BY country",
)
def _(m: Marts):
    whole = metric_view.query(m, "revenue_metrics", ["aov"]).select(F.lit("all").alias("grain"), F.round("aov", 6).alias("aov"))
    by = metric_view.query(m, "revenue_metrics", ["aov"], ["country"])
    return whole.unionByName(by.select(F.col("country").alias("grain"), F.round("aov", 6).alias("aov")))


@case(
    "mv02_revenue_metrics",
    "SELECT f.country, p.product_name, CAST(sum(line_amount) AS DOUBLE) AS net_revenue, "
    "CAST(sum(CASE WHEN is_return THEN 0 ELSE line_amount END) AS DOUBLE) AS gross_revenue, "
    "CAST(sum(CASE WHEN is_return THEN -line_amount ELSE 0 END) AS DOUBLE) AS returns_value, "
    f"round({AOV}, 6) AS aov, CAST(sum(quantity) AS BIGINT) AS units FROM fact_sales f "
    "LEFT JOIN dim_products p ON f.stock_code = p.stock_code WHERE sale_date >= DATE '1996-01-01' GROUP BY 1, 2",
)
def _(m: Marts):
    out = metric_view.query(
        m,
        "revenue_metrics",
        ["net_revenue", "gross_revenue", "returns_value", "aov", "units"],
        ["country", "product_name"],
        {"sale_date": lambda c: c >= F.lit("1996-01-01").cast("date")},
    )
    return out.withColumn("aov", F.round("aov", 6))


@case(
    "mv03_funnel_metrics",
    "SELECT CAST(sum(sessions_) AS BIGINT) AS total_sessions, CAST(sum(purchases) AS BIGINT) AS total_purchases, "
    "round(avg(view_to_cart_rate), 6) AS avg_view_to_cart_rate, round(avg(cart_to_purchase_rate), 6) AS avg_cart_to_purchase_rate, "
    "round(avg(session_conversion_rate), 6) AS avg_session_conversion_rate FROM funnel_daily",
)
def _(m: Marts):
    names = list(metric_view.VIEWS["funnel_metrics"].measures)
    out = metric_view.query(m, "funnel_metrics", names)
    return out.select(*[F.round(n, 6).alias(n) if n.startswith("avg") else F.col(n) for n in names])


@case(
    "mv04_transactions_metrics",
    "SELECT account_type, segment, CAST(sum(amount) AS DOUBLE) AS total_amount, CAST(sum(available_balance) AS DOUBLE) AS total_available_balance, "
    "round(CAST(sum(available_balance) AS DOUBLE) / count(*), 6) AS avg_available_balance "
    "FROM bank_transactions t LEFT JOIN bank_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2",
)
def _(m: Marts):
    names = list(metric_view.VIEWS["transactions_metrics"].measures)
    out = metric_view.query(m, "transactions_metrics", names, ["account_type", "segment"])
    return out.withColumn("avg_available_balance", F.round("avg_available_balance", 6))


@case(
    "mv05_wealth_metrics",
    "SELECT segment, CAST(sum(liquid_cash_assets) AS DOUBLE) AS total_liquid_assets, "
    "round(CAST(sum(liquid_cash_assets) AS DOUBLE) / count(*), 6) AS avg_liquid_assets, CAST(sum(invested_market_value) AS DOUBLE) AS total_invested_value "
    "FROM bank_portfolios t LEFT JOIN bank_customers c ON t.customer_id = c.customer_id GROUP BY 1",
)
def _(m: Marts):
    names = list(metric_view.VIEWS["wealth_metrics"].measures)
    out = metric_view.query(m, "wealth_metrics", names, ["segment"])
    return out.withColumn("avg_liquid_assets", F.round("avg_liquid_assets", 6))


# ---- certified questions -------------------------------------------------------------------------

COUNTRY, FIRST, LAST, QUARTER = "NATION_10", "1998-12-01", "1999-01-01", ("1995-01-01", "1995-04-01")
RETAIL = certified.retail(COUNTRY, FIRST, LAST, QUARTER)
BANK = certified.banking("2026-03-01", "2026-04-01")
R = "NOT is_return"
Q = "round({0}, 6)"
GROSS = "CAST(sum(CASE WHEN is_return THEN 0 ELSE line_amount END) AS DOUBLE)"
MONTH = "CAST(date_trunc('month', sale_date) AS DATE)"
HUMAN = "FROM sessions WHERE NOT is_bot"
SHARE = "round(count(*) FILTER (WHERE {0}) / CAST(count(*) AS DOUBLE), 6)"
PRODUCT = "FROM fact_sales f JOIN dim_products p ON f.stock_code = p.stock_code WHERE NOT is_return GROUP BY product_name"

CHECKS = {
    "net_revenue_by_country": ("cq01", f"SELECT country, {NET} AS net_revenue FROM fact_sales GROUP BY country"),
    "daily_net_revenue": (
        "cq02", f"SELECT sale_date, {d('net_revenue')} FROM daily_revenue WHERE sale_date >= DATE '{FIRST}' AND sale_date < DATE '{LAST}'",
    ),
    "invoices_per_day": ("cq03", "SELECT sale_date, invoices FROM daily_revenue"),
    "top_products_by_units": (
        "cq04", f"SELECT product_name, CAST(sum(quantity) AS BIGINT) AS units {PRODUCT} ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "known_customers_per_country": ("cq05", "SELECT country, count(*) AS customers FROM customer_rfm GROUP BY country"),
    "returns_by_country": (
        "cq06", "SELECT country, CAST(sum(-line_amount) AS DOUBLE) AS returns_value FROM fact_sales WHERE is_return GROUP BY country",
    ),
    "mean_session_duration": ("cq07", f"SELECT round(avg(duration_s), 6) AS avg_duration_s {HUMAN}"),
    "sessions_and_purchases_per_day": ("cq08", "SELECT event_date, sessions_ AS sessions, purchases FROM funnel_daily"),
    "gmv_by_month": ("cq09", f"SELECT {MONTH} AS month, CAST(sum(gross_revenue) AS DOUBLE) AS gmv FROM daily_revenue GROUP BY 1"),
    "average_basket": ("cq10", f"SELECT round({AOV}, 6) AS aov FROM fact_sales WHERE country = '{COUNTRY}'"),
    "returns_take_rate": (
        "cq11", "SELECT round(CAST(sum(returns_value) AS DOUBLE) / CAST(sum(gross_revenue) AS DOUBLE), 6) AS returns_take_rate FROM daily_revenue",
    ),
    "daily_shoppers": ("cq12", "SELECT sale_date, known_customers FROM daily_revenue"),
    "conversion_by_day": ("cq13", "SELECT event_date, round(session_conversion_rate, 6) AS session_conversion_rate FROM funnel_daily"),
    "bounce_share": ("cq14", f"SELECT {SHARE.format('n_views = 1 AND n_carts = 0 AND n_purchases = 0')} AS bounce_rate {HUMAN}"),
    "whales": (
        "cq15", f"SELECT customer_id, country, {d('monetary')} FROM customer_rfm ORDER BY customer_rfm.monetary DESC, 1, 2 LIMIT 20",
    ),
    "churn_risks": ("cq16", "SELECT customer_id, country, recency_days FROM customer_rfm WHERE recency_days > 90"),
    "sell_through": (
        "cq17",
        f"SELECT product_name, round(CAST(sum(quantity) AS DOUBLE) / count(DISTINCT sale_date), 6) AS units_per_day {PRODUCT} "
        "ORDER BY CAST(sum(quantity) AS DOUBLE) / count(DISTINCT sale_date) DESC, 1 LIMIT 10",
    ),
    "basket_attach": (
        "cq18", f"SELECT round(CAST(count(*) AS DOUBLE) / count(DISTINCT invoice_id), 6) AS lines_per_invoice FROM fact_sales WHERE {R}",
    ),
    "gross_sales_total": ("cq19", "SELECT CAST(sum(gross_revenue) AS DOUBLE) AS gross_sales FROM daily_revenue"),
    "gross_sales_by_country": ("cq19", f"SELECT country, {GROSS} AS gross_net_sales FROM fact_sales GROUP BY country"),
    "gross_sales_in_country": ("cq19", f"SELECT {GROSS} AS gross_sales FROM fact_sales WHERE country = '{COUNTRY}'"),
    "anonymous_revenue_share": (
        "cq20",
        "SELECT round(CAST(sum(CASE WHEN is_anonymous THEN line_amount ELSE 0 END) AS DOUBLE) / CAST(sum(line_amount) AS DOUBLE), 6) "
        "AS anonymous_revenue_share FROM fact_sales",
    ),
    "repeat_rate_by_segment": ("cq21", "SELECT segment, repeat_purchase_rate_pct FROM customer_health"),
    "known_customers_by_month": ("cq22", "SELECT month, known_customers FROM monthly_summary"),
    "known_buyers_by_month": ("cq22", "SELECT month, known_customers AS known_buyers FROM monthly_summary"),
    "products_first_seen": (
        "cq23",
        f"SELECT stock_code, product_name, first_seen FROM dim_products WHERE first_seen >= TIMESTAMP '{QUARTER[0]}' AND first_seen < TIMESTAMP '{QUARTER[1]}'",
    ),
    "weekly_bounce_rate": ("cq24", "SELECT week, bounce_rate_pct FROM funnel_weekly"),
    "aov_by_month": ("cq25", "SELECT month, aov FROM monthly_summary"),
    "revenue_split_by_month": ("cq25", f"SELECT month, {d('gross_revenue', 'returns_value', 'net_revenue')} FROM monthly_summary"),
    "return_rate_by_month": ("cq25", "SELECT month, return_rate_pct FROM monthly_summary"),
    "top_countries": ("cq26", f"SELECT country, {d('net_revenue')}, revenue_rank FROM country_performance WHERE revenue_rank <= 5"),
    "run_rate": (
        "cq27", "SELECT CAST(net_revenue * 12 AS DOUBLE) AS annualized_run_rate FROM monthly_summary ORDER BY month DESC LIMIT 1",
    ),
    "ticket_size": ("cq28", f"SELECT round({AOV}, 6) AS avg_ticket FROM fact_sales"),
    "repeat_rate": ("cq29", f"SELECT {SHARE.format('frequency > 1')} AS repeat_rate FROM customer_rfm"),
    "lapsed_customers": ("cq30", "SELECT count(*) AS lapsed_customers FROM customer_rfm WHERE recency_days > 90"),
    "one_and_done": (
        "cq30", "SELECT count(*) AS one_and_done_customers FROM customer_rfm WHERE recency_days > 90 AND frequency = 1",
    ),
    "stickiness": ("cq31", f"SELECT {SHARE.format('converted')} AS stickiness {HUMAN}"),
    "asp": ("cq32", f"SELECT round({NET} / CAST(sum(quantity) AS DOUBLE), 6) AS asp FROM fact_sales WHERE {R}"),
    "units_per_invoice": (
        "cq32", f"SELECT round(CAST(sum(quantity) AS DOUBLE) / count(DISTINCT invoice_id), 6) AS units_per_invoice FROM fact_sales WHERE {R}",
    ),
    "top_line_by_month": ("cq33", f"SELECT month, {d('gross_revenue')} FROM monthly_summary"),
    "net_by_month": ("cq33", f"SELECT month, {d('net_revenue')} FROM monthly_summary"),
    "cart_abandonment": ("cq34", f"SELECT {SHARE.format('n_purchases = 0')} AS cart_abandonment_rate {HUMAN} AND n_carts > 0"),
    "sku_count": ("cq35", "SELECT count(DISTINCT stock_code) AS sku_count FROM dim_products"),
    "best_sellers": ("cq36", f"SELECT product_name, {NET} AS gross_revenue {PRODUCT} ORDER BY sum(line_amount) DESC, 1 LIMIT 5"),
    "daily_add_to_cart_rate": ("cq37", "SELECT event_date, round(view_to_cart_rate, 6) AS view_to_cart_rate FROM funnel_daily"),
    "mom_growth": ("cq38", "SELECT month, mom_net_revenue_growth_pct FROM monthly_summary"),
    "invoices_by_month": ("cq38", "SELECT month, invoices FROM monthly_summary"),
    "total_known_customers": ("cq38", "SELECT count(*) AS known_customers FROM customer_rfm"),
    "revenue_per_session": ("cq41", "SELECT week, revenue_per_session FROM funnel_weekly"),
}
BY_CUSTOMER = "JOIN bank_customers c ON t.customer_id = c.customer_id"
BANK_CHECKS = {
    "amount_by_account_type": "SELECT account_type, CAST(sum(amount) AS DOUBLE) AS total_amount FROM bank_transactions GROUP BY 1",
    "customers_per_segment": "SELECT segment, count(*) AS customers FROM bank_customers GROUP BY 1",
    "invested_high_net_worth": f"SELECT CAST(sum(invested_market_value) AS DOUBLE) AS total_invested FROM bank_portfolios t {BY_CUSTOMER} WHERE segment = 'High Net Worth'",
    "liquid_mass_affluent": f"SELECT CAST(sum(liquid_cash_assets) AS DOUBLE) AS total_liquid_assets FROM bank_portfolios t {BY_CUSTOMER} WHERE segment = 'Mass Affluent'",
    "mean_liquid_high_net_worth": f"SELECT round(CAST(sum(liquid_cash_assets) AS DOUBLE) / count(*), 6) AS avg_liquid_assets FROM bank_portfolios t {BY_CUSTOMER} WHERE segment = 'High Net Worth'",
    "balance_high_net_worth": f"SELECT CAST(sum(available_balance) AS DOUBLE) AS total_available_balance FROM bank_transactions t {BY_CUSTOMER} WHERE segment = 'High Net Worth'",
    "mean_checking_balance_by_segment": f"SELECT segment, round(CAST(sum(available_balance) AS DOUBLE) / count(*), 6) AS avg_available_balance FROM bank_transactions t {BY_CUSTOMER} WHERE account_type = 'Checking' GROUP BY 1",
    "large_daily_movers": "SELECT customer_id, posted_date, CAST(sum(abs(amount)) AS DOUBLE) AS moved FROM bank_transactions GROUP BY 1, 2 HAVING sum(abs(amount)) > 50000",
    "savings_in_month": "SELECT CAST(sum(amount) AS DOUBLE) AS total_amount FROM bank_transactions WHERE account_type = 'Savings' AND posted_date >= DATE '2026-03-01' AND posted_date < DATE '2026-04-01'",
    "top_invested_customers": f"SELECT customer_name, CAST(sum(invested_market_value) AS DOUBLE) AS invested FROM bank_portfolios t {BY_CUSTOMER} GROUP BY 1 ORDER BY sum(invested_market_value) DESC, 1 LIMIT 5",
    "portfolios_per_segment": f"SELECT segment, count(*) AS portfolios FROM bank_portfolios t {BY_CUSTOMER} GROUP BY 1",
    "liquid_by_segment": f"SELECT segment, CAST(sum(liquid_cash_assets) AS DOUBLE) AS total_liquid_assets FROM bank_portfolios t {BY_CUSTOMER} GROUP BY 1",
}


def answer(entry: certified.Certified, digits: int | None):
    """Run one certified question; ratios are rounded for comparison."""

    def build(m: Marts):
        out = certified.run(m, entry)
        ratios = [n for n, t in out.dtypes if t == "double"] if digits else []
        return out.select(*[F.round(n, digits).alias(n) if n in ratios else F.col(n) for n in out.columns])

    return build


for name, (key, sql) in CHECKS.items():
    add_case(f"{key}_{name}", answer(RETAIL[name], 6), sql)
for number, (name, sql) in enumerate(BANK_CHECKS.items(), 42):
    add_case(f"cq{number}_{name}", answer(BANK[name], 6), sql)
assert set(CHECKS) == set(RETAIL) and set(BANK_CHECKS) == set(BANK)


@case(
    "cq39_repeat_visitor_rate",
    f"SELECT {SHARE.format('bought > 1')} AS repeat_visitor_rate FROM (SELECT visitor_id, count(*) AS bought {HUMAN} AND n_purchases > 0 GROUP BY 1)",
)
def _(m: Marts):
    return certified.repeat_visitor_rate(m.sessions).select(F.round("repeat_visitor_rate", 6).alias("repeat_visitor_rate"))


@case(
    "cq40_repurchase_gaps",
    "SELECT count(gap) AS gaps, CAST(quantile_cont(gap, 0.5) AS DOUBLE) AS median_days, CAST(quantile_cont(gap, 0.75) AS DOUBLE) AS p75_days, "
    "CAST(quantile_cont(gap, 0.9) AS DOUBLE) AS p90_days FROM (SELECT date_diff('day', lag(sale_date) OVER (PARTITION BY customer_id ORDER BY sale_date), sale_date) AS gap "
    "FROM (SELECT DISTINCT customer_id, sale_date FROM fact_sales WHERE NOT is_anonymous AND NOT is_return)) WHERE gap IS NOT NULL",
)
def _(m: Marts):
    return certified.repurchase_gaps(m.fact_sales)
