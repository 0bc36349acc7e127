"""Shared check CTEs: the same layers written independently as plain SQL for DuckDB."""

from registered.base import CTES

CTES["bronze_sales"] = """
SELECT CASE WHEN ok % 97 = 0 THEN 'A' WHEN back THEN 'C' ELSE '' END || ok AS invoice,
  CASE WHEN pk % 211 = 0 THEN 'POST' WHEN pk % 223 = 0 THEN 'gift_0001' ELSE CAST(pk + 10000 AS VARCHAR) END AS stock_code,
  CASE WHEN ok % 53 = 0 THEN NULL WHEN ok % 7 = 0 THEN upper(p_name) ELSE p_name END AS description,
  CASE WHEN ok % 301 = 0 THEN 'n/a' ELSE CAST(CAST(CASE WHEN back OR ok % 89 = 0 THEN -qty ELSE qty END AS INT) AS VARCHAR) END AS quantity,
  strftime(o_orderdate, '%Y-%m-%d') || ' 08:' || lpad(CAST(ok % 60 AS VARCHAR), 2, '0') || ':00' AS invoice_date,
  CASE WHEN ok % 113 = 0 THEN '0' ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS price,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  n_name AS country,
  unnest(range(CASE WHEN ok % 41 = 0 THEN 2 ELSE 1 END)) AS copy_no
FROM (SELECT l_orderkey AS ok, l_partkey AS pk, l_quantity AS qty, (l_returnflag = 'R' AND l_orderkey % 10 = 0) AS back,
        CAST(floor(l_extendedprice) AS BIGINT) % 5000 + 50 AS cents, p_name, o_custkey, o_orderdate, n_name
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

CTES["typed_sales"] = """
SELECT *, TRY_CAST(quantity AS INT) AS q, TRY_CAST(price AS DECIMAL(12,2)) AS p, TRY_CAST(invoice_date AS TIMESTAMP) AS ts
FROM (SELECT DISTINCT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country FROM bronze_sales)"""

CTES["ruled_sales"] = """
SELECT *, coalesce(q IS NOT NULL, FALSE) AS r1, coalesce(p IS NOT NULL, FALSE) AS r2, coalesce(ts IS NOT NULL, FALSE) AS r3,
  coalesce(invoice NOT LIKE 'A%', FALSE) AS r4, coalesce(q IS NULL OR q > 0 OR invoice LIKE 'C%', FALSE) AS r5,
  coalesce(p IS NULL OR p > 0, FALSE) AS r6,
  coalesce(stock_code NOT IN ('POST','DOT','M','C2','D','S','BANK CHARGES','ADJUST','ADJUST2','AMAZONFEE','CRUK','PADS','B','TEST001','TEST002')
    AND stock_code NOT LIKE 'gift_%', FALSE) AS r7
FROM typed_sales"""

CTES["tagged_sales"] = """
SELECT *, list_filter([CASE WHEN NOT r1 THEN 'parseable_quantity' END, CASE WHEN NOT r2 THEN 'parseable_price' END,
  CASE WHEN NOT r3 THEN 'parseable_date' END, CASE WHEN NOT r4 THEN 'not_adjustment_invoice' END,
  CASE WHEN NOT r5 THEN 'no_negative_qty_outside_returns' END, CASE WHEN NOT r6 THEN 'positive_price_or_return' END,
  CASE WHEN NOT r7 THEN 'product_stock_code' END], lambda x: x IS NOT NULL) AS reasons,
  NOT (r1 AND r2 AND r3 AND r4 AND r5 AND r6 AND r7) AS bad
FROM ruled_sales"""

CTES["silver_sales"] = """
SELECT invoice AS invoice_id, stock_code, description, q AS quantity, ts AS invoiced_at, p AS unit_price, customer_id, country,
  invoice LIKE 'C%' AS is_return, customer_id IS NULL AS is_anonymous
FROM tagged_sales WHERE NOT bad"""

CTES["dim_products"] = """
SELECT stock_code, description AS product_name, first_seen, last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, last_seen DESC, description) AS rn FROM (
    SELECT stock_code, description, count(*) AS n, min(invoiced_at) AS first_seen, max(invoiced_at) AS last_seen
    FROM silver_sales WHERE description IS NOT NULL AND NOT is_return GROUP BY 1, 2)) WHERE rn = 1"""

CTES["fact_sales"] = """
SELECT invoice_id, stock_code, customer_id, country, quantity, unit_price, CAST(quantity * unit_price AS DECIMAL(14,2)) AS line_amount,
  CAST(invoiced_at AS DATE) AS sale_date, invoiced_at, is_return, is_anonymous FROM silver_sales"""

CTES["daily_revenue"] = """
SELECT sale_date, sum(CASE WHEN is_return THEN 0 ELSE line_amount END) AS gross_revenue,
  sum(CASE WHEN is_return THEN -line_amount ELSE 0 END) AS returns_value, sum(line_amount) AS net_revenue,
  count(DISTINCT invoice_id) AS invoices, count(DISTINCT customer_id) AS known_customers
FROM fact_sales GROUP BY sale_date"""

CTES["customer_rfm"] = """
SELECT customer_id, country, date_diff('day', max(sale_date), (SELECT max(sale_date) FROM fact_sales WHERE NOT is_anonymous)) AS recency_days,
  count(DISTINCT invoice_id) AS frequency, sum(line_amount) AS monetary
FROM fact_sales WHERE NOT is_anonymous GROUP BY customer_id, country"""

CTES["flat_events"] = """
SELECT 'e' || event_id AS event_id, 's' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'v' || user_id AS visitor_id,
  CASE event_type WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type,
  CAST(event_id % 200 + 10000 AS VARCHAR) AS stock_code, date_trunc('second', ts) AS event_ts, event_id AS seed, user_id AS visitor_seed
FROM events"""

CTES["injected"] = """
SELECT event_id, session_id, visitor_id, event_type, stock_code,
  CASE WHEN fk % 50 = 0 THEN event_ts - to_hours(CAST(fk % 66 + 6 AS INT)) ELSE event_ts END AS event_ts,
  CASE WHEN fk % 101 = 0 THEN 'https://shop.example.com/track?email=user' || visitor_seed || '@example.com' ELSE 'direct' END AS referrer,
  CASE WHEN fk % 199 = 0 THEN 0 WHEN fk % 17 = 0 THEN 3 WHEN fk % 10 = 0 THEN 2 ELSE 1 END AS ver,
  CASE WHEN fk % 33 = 0 THEN 2 ELSE 1 END AS copies, bot, fk
FROM (
  SELECT CASE WHEN bot THEN event_id || '-' || step ELSE event_id END AS event_id, session_id, visitor_id,
    CASE WHEN bot THEN 'view' ELSE event_type END AS event_type, stock_code, event_ts + to_seconds(2 * step) AS event_ts,
    CASE WHEN bot THEN seed * 64 + step ELSE seed END AS fk, bot, visitor_seed
  FROM (SELECT *, visitor_seed % 25 = 0 AS bot, unnest(range(CASE WHEN visitor_seed % 25 = 0 THEN 40 ELSE 1 END)) AS step FROM flat_events))"""

CTES["event_truth"] = """
SELECT event_id, labels FROM (
  SELECT event_id, list_filter([CASE WHEN bot THEN 'bot_session' END, CASE WHEN fk % 101 = 0 THEN 'pii_leak' END,
    CASE WHEN fk % 50 = 0 THEN 'late' END, CASE WHEN ver = 2 THEN 'schema_drift' END, CASE WHEN ver = 0 THEN 'malformed' END,
    CASE WHEN ver = 3 THEN 'schema_v3' END], lambda x: x IS NOT NULL) AS labels FROM injected
  UNION ALL SELECT event_id, ['duplicate'] FROM injected WHERE copies = 2) WHERE len(labels) > 0"""

CTES["feed"] = """
SELECT event_id, session_id, visitor_id, event_type, stock_code, event_ts, referrer, ver, unnest(range(copies)) AS copy_no FROM injected"""

for name, lost in (("seen_events", "(0, 3)"), ("seen_events_v3", "(0)")):
    CTES[name] = f"""
SELECT CASE WHEN ver IN {lost} THEN NULL ELSE event_id END AS event_id, CASE WHEN ver IN {lost} THEN NULL ELSE session_id END AS session_id,
  CASE WHEN ver IN {lost} THEN NULL ELSE visitor_id END AS visitor_id, CASE WHEN ver IN {lost} THEN NULL ELSE event_type END AS event_type,
  CASE WHEN ver IN {lost} THEN NULL ELSE stock_code END AS stock_code, CASE WHEN ver IN {lost} THEN NULL ELSE event_ts END AS event_ts,
  CASE WHEN ver IN {lost} THEN NULL ELSE referrer END AS referrer, ver = 2 AS is_v2 FROM feed"""

for tagged, seen, silver in (
    ("tagged_events", "seen_events", "silver_events"),
    ("tagged_events_v3", "seen_events_v3", "silver_events_v3"),
):
    CTES[tagged] = f"""
SELECT *, list_filter([CASE WHEN event_id IS NULL THEN 'has_event_id' END,
  CASE WHEN event_type IS NULL OR event_type NOT IN ('view','add_to_cart','purchase') THEN 'known_event_type' END,
  CASE WHEN event_ts IS NULL THEN 'parseable_ts' END], lambda x: x IS NOT NULL) AS reasons FROM {seen}"""
    CTES[silver] = f"""
SELECT event_id, session_id, visitor_id, event_type, stock_code, event_ts, referrer LIKE '%@%' AS pii_detected,
  regexp_replace(referrer, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+', '[REDACTED]', 'g') AS referrer, is_v2
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_ts, session_id) AS rn FROM {tagged} WHERE len(reasons) = 0) WHERE rn = 1"""

CTES["sessions"] = """
SELECT session_id, visitor_id, min(event_ts) AS started_at, max(event_ts) AS ended_at,
  count(*) FILTER (WHERE event_type = 'view') AS n_views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS n_carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
  CAST(epoch(max(event_ts)) - epoch(min(event_ts)) AS BIGINT) AS duration_s,
  count(*) FILTER (WHERE event_type = 'view') >= 40 AND count(*) FILTER (WHERE event_type = 'purchase') = 0 AS is_bot,
  count(*) FILTER (WHERE event_type = 'purchase') > 0 AS converted
FROM silver_events GROUP BY session_id, visitor_id"""

CTES["funnel_daily"] = """
SELECT *, CAST(add_to_carts AS DOUBLE) / nullif(views, 0) AS view_to_cart_rate,
  CAST(purchases AS DOUBLE) / greatest(add_to_carts, 1) AS cart_to_purchase_rate, CAST(purchases AS DOUBLE) / sessions_ AS session_conversion_rate
FROM (SELECT CAST(started_at AS DATE) AS event_date, count(*) AS sessions_, CAST(sum(n_views) AS BIGINT) AS views,
    CAST(sum(n_carts) AS BIGINT) AS add_to_carts, CAST(sum(n_purchases) AS BIGINT) AS purchases
  FROM sessions WHERE NOT is_bot GROUP BY 1)"""

CTES["monthly_summary"] = """
SELECT m.month, gross_revenue, net_revenue, returns_value,
  round(100 * CAST(returns_value AS DOUBLE) / nullif(CAST(gross_revenue AS DOUBLE), 0), 2) AS return_rate_pct, invoices,
  round(CAST(net_revenue AS DOUBLE) / nullif(invoices, 0), 2) AS aov, known_customers,
  round(100 * CAST(net_revenue - prior AS DOUBLE) / nullif(CAST(prior AS DOUBLE), 0), 2) AS mom_net_revenue_growth_pct
FROM (SELECT *, lag(net_revenue) OVER (ORDER BY month) AS prior FROM (
    SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, sum(gross_revenue) AS gross_revenue, sum(net_revenue) AS net_revenue,
      sum(returns_value) AS returns_value, CAST(sum(invoices) AS BIGINT) AS invoices FROM daily_revenue GROUP BY 1)) m
LEFT JOIN (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, count(DISTINCT customer_id) AS known_customers
  FROM fact_sales WHERE NOT is_anonymous GROUP BY 1) c ON m.month = c.month"""

CTES["customer_health"] = """
SELECT segment, count(*) AS customers, round(CAST(sum(monetary) AS DOUBLE) / count(*), 2) AS avg_monetary,
  round(CAST(sum(recency_days) AS DOUBLE) / count(*), 1) AS avg_recency_days,
  round(100.0 * (count(*) FILTER (WHERE frequency > 1) / CAST(count(*) AS DOUBLE)), 2) AS repeat_purchase_rate_pct,
  count(*) FILTER (WHERE recency_days > 90) AS churn_risk_count
FROM (SELECT *, unnest(['all', 'Q' || ntile(4) OVER (ORDER BY monetary DESC, customer_id, country)]) AS segment FROM customer_rfm) GROUP BY segment"""

CTES["funnel_weekly"] = """
SELECT s.week, n AS sessions, conv AS converted_sessions, round(conv / CAST(n AS DOUBLE), 4) AS session_conversion_rate,
  bounce AS bounce_sessions, round(100 * bounce / CAST(n AS DOUBLE), 2) AS bounce_rate_pct, CAST(net_revenue AS DOUBLE) AS net_revenue,
  round(CAST(net_revenue AS DOUBLE) / n, 2) AS revenue_per_session
FROM (SELECT CAST(date_trunc('week', started_at) AS DATE) AS week, count(*) AS n, count(*) FILTER (WHERE converted) AS conv,
    count(*) FILTER (WHERE n_views = 1 AND n_carts = 0 AND n_purchases = 0) AS bounce FROM sessions WHERE NOT is_bot GROUP BY 1) s
LEFT JOIN (SELECT CAST(date_trunc('week', sale_date) AS DATE) AS week, sum(net_revenue) AS net_revenue FROM daily_revenue GROUP BY 1) r ON s.week = r.week"""

CTES["country_performance"] = """
SELECT country, net_revenue, round(100 * CAST(ret AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0), 2) AS return_rate_pct,
  round(CAST(net_revenue AS DOUBLE) / nullif(invoices, 0), 2) AS aov, rank() OVER (ORDER BY net_revenue DESC) AS revenue_rank
FROM (SELECT country, sum(line_amount) AS net_revenue, sum(line_amount) FILTER (WHERE NOT is_return) AS gross,
    coalesce(sum(-line_amount) FILTER (WHERE is_return), 0) AS ret, count(DISTINCT invoice_id) AS invoices FROM fact_sales GROUP BY country)"""

CTES["bank_customers"] = """
SELECT 'C' || c_custkey AS customer_id, c_name AS customer_name,
  CASE WHEN c_custkey % 10 < 3 THEN 'Mass Affluent' WHEN c_custkey % 10 = 3 THEN 'High Net Worth' ELSE 'Retail' END AS segment,
  DATE '2026-01-01' + CAST(c_custkey % 120 AS INT) AS onboarded_date FROM customer"""
CTES["bank_transactions"] = """
SELECT 'T' || o_orderkey AS transaction_id, 'C' || o_custkey AS customer_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Checking' ELSE 'Savings' END AS account_type,
  CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,4)) AS amount,
  CAST(o_totalprice / 2 AS DECIMAL(18,4)) AS available_balance, DATE '2026-01-01' + CAST(o_orderkey % 181 AS INT) AS posted_date FROM orders"""
CTES["bank_portfolios"] = """
SELECT 'P' || c_custkey AS portfolio_id, 'C' || c_custkey AS customer_id, CAST(c_acctbal + 1000 AS DECIMAL(18,4)) AS liquid_cash_assets,
  CAST(c_acctbal * 10 + 50000 AS DECIMAL(18,4)) AS invested_market_value, DATE '2026-05-01' + CAST(c_custkey % 60 AS INT) AS last_valuation_date FROM customer"""
