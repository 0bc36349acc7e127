from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.ranking import tiles_by_cuts
from tallyloom.operators import certified, metric_view, sales
from tallyloom.operators.quality import expectation_counts, quarantined_rows, sales_rules

GOOD = ("536365", "85123A", "mug", "6", "2010-12-01 08:26:00", "2.55", "17850", "United Kingdom")


def line(**changes):
    return tuple({**dict(zip(fv.SALES_KEY, GOOD)), **changes}.values())


@pytest.fixture(scope="module")
def raw(spark):
    data = [
        line(),
        line(),  # exact copy
        line(invoice="A1"),
        line(invoice="C1", quantity="-6"),
        line(invoice="C2", quantity="0"),
        line(quantity="-1"),
        line(quantity="n/a"),
        line(price="0"),
        line(invoice="C3", price="-1"),
        line(stock_code="POST"),
        line(stock_code="giftX1"),  # the pattern's underscore matches any one character
        line(stock_code="gift"),
        line(invoice_date="yesterday"),
        line(invoice=None),
        line(stock_code=None),
        line(customer_id=None, invoice="7"),
    ]
    return spark.createDataFrame(data, ", ".join(f"{c} STRING" for c in fv.SALES_KEY))


def test_every_distinct_row_is_silver_or_quarantined(raw):
    tagged = sales.tagged_sales(raw)
    silver, bad = sales.silver_sales(tagged).count(), quarantined_rows(tagged).count()
    assert raw.distinct().count() == silver + bad == 15
    assert silver == 5


def test_reasons_name_the_failed_rules(raw):
    bad = quarantined_rows(sales.tagged_sales(raw))
    got = {(r.invoice, r.stock_code, r.quantity, r.price): list(r.quarantine_reasons) for r in bad.collect()}
    assert got[("536365", "85123A", "n/a", "2.55")] == ["parseable_quantity"]
    assert got[("C3", "85123A", "6", "-1")] == ["positive_price_or_return"]
    assert got[("A1", "85123A", "6", "2.55")] == ["not_adjustment_invoice"]
    assert got[(None, "85123A", "6", "2.55")] == ["not_adjustment_invoice"]
    assert got[("536365", None, "6", "2.55")] == ["product_stock_code"]
    assert got[("536365", "giftX1", "6", "2.55")] == ["product_stock_code"]


def test_expectation_counts_add_up(raw):
    for r in expectation_counts(raw, sales_rules()).collect():
        assert r.passed + r.failed == raw.count()


def test_returns_are_signed_and_net_is_gross_minus_returns(raw):
    facts = sales.fact_sales(sales.silver_sales(sales.tagged_sales(raw)))
    day = sales.daily_revenue(facts).first()
    assert day.net_revenue == day.gross_revenue - day.returns_value
    assert day.returns_value == Decimal("15.30")
    assert day.known_customers == 1 and day.invoices == 4


def test_modal_description_breaks_ties_by_recency_then_text(spark):
    data = [
        ("1", "S", d, 1, ts, 1, "c", "UK", False, False)
        for d, ts in [("b", "2010-01-01"), ("a", "2010-01-01"), ("late", "2010-01-02"), ("x", "2009-01-01"), ("x", "2009-01-02")]
    ]
    silver = spark.createDataFrame(
        data, "invoice_id STRING, stock_code STRING, description STRING, quantity INT, ts STRING, unit_price INT, customer_id STRING, "
        "country STRING, is_return BOOLEAN, is_anonymous BOOLEAN",
    ).withColumn("invoiced_at", F.col("ts").cast("timestamp"))
    assert sales.dim_products(silver).first().product_name == "x"
    assert sales.dim_products(silver.where("description <> 'x'")).first().product_name == "late"
    assert sales.dim_products(silver.where("description in ('a', 'b')")).first().product_name == "a"


def test_tiles_equal_the_plain_window_with_hot_ties(spark):
    # a third of the rows share one value
    df = spark.range(0, 1003).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("v"))
    plain = df.select("id", F.ntile(4).over(Window.orderBy(F.desc("v"), "id")).alias("want"), F.ntile(4).over(Window.orderBy("v", "id")).alias("want_up"))
    got = tiles_by_cuts(df, {"got": -F.col("v"), "got_up": F.col("v")}, ["id"], 4).join(plain, "id")
    assert got.where("got <> want or got_up <> want_up").count() == 0 and got.count() == 1003


def test_tiles_of_fewer_rows_than_tiles(spark):
    got = tiles_by_cuts(spark.range(3), {"t": F.col("id")}, ["id"], 4)
    assert sorted(rows(got.select("id", "t"))) == [(0, 1), (1, 2), (2, 3)]
    assert tiles_by_cuts(spark.range(0), {"t": F.col("id")}, ["id"], 4).count() == 0


def test_metric_view_joins_only_what_is_asked(marts):
    lean = metric_view.query(marts, "transactions_metrics", ["total_amount"], ["account_type"])
    wide = metric_view.query(marts, "transactions_metrics", ["total_amount"], ["segment"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(lean) and "Join" in plan(wide)
    with pytest.raises(KeyError):
        metric_view.query(marts, "revenue_metrics", ["profit"])


def test_aov_is_a_ratio_of_aggregates(marts):
    one = metric_view.query(marts, "revenue_metrics", ["aov"]).first().aov
    facts = marts.fact_sales.agg(F.sum("line_amount").alias("s"), F.countDistinct("invoice_id").alias("n")).first()
    assert one == pytest.approx(float(facts.s) / facts.n)


def test_product_ranking_shrinks_facts_before_the_join(marts):
    entry = certified.retail("UK", "1998-01-01", "1999-01-01", ("1998-01-01", "1998-04-01"))["best_sellers"]
    plan = certified.run(marts, entry)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [stock_code")


def test_repurchase_gaps(spark):
    days = ["2020-01-01", "2020-01-11", "2020-01-11", "2020-02-10"]
    facts = spark.createDataFrame([("a", d, False, False) for d in days], "customer_id STRING, d STRING, is_return BOOLEAN, is_anonymous BOOLEAN")
    got = certified.repurchase_gaps(facts.withColumn("sale_date", F.to_date("d"))).first()
    assert (got.gaps, got.median_days) == (2, 20.0)


def test_synonym_cap_case_and_order(spark):
    held = spark.createDataFrame([("v", "m", "GMV", 1), ("v", "m", "gross", 2)], "view STRING, name STRING, synonym STRING, position BIGINT")
    words = ["gmv", "Top", "top"] + [f"w{i}" for i in range(20)]
    learned = spark.createDataFrame([("v", "m", w, i) for i, w in enumerate(words)], "view STRING, name STRING, synonym STRING, position BIGINT")
    merged = metric_view.merge_synonyms(held, learned, ["view", "name"]).orderBy("position").collect()
    assert len(merged) == 23 and sum(r.held_back for r in merged) == 13  # none is lost
    got = [r.synonym for r in merged if not r.held_back]
    assert got == ["GMV", "gross", "Top"] + [f"w{i}" for i in range(7)]
