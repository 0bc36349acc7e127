"""Revenue by product name: facts meet a large product dimension unsorted, order texts are written once an order."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from conftest import rows

from tallyloom import fixed_values as fv
from tallyloom.operators import metric_view, sales
from tallyloom.sources.warehouse import Warehouse, raw_sales


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def test_facts_are_not_sorted_to_meet_their_product(no_broadcast):
    line = lambda invoice, code, text, n: (invoice, code, text, n, "2010-12-01 08:26:00", "2.00", "c", "UK")
    lines = [line(str(i), "HOT", "mug", "1") for i in range(50)] + [line("C1", "HOT", "mug", "-3"), line("C2", "R", "cup", "-1")]
    lines += [line("7", "X", None, "4"), line("8", "Y", "mug", "5"), line("8", "Z", "pot", "6")]
    raw = no_broadcast.createDataFrame(lines, ", ".join(f"{c} STRING" for c in fv.SALES_KEY))
    silver = sales.silver_sales(sales.tagged_sales(raw))
    marts = SimpleNamespace(fact_sales=sales.fact_sales(silver), dim_products=sales.dim_products(silver))
    out = metric_view.query(marts, "revenue_metrics", ["net_revenue", "units", "aov"], ["product_name"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.product_name: (float(r.net_revenue), r.units, round(r.aov, 4)) for r in out.collect()}
    # "mug" is the name of two codes: 50 + 1 + 1 invoices, of which number 8 is in "Y" and "HOT"
    assert got == {"mug": (104.0, 52, round(104 / 51, 4)), "pot": (12.0, 6, 12.0), None: (6.0, 3, 3.0)}


@pytest.fixture
def shop(spark, tmp_path):
    tables = {
        "nation": ("n_nationkey INT, n_name STRING", [(1, "UK"), (2, None)]),
        "customer": ("c_custkey BIGINT, c_nationkey INT", [(5, 1), (6, 1), (7, 2), (8, None), (None, 1)]),
        "part": ("p_partkey BIGINT, p_name STRING", [(1, "mug"), (2, None), (211, "post")]),
        "orders": (
            "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP",
            [
                (61, 6, datetime(1996, 1, 2)), (62, 5, datetime(1996, 1, 3)), (63, 7, None), (63, 7, datetime(1996, 1, 4)),
                (64, 8, datetime(1996, 1, 5)), (65, None, datetime(1996, 1, 6)), (None, 6, datetime(1996, 1, 7)),
            ],
        ),
        "lineitem": (
            "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag STRING",
            [
                (61, 1, 3.0, 10.5, "N"), (61, 1, 3.0, 10.5, "N"), (62, 2, 4.0, None, "R"), (63, 211, None, 20.0, None),
                (64, 1, 1.0, 1.0, "N"), (65, 1, 1.0, 1.0, "N"), (None, 1, 1.0, 1.0, "N"), (61, None, 1.0, 1.0, "N"),
            ],
        ),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return raw_sales(Warehouse(spark, str(tmp_path)))


def test_texts_of_an_order_are_written_once_an_order(shop):
    plan = shop._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generator = [line for line in plan if "Generate inline" in line]
    assert len(generator) == 1 and " 08:" not in generator[0]
    assert any(" 08:" in line for line in plan[plan.index(generator[0]) + 1 :])


def test_lines_of_odd_orders_are_as_they_were(shop):
    assert sorted(rows(shop), key=str) == sorted(
        [
            ("61", "10001", "mug", "3", "1996-01-02 08:01:00", "0.60", "6", "UK"),
            ("61", "10001", "mug", "3", "1996-01-02 08:01:00", "0.60", "6", "UK"),
            ("62", "10002", None, "4", "1996-01-03 08:02:00", None, None, "UK"),
            ("63", "POST", "POST", None, None, "0.70", "7", None),
            ("63", "POST", "POST", None, "1996-01-04 08:03:00", "0.70", "7", None),
        ],
        key=str,
    )
