"""The table graph: every layer as a lazily derived DataFrame, from raw inputs or from stored tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyloom import fixed_values as fv
from tallyloom.operators import clickstream, faults, kpi, sales
from tallyloom.operators.quality import quarantined_rows
from tallyloom.sources import warehouse as wh


class Marts:
    """Layers over the raw sales lines and the event feed. Nothing runs until a result is asked for, so
    a question that needs two columns of one layer is planned by Catalyst down to the scans."""

    def __init__(self, tables: wh.Warehouse, accept_v3: bool = False, bot_min_views: int = fv.BOT_MIN_VIEWS):
        self.tables = tables
        self.spark: SparkSession = tables.spark
        self.accept_v3 = accept_v3
        self.bot_min_views = bot_min_views

    # sales
    @cached_property
    def bronze_sales(self) -> DataFrame:
        return wh.raw_sales(self.tables)

    @cached_property
    def tagged_sales(self) -> DataFrame:
        return sales.tagged_sales(self.bronze_sales)

    @cached_property
    def quarantine_sales(self) -> DataFrame:
        return quarantined_rows(self.tagged_sales)

    @cached_property
    def silver_sales(self) -> DataFrame:
        return sales.silver_sales(self.tagged_sales)

    @cached_property
    def dim_products(self) -> DataFrame:
        return sales.dim_products(self.silver_sales)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return sales.fact_sales(self.silver_sales)

    @cached_property
    def daily_revenue(self) -> DataFrame:
        return sales.daily_revenue(self.fact_sales)

    @cached_property
    def customer_rfm(self) -> DataFrame:
        return sales.customer_rfm(self.fact_sales)

    # clickstream
    @cached_property
    def injected_events(self) -> DataFrame:
        return faults.inject(wh.flat_events(self.tables))

    @cached_property
    def event_truth(self) -> DataFrame:
        return faults.ground_truth(self.injected_events)

    @cached_property
    def event_lines(self) -> DataFrame:
        return faults.as_lines(self.injected_events)

    @cached_property
    def tagged_events(self) -> DataFrame:
        return clickstream.tagged_events(self.event_lines, self.accept_v3)

    @cached_property
    def silver_events(self) -> DataFrame:
        return clickstream.silver_events(self.tagged_events)

    @cached_property
    def quarantine_events(self) -> DataFrame:
        return clickstream.quarantine_events(self.tagged_events)

    @cached_property
    def sessions(self) -> DataFrame:
        return clickstream.sessions(self.silver_events, self.bot_min_views)

    @cached_property
    def funnel_daily(self) -> DataFrame:
        return clickstream.funnel_daily(self.sessions)

    # KPI views
    @cached_property
    def monthly_summary(self) -> DataFrame:
        return kpi.monthly_summary(self.daily_revenue, self.fact_sales)

    @cached_property
    def customer_health(self) -> DataFrame:
        return kpi.customer_health(self.customer_rfm)

    @cached_property
    def funnel_weekly(self) -> DataFrame:
        return kpi.funnel_weekly(self.sessions, self.daily_revenue)

    @cached_property
    def country_performance(self) -> DataFrame:
        return kpi.country_performance(self.fact_sales)

    # bank
    @cached_property
    def bank_customers(self) -> DataFrame:
        return wh.bank_customers(self.tables)

    @cached_property
    def bank_transactions(self) -> DataFrame:
        return wh.bank_transactions(self.tables)

    @cached_property
    def bank_portfolios(self) -> DataFrame:
        return wh.bank_portfolios(self.tables)
