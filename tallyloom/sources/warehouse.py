"""The domain's raw inputs, derived by Spark from the warehouse tables in a parquet folder.

Sales lines come from lineitem/orders/customer/part, clickstream from events, question telemetry from
conversations, the bank tables from customer/orders. Every function uses its whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Warehouse:
    """Named parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by the hash of their keys: a narrow table is a file or two, hence a task or two, however
    much is made of each row behind the scan."""
    return rows.repartition(*keys)


def text_of(name: str) -> Column:
    return F.col(name).cast("string")


def raw_sales(t: Warehouse) -> DataFrame:
    """Sales lines as landed: all strings, with the faults a real export has (see FIXTURES B1)."""
    # the order heads meet their customer first, so the lines are shuffled by order key only once; what an order
    # fixes is written once an order, not once a line
    minute = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    heads = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" 08:"), minute, F.lit(":00")).alias("invoice_date"),
            F.when(every("o_custkey", 5), F.lit(None)).otherwise(text_of("o_custkey")).alias("customer_id"),
            F.col("n_name").alias("country"),
        )
    )
    base = (
        t("lineitem")
        .join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    returned = (F.col("l_returnflag") == "R") & every("l_orderkey", 10)
    cents = F.floor("l_extendedprice") % 5000 + 50
    signed = F.when(returned | every("l_orderkey", 89), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    copies = F.when(every("l_orderkey", 41), 2).otherwise(1)
    line = F.struct(
        F.concat(
            F.when(every("l_orderkey", 97), "A").when(returned, "C").otherwise(""), text_of("l_orderkey")
        ).alias("invoice"),
        F.when(every("l_partkey", 211), "POST")
        .when(every("l_partkey", 223), "gift_0001")
        .otherwise((F.col("l_partkey") + 10000).cast("string"))
        .alias("stock_code"),
        F.when(every("l_orderkey", 53), F.lit(None))
        .when(every("l_orderkey", 7), F.upper("p_name"))
        .otherwise(F.col("p_name"))
        .alias("description"),
        F.when(every("l_orderkey", 301), "n/a").otherwise(signed.cast("int").cast("string")).alias("quantity"),
        "invoice_date",
        F.when(every("l_orderkey", 113), "0")
        .otherwise(
            F.concat(
                F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
            )
        )
        .alias("price"),
        "customer_id",
        "country",
    )
    # the line leaves a generator, as it would leave a file scan: rules on its fields stay above it
    # and read the built strings instead of building them again
    return base.select(F.inline(F.array_repeat(line, copies)))


def flat_events(t: Warehouse) -> DataFrame:
    """Clean click events: one row per event, version 1 field names, timestamps in UTC seconds."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return dealt(t("events").select("event_id", "ts", "user_id", "event_type"), "event_id", "ts").select(
        F.concat(F.lit("e"), text_of("event_id")).alias("event_id"),
        F.concat(F.lit("s"), text_of("user_id"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        F.concat(F.lit("v"), text_of("user_id")).alias("visitor_id"),
        F.when(F.col("event_type") == "click", "add_to_cart").otherwise(F.col("event_type")).alias("event_type"),
        (F.col("event_id") % 200 + 10000).cast("string").alias("stock_code"),
        ts.alias("event_ts"),
        F.lit("direct").alias("referrer"),
        F.col("event_id").alias("seed"),
        F.col("user_id").alias("visitor_seed"),
    )


QUESTION_FORMS = [
    "GMV means gross_revenue in gold_daily_revenue",
    "sales means net_revenue in gold_daily_revenue",
    "sales means quantity in fact_sales",
    "why is perfect order down",
    "show perfect order by region",
    "What was net revenue by country last month?",
    "How are we doing?",
    "Pull the Salesforce pipeline for me",
    "whales refers to gold_customer_rfm.monetary",
    "What is our gross margin this month?",
    "AOV means revenue_metrics.aov",
]
QUESTION_SQL = "SELECT country, SUM(net_revenue) FROM gold_daily_revenue GROUP BY country"
DOMAIN_ROLES = ["finance", "pm", "marketing", "merchandising"]


def pick(values: list, index: Column, default: Column) -> Column:
    """The value at an index of a literal list, the default beyond its end."""
    listed = F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))
    return F.when(index < len(values), listed).otherwise(default)


def telemetry(t: Warehouse) -> DataFrame:
    """User messages: question or correction text, generated SQL, rating, epoch seconds.

    Each user turn is a row with its own text; eleven of twelve have a row more, a fixed sentence of the domain.
    """
    form = (F.col("conv_id") + F.col("turn")) % 12
    said = F.struct(F.lit("").alias("mark"), F.col("text").alias("content"))
    fixed = F.struct(F.lit("-f").alias("mark"), pick(QUESTION_FORMS, form, F.lit(None)).alias("content"))
    turns = dealt(t("conversations").where(F.col("role") == "user").select("conv_id", "turn", "text"), "conv_id", "turn")
    return (
        turns.select("conv_id", "turn", F.inline(F.when(form < len(QUESTION_FORMS), F.array(said, fixed)).otherwise(F.array(said))))
        .select(
            text_of("conv_id").alias("conversation_id"),
            F.concat(text_of("conv_id"), F.lit("-"), text_of("turn"), "mark").alias("message_id"),
            F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"),
            pick(DOMAIN_ROLES, F.col("conv_id") % 5, F.lit("unknown")).alias("role"),
            "content",
            F.when(form == 5, QUESTION_SQL).otherwise("").alias("sql"),
            F.when(form == 5, "POSITIVE")
            .when(form.isin(3, 4, 6, 7, 9), "NEGATIVE")
            .otherwise("")
            .alias("feedback_rating"),
            (F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("double").alias("ts"),
        )
    )


def bank_customers(t: Warehouse) -> DataFrame:
    digit = F.col("c_custkey") % 10
    return t("customer").select(
        F.concat(F.lit("C"), text_of("c_custkey")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(digit < 3, "Mass Affluent").when(digit == 3, "High Net Worth").otherwise("Retail").alias("segment"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 120).cast("int")).alias("onboarded_date"),
    )


def bank_transactions(t: Warehouse) -> DataFrame:
    return t("orders").select(
        F.concat(F.lit("T"), text_of("o_orderkey")).alias("transaction_id"),
        F.concat(F.lit("C"), text_of("o_custkey")).alias("customer_id"),
        F.when(every("o_orderkey", 2), "Checking").otherwise("Savings").alias("account_type"),
        F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        (F.col("o_totalprice") / 2).alias("available_balance"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("o_orderkey") % 181).cast("int")).alias("posted_date"),
    )


def bank_portfolios(t: Warehouse) -> DataFrame:
    return t("customer").select(
        F.concat(F.lit("P"), text_of("c_custkey")).alias("portfolio_id"),
        F.concat(F.lit("C"), text_of("c_custkey")).alias("customer_id"),
        (F.col("c_acctbal") + 1000).alias("liquid_cash_assets"),
        (F.col("c_acctbal") * 10 + 50000).alias("invested_market_value"),
        F.date_add(F.lit("2026-05-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("last_valuation_date"),
    )


def query_history(t: Warehouse) -> DataFrame:
    app = pick(["Assistant", "SQL Editor", "Dashboard"], F.col("o_orderkey") % 4, F.lit(None))
    return t("orders").select(
        F.concat(F.lit("q"), (F.col("o_orderkey") % 40).cast("string"), F.lit(" "), F.col("o_orderpriority")).alias(
            "statement_text"
        ),
        F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string")).alias("executed_by"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.floor("o_totalprice").alias("total_duration_ms"),
        F.when(every("o_orderkey", 11), "FAILED").otherwise("FINISHED").alias("execution_status"),
        app.alias("client_application"),
        (F.floor("o_totalprice") * 1048576).alias("read_bytes"),
    )


LEDGER_ACTIONS = ["uc_comment", "uc_tag", "space_update", "metric_view_synonyms", "disambiguation_instruction"]


def audit_ledger(t: Warehouse) -> DataFrame:
    """Healing ledger rows, one per event: action from the event id, approver from the user."""
    key = F.concat(F.lit("term"), (F.col("event_id") % 97).cast("string"))
    return t("events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        pick(LEDGER_ACTIONS, F.col("event_id") % 5, F.lit("")).alias("action"),
        F.concat(F.lit("gold.col"), (F.col("event_id") % 13).cast("string")).alias("target"),
        key.alias("proposal_key"),
        F.concat(F.lit("payload "), text_of("event_id")).alias("payload"),
        pick(["applied", "approved", "failed"], F.col("event_id") % 4, F.lit("applied")).alias("status"),
        pick(["auto", "human:ann", "human:bo"], F.col("user_id") % 4, F.lit(None)).alias("approver"),
    )


QUEUE_KINDS = ["below_gate_proposal", "poison_conflict", "novel_term"]
QUEUE_STATES = ["pending", "approved", "rejected", "applied"]


def review_queue(t: Warehouse) -> DataFrame:
    """Escalation queue, one row per part: the part name plays the disputed term."""
    kind = pick(QUEUE_KINDS, F.col("p_partkey") % 3, F.lit(""))
    status = pick(QUEUE_STATES, F.col("p_size") % 4, F.lit(""))
    term = F.concat_ws(" ", F.col("p_name"), text_of("p_partkey"))
    created = F.timestamp_seconds(F.lit(1767225600) + F.col("p_partkey") % 2000 * 3600)
    decided = F.col("p_size") % 4 != 0
    return t("part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(":", kind, term).alias("proposal_key"),
        term.alias("term"),
        F.when(kind == QUEUE_KINDS[0], F.concat(F.lit("fact_sales.c"), text_of("p_size"))).alias("entity"),
        F.round((F.col("p_partkey") % 75).cast("double") / 100, 2).alias("confidence"),
        (F.col("p_size") % 5 + 1).cast("int").alias("distinct_users"),
        kind.alias("kind"),
        status.alias("status"),
        created.alias("created_at"),
        F.when(decided, created + F.expr("INTERVAL 1 DAY")).alias("decided_at"),
        F.when(decided, F.concat(F.lit("human:"), F.lower("p_type"))).alias("decided_by"),
        F.to_json(F.struct((F.col("p_size") * 3).alias("occurrences"), term.alias("term"))).alias("evidence"),
    )


def queue_rulings(t: Warehouse) -> DataFrame:
    """Rulings staged by reviewers: one per part above the base price, some of them not a valid word."""
    return (
        t("part")
        .where(F.col("p_retailprice") > 950)
        .select(
            F.col("p_partkey").alias("id"),
            pick(["approve", "reject", "maybe"], F.col("p_size") % 3, F.lit("")).alias("ruling"),
            F.concat(F.lit("user"), (F.col("p_partkey") % 20).cast("string")).alias("principal"),
        )
    )


def role_grants(t: Warehouse) -> DataFrame:
    """Role grants, one per customer; a negative balance plays a revoked grant."""
    granted = F.timestamp_seconds(F.lit(1767225600) + F.col("c_custkey") % 1000 * 60)
    return t("customer").select(
        F.concat(F.lit("user"), text_of("c_custkey")).alias("principal"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "metric_reviewer").otherwise("viewer").alias("role"),
        F.lit("admin").alias("granted_by"),
        granted.alias("granted_at"),
        F.when(F.col("c_acctbal") < 0, granted + F.expr("INTERVAL 30 DAYS")).alias("revoked_at"),
    )


def eval_suite(t: Warehouse) -> DataFrame:
    """Benchmark questions with their trap tag; items whose tag is 'bad' have no answer query."""
    tag = pick(["false", "true", "collision"], F.col("item_id") % 4, F.lit("bad"))
    return t("benchmark").select(
        F.col("text").alias("question"),
        tag.alias("trap"),
        F.when(tag != "bad", F.concat(F.lit("SELECT "), text_of("item_id"))).alias("answer_sql"),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def eval_results(t: Warehouse) -> DataFrame:
    """Graded answers of three runs over the suite; a few carry a different spelling of the question."""
    run = F.col("run_no")
    grade = pick(["BAD", "NEEDS_REVIEW"], (F.col("item_id") * 3 + run) % 5, F.lit("GOOD"))
    return (
        t("benchmark")
        .withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select(
            F.concat(F.lit("run"), run.cast("string")).alias("run_id"),
            pick(["", "before", "after", "recovery"], run, F.lit("")).alias("phase"),
            F.timestamp_seconds(F.lit(1767225600) + run * 86400).alias("ts"),
            F.when(every("item_id", 9), F.concat(F.lit("new: "), F.col("text")))
            .when(every("item_id", 2), F.concat(F.lit("  "), F.translate("text", LETTERS, LETTERS.upper())))
            .otherwise(F.col("text"))
            .alias("question"),
            grade.alias("assessment"),
            F.lit("DONE").alias("run_status"),
        )
    )


def session_manifest(t: Warehouse) -> DataFrame:
    """Scripted session turns: question, expected entity, generated SQL and the correction on file."""
    form = (F.col("conv_id") + F.col("turn")) % 6
    expect = pick(["gross_revenue", "net_revenue", "monetary", None, "aov"], form, F.lit("recency_days"))
    wrong = every("conv_id", 3)
    return t("conversations").select(
        F.concat(F.lit("sess-"), text_of("conv_id")).alias("session_id"),
        F.col("turn").cast("int").alias("turn"),
        F.concat(F.lit("persona"), (F.col("conv_id") % 6).cast("string")).alias("persona"),
        pick(DOMAIN_ROLES, F.col("conv_id") % 5, F.lit("unknown")).alias("role"),
        F.col("text").alias("question"),
        pick(["jargon", "clean", "collision", "vague", "jargon"], form, F.lit("unanswerable")).alias("kind"),
        expect.alias("expect"),
        F.when(wrong, "SELECT 1").otherwise(F.concat(F.lit("SELECT SUM("), F.upper(expect), F.lit(") FROM t"))).alias("sql"),
        pick(
            [
                "GMV means gross_revenue in gold_daily_revenue",
                "",
                "whales refers to gold_customer_rfm.monetary",
                "",
                "AOV means revenue_metrics.aov",
            ],
            form,
            F.lit("churn risk is in gold_customer_rfm.recency_days"),
        ).alias("filed_text"),
        F.concat_ws("-", text_of("conv_id"), text_of("turn")).alias("message_id"),
        (F.lit(1767225600) + F.col("conv_id") * 60).cast("double").alias("ts"),
    )


def part_proposals(t: Warehouse) -> DataFrame:
    """Scored proposals, one per part, with every shape of entity name and every status."""
    column = F.concat(F.lit("c"), text_of("p_size"))
    entity = F.concat(
        pick(["", "fact_sales.", "gold.`fact_sales`.", "main.gold.fact_sales."], F.col("p_size") % 4, F.lit("")), column
    )
    return t("part").select(
        F.concat_ws(" ", F.col("p_name"), text_of("p_partkey")).alias("term"),
        entity.alias("entity"),
        F.round((F.col("p_partkey") % 100).cast("double") / 100, 2).alias("confidence"),
        (F.col("p_size") % 5).alias("distinct_users"),
        (F.col("p_size") % 9 + 1).cast("bigint").alias("evidence_count"),
        pick(["proposed", "approved", "applied", "rejected"], F.col("p_partkey") % 5, F.lit("proposed")).alias("status"),
    )


def held_synonyms(t: Warehouse) -> DataFrame:
    """Synonyms a view already has: the brands of each part type."""
    return (
        t("part")
        .groupBy(F.lit("revenue_metrics").alias("view"), F.col("p_type").alias("name"), F.col("p_brand").alias("synonym"))
        .agg(F.min("p_partkey").alias("position"))
    )


def learned_synonyms(t: Warehouse) -> DataFrame:
    """Learned synonyms, some of them another spelling of one the view has."""
    return t("part").select(
        F.lit("revenue_metrics").alias("view"),
        F.col("p_type").alias("name"),
        F.when(F.col("p_size") % 3 == 0, F.upper("p_brand")).when(F.col("p_size") % 3 == 1, F.upper("p_name"))
        .otherwise(F.col("p_name")).alias("synonym"),
        F.col("p_partkey").alias("position"),
    )


def question_marks(t: Warehouse) -> DataFrame:
    """Telemetry questions with a probability, three metric probabilities and a stratum."""
    n = ((F.col("ts") - 1767225600) / 60).cast("bigint")
    q = telemetry(t).withColumn("n", n)
    part = lambda k: (F.col("n") * k % 50 + 1).cast("double") / 100
    metrics = F.array(
        *[F.struct(F.lit(m).alias("name"), part(k).alias("p")) for m, k in (("net_revenue", 3), ("aov", 7), ("monetary", 11))]
    )
    return q.select(
        "message_id",
        F.col("content").alias("question"),
        ((F.col("n") * 7 % 101).cast("double") / 100).alias("p_answerable"),
        metrics.alias("metrics"),
        pick(["clean", "jargon", "collision"], F.col("n") % 4, F.lit("noise")).alias("stratum"),
        (F.col("n") % 4 != 3).alias("answerable"),
        F.when(F.col("n") % 4 != 3, "answerable").otherwise("noise").alias("label"),
    )
