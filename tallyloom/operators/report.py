"""The daily report: one row per KPI, ``(report_date, kpi, value, detail)``.

Every source table is read once: its KPIs are columns of one aggregate row, which is then turned into
rows. The few KPIs that have a row per approver or stratum come from one more small aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv


@dataclass(frozen=True)
class ReportWindow:
    """The 24 hours that end at the day's end, or now if the day is still running."""

    day: date
    now: datetime

    @property
    def end(self) -> float:
        day_end = datetime.combine(self.day, time(), timezone.utc) + timedelta(days=1)
        return min(self.now.replace(tzinfo=timezone.utc), day_end).timestamp()

    @property
    def start(self) -> float:
        return self.end - 24 * 3600

    @property
    def week_start(self) -> float:
        return self.end - 7 * 24 * 3600


def inside(c: str, start: float, end: float) -> Column:
    """Half-open window on epoch seconds; works for TIMESTAMP and for DOUBLE seconds."""
    seconds = F.col(c).cast("double")
    return (seconds >= start) & (seconds < end)


def rows_of(df: DataFrame, kpis: dict[str, tuple[Column, str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(k).alias("kpi"), v.cast("double").alias("value"), F.lit(d).alias("detail"))
        for k, (v, d) in kpis.items()
    ]
    return df.agg(F.array(*cells).alias("_r")).select(F.inline("_r"))


def missing(df: DataFrame, names: list[str], why: str) -> DataFrame:
    """NULL rows for KPIs whose source is absent."""
    cells = [(n, None, why) for n in names]
    return df.sparkSession.createDataFrame(cells, "kpi STRING, value DOUBLE, detail STRING")


def ledger_kpis(ledger: DataFrame, w: ReportWindow) -> DataFrame:
    today, week = inside("ts", w.start, w.end), inside("ts", w.week_start, w.end)
    evolved = F.col("action").isin(fv.DEFINITION_ACTIONS)
    learned = F.when(F.col("action").like("space%") & today, F.col("proposal_key"))
    return rows_of(
        ledger,
        {
            "definitions_evolved": (F.count_if(evolved & today), "definition actions in the window"),
            "definitions_evolved_7d": (F.count_if(evolved & week), "definition actions in seven days"),
            "new_terms_learned": (F.countDistinct(learned), "distinct keys of space actions"),
        },
    )


def approver_kpis(ledger: DataFrame, w: ReportWindow) -> DataFrame:
    """Ledger rows in the window per approver; a window without rows gives one zero row."""
    today = ledger.where(inside("ts", w.start, w.end))
    name = F.concat(F.lit("healing_activity_"), F.coalesce("approver", F.lit("unknown")))
    per = today.groupBy(name.alias("kpi")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    none = today.agg(F.count(F.lit(1)).cast("double").alias("value")).where(F.col("value") == 0)
    return per.unionByName(none.select(F.lit("healing_activity_total").alias("kpi"), "value")).withColumn(
        "detail", F.lit("ledger actions in the window")
    )


def queue_kpis(queue: DataFrame, w: ReportWindow) -> DataFrame:
    age = (F.lit(w.end) - F.col("created_at").cast("double")) / 86400
    return rows_of(
        queue,
        {
            "escalations_opened": (F.count_if(inside("created_at", w.start, w.end)), "opened in the window"),
            "escalations_decided": (F.count_if(inside("decided_at", w.start, w.end)), "decided in the window"),
            "pending_age_max_days": (
                F.round(F.max(F.when(F.col("status") == "pending", age)), 6), "oldest pending item",
            ),
        },
    )


def accuracy_kpis(history: DataFrame) -> DataFrame:
    """Latest accuracy per stratum with the change to the run before. Accepts rows per run (accuracy,
    ts) and per stratum (correct, total, recorded_at)."""
    have = history.columns
    when = "recorded_at" if "recorded_at" in have else "ts"
    accuracy = F.col("accuracy") if "accuracy" in have else F.try_divide(F.col("correct").cast("double"), F.col("total"))
    stratum = F.col("stratum") if "stratum" in have else F.lit("overall")
    run = F.col("run_id") if "run_id" in have else F.lit("unknown")
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("_when"), F.desc("run_id")))
    last_two = (
        history.select(stratum.alias("stratum"), accuracy.alias("accuracy"), run.alias("run_id"), F.col(when).alias("_when"))
        .withColumn("_turn", turn)
        .where(F.col("_turn") <= 2)
    )
    pick = lambda n, c: F.max(F.when(F.col("_turn") == n, F.col(c)))
    both = last_two.groupBy("stratum").agg(
        pick(1, "accuracy").alias("latest"), pick(2, "accuracy").alias("previous"), pick(1, "run_id").alias("run_id")
    )
    change = F.when(F.col("previous").isNull(), "no previous run").otherwise(
        F.concat(F.lit("change "), F.round(F.col("latest") - F.col("previous"), 3).cast("string"))
    )
    return both.select(
        F.concat(F.lit("eval_accuracy_latest_"), "stratum").alias("kpi"),
        F.col("latest").alias("value"),
        F.concat(F.lit("run "), "run_id", F.lit("; "), change).alias("detail"),
    )


def corpus_kpis(messages: DataFrame, w: ReportWindow) -> DataFrame:
    fresh = F.count_if(inside("harvested_at", w.start, w.end)) if "harvested_at" in messages.columns else F.lit(None)
    return rows_of(
        messages,
        {
            "corpus_size": (F.count(F.lit(1)), "telemetry rows"),
            "corpus_growth_24h": (fresh, "rows harvested in the window"),
        },
    )


def router_kpis(results: DataFrame) -> DataFrame:
    ok, sent = F.col("answerable"), F.col("arm_b_sent")
    return rows_of(
        results,
        {
            "noise_deflected": (F.count_if(~ok & ~sent), "unanswerable questions held back"),
            "router_pass_rate": (F.round(F.avg(F.when(ok, sent.cast("double"))), 6), "answerable questions let through"),
        },
    )


def quarantine_kpis(rows: DataFrame, w: ReportWindow) -> DataFrame:
    timed = "_ingested_at" in rows.columns
    value = F.count_if(inside("_ingested_at", w.start, w.end)) if timed else F.count(F.lit(1))
    return rows_of(rows, {"quarantine_rows_24h": (value, "in the window" if timed else "all rows")})


def assembled(parts: list[DataFrame], day: date) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(day).alias("report_date"), "kpi", "value", "detail")


def null_kpis(report: DataFrame) -> DataFrame:
    return report.where(F.col("value").isNull()).select("report_date", "kpi", "detail")
