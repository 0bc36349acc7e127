"""The daily report as a job over stored tables: every source is probed while the plan is built, and a table or column that
is not there gives NULL rows with a note instead of a failed run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import report
from tallyloom.operators.report import ReportWindow
from tallyloom.sources.tables import SnapshotTable, upsert

KPIS = "report_date DATE, kpi STRING, value DOUBLE, detail STRING"


@dataclass(frozen=True)
class Source:
    """KPIs of one stored table. ``columns`` lists ways to compute them; one whole group of columns must be there."""

    table: str
    kpis: tuple[str, ...]
    columns: tuple[tuple[str, ...], ...]
    build: Callable[[DataFrame, ReportWindow], DataFrame]


SOURCES = (
    Source("ledger", ("definitions_evolved", "definitions_evolved_7d", "new_terms_learned"), (("ts", "action", "proposal_key"),), report.ledger_kpis),
    Source("ledger", ("healing_activity_total",), (("ts", "approver"),), report.approver_kpis),
    Source("queue", ("escalations_opened", "escalations_decided", "pending_age_max_days"), (("created_at", "decided_at", "status"),), report.queue_kpis),
    Source("scores", ("eval_accuracy_latest",), (("accuracy", "ts"), ("accuracy", "recorded_at"), ("correct", "total", "recorded_at")), lambda df, _: report.accuracy_kpis(df)),
    Source("messages", ("corpus_size", "corpus_growth_24h"), ((),), report.corpus_kpis),
    Source("router", ("noise_deflected", "router_pass_rate"), (("answerable", "arm_b_sent"),), lambda df, _: report.router_kpis(df)),
    Source("quarantine", ("quarantine_rows_24h",), ((),), report.quarantine_kpis),
)


@dataclass
class DailyReport:
    """``names`` gives each source's catalog table. The report lies under ``root`` with one row per day and KPI: a day that
    is run again takes the new values, other days stay."""

    spark: SparkSession
    root: str
    names: dict[str, str]
    sources: tuple[Source, ...] = SOURCES

    def __post_init__(self) -> None:
        self.table = SnapshotTable(self.spark, f"{self.root}/kpis", KPIS)

    def _absent(self, one: Source) -> str | None:
        """Why the KPIs of a source can't be computed. Looks at the catalog and the schema and reads no data."""
        name = self.names.get(one.table)
        if name is None or not self.spark.catalog.tableExists(name):
            return f"no table for {one.table}"
        have = set(self.spark.table(name).columns)
        if any(set(group) <= have for group in one.columns):
            return None
        return f"{one.table} lacks " + ", ".join(c for c in one.columns[0] if c not in have)

    def rows(self, window: ReportWindow) -> DataFrame:
        """(report_date, kpi, value, detail) of one day, not stored."""
        parts, gone = [], []
        for one in self.sources:
            why = self._absent(one)
            if why:
                gone += [(kpi, None, why) for kpi in one.kpis]
            else:
                parts.append(one.build(self.spark.table(self.names[one.table]), window))
        if gone or not parts:
            parts.append(self.spark.createDataFrame(gone, "kpi STRING, value DOUBLE, detail STRING"))
        return report.assembled(parts, window.day)

    def run(self, window: ReportWindow) -> DataFrame:
        """Store the day's rows and give back those of them that have no value."""
        today = self.rows(window)
        self.table.change(lambda old: upsert(old, today, ["report_date", "kpi"], ["value", "detail"]))
        return report.null_kpis(self.table.read().where(F.col("report_date") == F.lit(window.day)))

    def read(self) -> DataFrame:
        return self.table.read()
