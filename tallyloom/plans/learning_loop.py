"""The learning loop as table-in, table-out steps: harvest, detect, heal, escalate, apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import drift, escalation, evals, novelty, telemetry
from tallyloom.sources.tables import AppendLog, SnapshotTable, change_log, insert_only, row_id, undo, update_only, upsert

CORRECTIONS = "term STRING, entity STRING, `user` STRING, role STRING, ts DOUBLE, source_message_id STRING"
PROPOSALS = (
    "term STRING, entity STRING, confidence DOUBLE, distinct_users BIGINT, evidence_count BIGINT, status STRING"
)
QUEUE = (
    "id BIGINT, proposal_key STRING, kind STRING, term STRING, entity STRING, confidence DOUBLE, distinct_users BIGINT, "
    "evidence STRING, suggested_action STRING, status STRING, created_at TIMESTAMP, decided_at TIMESTAMP, decided_by STRING"
)
SCORES = ["confidence", "distinct_users", "evidence_count"]


@dataclass
class LearningLoop:
    """State lives in tables under ``root``; running a step twice on the same input changes nothing."""

    spark: SparkSession
    root: str
    schema: str = "main.gold"

    def __post_init__(self) -> None:
        self.corrections = SnapshotTable(self.spark, f"{self.root}/corrections", CORRECTIONS)
        self.proposals = SnapshotTable(self.spark, f"{self.root}/proposals", PROPOSALS)
        self.queue = SnapshotTable(self.spark, f"{self.root}/queue", QUEUE)
        self.ledger = AppendLog(self.spark, f"{self.root}/ledger")

    def _record(self, rows: DataFrame) -> None:
        """Ledger rows are told apart by what was done to what, so a step that is run again adds none."""
        done = rows.withColumn("ledger_id", row_id("action", "target", "proposal_key", "payload", "status", "approver"))
        self.ledger.append_unseen(done, "ledger_id")

    def harvest(self, messages: DataFrame) -> DataFrame:
        batch = telemetry.mergeable(telemetry.corrections(messages))
        order = [F.col("ts"), F.col("term"), F.col("entity")]
        return self.corrections.change(lambda old: insert_only(old, batch, ["source_message_id"], order))

    def detect(self, now: float) -> DataFrame:
        scored = drift.score(self.corrections.read(), now)
        return self.proposals.change(lambda old: upsert(old, scored, ["term", "entity"], SCORES, {"status": "proposed"}))

    def heal(self, at: str, dry_run: bool = False) -> DataFrame:
        """Apply what passes the gate; conflicted terms never do. The plan rows go to the ledger first."""
        conflicted = drift.conflicts(self.corrections.read())
        safe = drift.without_conflicts(drift.pending(self.proposals.read()), conflicted)
        plan = drift.healing_plan(safe, self.schema, dry_run)
        self._record(plan.withColumn("ts", F.lit(at).cast("timestamp")))
        done = drift.resolved(safe, self.schema).where(drift.gate() & F.col("column_name").isNotNull())
        moves = done.select("term", "entity", F.lit("approved" if dry_run else "applied").alias("status"))
        return self.proposals.change(lambda old: update_only(old, moves, ["term", "entity"]))

    def evaluate(self, scores: DataFrame, baseline: str, changed: str, before: int, at: str, after: int | None = None) -> str:
        """Compare two benchmark runs; where the gate trips, what happened to the proposals between the versions
        ``before`` and ``after`` (the latest unless named) is undone, and what has been learned since stays.

        The intent goes to the ledger first and the verdict last. Undoing is the inverse of the logged change, so a run
        that died in between can be run again; one that has its verdict changes nothing.
        """
        verdict = evals.lift(scores, baseline, changed).first()["verdict"]
        undone, key = verdict == "ROLLBACK", f"{baseline}>{changed}"
        after = (self.proposals.versions() or [0])[-1] if after is None else after

        def note(action: str, status: str) -> None:
            entry = [(action, "proposals", key, f"versions {before} to {after}", status, "auto")]
            row = self.spark.createDataFrame(entry, "action STRING, target STRING, proposal_key STRING, payload STRING, status STRING, approver STRING")
            self._record(row.withColumn("ts", F.lit(at).cast("timestamp")))

        if self.ledger.exists() and not self.ledger.read().where((F.col("proposal_key") == key) & (F.col("action") == "evaluation_gate")).isEmpty():
            return verdict
        if undone:
            note("evaluation_intent", "rolling_back")
            log = change_log(self.proposals.read(before), self.proposals.read(after), ["term", "entity"])
            self.proposals.change(lambda now: undo(now, log, ["term", "entity"]))
        note("evaluation_gate", "rolled_back" if undone else "kept")
        return verdict

    def escalate(self, messages: DataFrame, now: float, at: str) -> DataFrame:
        mined = self.corrections.read()
        failed = novelty.failed_questions(messages, "content", ["feedback_rating"])
        terms = novelty.novel_terms(failed, "content", "user_id")
        examples = novelty.example_questions(failed, "content", ["ts", "message_id"])
        batch = escalation.build(
            drift.score(mined, now), drift.conflicts(mined), novelty.with_examples(terms, examples), mined
        )

        def add(old: DataFrame) -> DataFrame:
            fresh = escalation.enqueue(old, batch).withColumns(
                {"id": F.xxhash64("proposal_key"), "created_at": F.lit(at).cast("timestamp")}
            )
            return old.unionByName(fresh, allowMissingColumns=True)

        return self.queue.change(add)

    def decide(self, rulings: DataFrame, grants: DataFrame, role: str, at: str) -> DataFrame:
        allowed = escalation.allowed_rulings(rulings, grants, role)
        return self.queue.change(lambda old: escalation.decide(old, allowed, at))

    def apply(self, at: str) -> DataFrame:
        applied = escalation.applications(self.queue.read(), self.schema)
        self._record(escalation.application_ledger(applied, at))
        return self.queue.change(lambda old: escalation.mark_applied(old, applied))
