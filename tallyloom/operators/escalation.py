"""The human review queue: building, enqueueing, ruling, applying, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.operators.drift import conflict_texts, gate, resolved
from tallyloom.sources.tables import guarded_transition, one_per_key

COLUMNS = [
    "proposal_key", "kind", "term", "entity", "confidence", "distinct_users", "evidence", "suggested_action",
]


def key_of(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), "term")


def build(
    proposals: DataFrame, conflicted: DataFrame, novel: DataFrame, corrections: DataFrame,
    confidence: float = fv.AUTO_APPROVE_CONFIDENCE,
) -> DataFrame:
    """Three lanes: proposals the gate did not pass (a conflicted term never passes), conflicted terms
    and novel terms. Evidence is JSON with the counts; the single reports stay in the evidence table
    under the same term and entity."""
    flagged = proposals.join(conflicted.select("term", F.lit(True).alias("_c")).distinct(), "term", "left")
    below = flagged.where(F.col("_c").isNotNull() | ~gate(confidence)).select(
        key_of(fv.KIND_BELOW_GATE).alias("proposal_key"),
        F.lit(fv.KIND_BELOW_GATE).alias("kind"),
        "term",
        "entity",
        "confidence",
        "distinct_users",
        F.to_json(F.struct(F.col("evidence_count").alias("corrections"))).alias("evidence"),
        F.concat(
            F.lit("confirm or dismiss '"), "term", F.lit("' -> '"), "entity", F.lit("' (confidence "),
            F.format_number("confidence", 2), F.lit(", users "), F.col("distinct_users").cast("string"), F.lit(")"),
        ).alias("suggested_action"),
    )
    users = corrections.groupBy("term").agg(F.countDistinct("user").alias("distinct_users"))
    poison = conflict_texts(conflicted).join(users, "term", "left").select(
        key_of(fv.KIND_POISON).alias("proposal_key"),
        F.lit(fv.KIND_POISON).alias("kind"),
        "term",
        F.lit(None).cast("string").alias("entity"),
        F.lit(0.0).alias("confidence"),
        F.coalesce("distinct_users", F.lit(0)).alias("distinct_users"),
        F.to_json(F.struct("entities", "top_entities")).alias("evidence"),
        F.concat(
            F.lit("write an ask-first rule for '"), "term", F.lit("': "), F.array_join("top_entities", ", ")
        ).alias("suggested_action"),
    )
    fresh = novel.select(
        key_of(fv.KIND_NOVEL).alias("proposal_key"),
        F.lit(fv.KIND_NOVEL).alias("kind"),
        "term",
        F.lit(None).cast("string").alias("entity"),
        F.lit(0.0).alias("confidence"),
        "distinct_users",
        F.to_json(F.struct("occurrences", *[c for c in ("example_questions",) if c in novel.columns])).alias("evidence"),
        F.concat(
            F.lit("define, map or dismiss '"), "term", F.lit("': seen "), F.col("occurrences").cast("string"),
            F.lit(" times by "), F.col("distinct_users").cast("string"), F.lit(" users"),
        ).alias("suggested_action"),
    )
    return below.unionByName(poison).unionByName(fresh).select(*COLUMNS)


def batch_order() -> list[Column]:
    return [F.desc("confidence"), F.asc_nulls_last("entity")]


def enqueue(queue: DataFrame, batch: DataFrame, only_pending: bool = False) -> DataFrame:
    """New queue rows: one per key, strongest first, leaving out keys the queue has in any state (or
    only keys that are pending). Running it again on its own result adds nothing."""
    seen = queue.where(F.col("status") == "pending") if only_pending else queue
    return (
        one_per_key(batch, ["proposal_key"], batch_order())
        .join(seen.select("proposal_key"), "proposal_key", "left_anti")
        .withColumn("status", F.lit("pending"))
    )


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status") == "pending").orderBy(F.desc("confidence"), "id")


def allowed_rulings(rulings: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """Rulings by principals who hold the role now, with a valid word, one per queue row."""
    active = grants.where((F.col("role") == role) & F.col("revoked_at").isNull())
    valid = rulings.where(F.col("ruling").isin("approve", "reject")).join(active, "principal", "left_semi")
    return one_per_key(valid, ["id"], [F.col("principal"), F.col("ruling")])


def decide(queue: DataFrame, rulings: DataFrame, decided_at) -> DataFrame:
    """Pending rows with a ruling become approved or rejected, stamped with who and when."""
    moves = rulings.select(
        "id",
        F.when(F.col("ruling") == "approve", "approved").otherwise("rejected").alias("status"),
        F.lit(decided_at).cast("timestamp").alias("decided_at"),
        F.concat(F.lit("human:"), "principal").alias("decided_by"),
    )
    return guarded_transition(queue, moves, ["id"], "pending")


def applications(queue: DataFrame, schema: str, kinds: list[str] | None = None) -> DataFrame:
    """Approved rows with the payload of their kind. Kinds without a rule are left out."""
    kinds = kinds or [fv.KIND_BELOW_GATE, fv.KIND_POISON, fv.KIND_NOVEL]
    rows = resolved(queue.where((F.col("status") == "approved") & F.col("kind").isin(kinds)), schema)
    mapped = F.concat(F.lit("mapped '"), "term", F.lit("' to "), F.concat_ws(".", "fq_table", "column_name"))
    refine = F.concat(F.lit("no target column in '"), F.coalesce("entity", F.lit("")), F.lit("'"))
    ruled = F.concat(F.lit("ruling recorded for '"), "term", F.lit("' ("), "kind", F.lit(")"))
    payload = (
        F.when(F.col("kind") != fv.KIND_BELOW_GATE, ruled).when(F.col("column_name").isNull(), refine).otherwise(mapped)
    )
    return rows.select("id", "proposal_key", "kind", "term", "entity", "decided_by", payload.alias("payload"))


def mark_applied(queue: DataFrame, applied: DataFrame) -> DataFrame:
    moves = applied.select("id", F.lit("applied").alias("status"))
    return guarded_transition(queue, moves, ["id"], "approved")


def application_ledger(applied: DataFrame, at) -> DataFrame:
    return applied.select(
        F.lit(at).cast("timestamp").alias("ts"),
        F.col("kind").alias("action"),
        F.coalesce("entity", "term").alias("target"),
        "proposal_key",
        "payload",
        F.lit("applied").alias("status"),
        F.coalesce("decided_by", F.lit("reviewer")).alias("approver"),
    )


def stats(queue: DataFrame, now) -> DataFrame:
    return (
        queue.groupBy("status", "kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("confidence"), 2).alias(
                "avg_confidence"
            ),
            F.min("created_at").alias("oldest"),
            F.max(F.datediff(F.lit(now).cast("timestamp"), "created_at")).alias("max_age_days"),
        )
        .orderBy("status", F.desc("n"), "kind")
    )


def novel_by_occurrences(queue: DataFrame, now) -> DataFrame:
    return (
        queue.where((F.col("status") == "pending") & (F.col("kind") == fv.KIND_NOVEL))
        .select(
            "id",
            "term",
            F.get_json_object("evidence", "$.occurrences").try_cast("int").alias("occurrences"),
            "distinct_users",
            F.datediff(F.lit(now).cast("timestamp"), "created_at").alias("age_days"),
        )
        .orderBy(F.desc("occurrences"), "id")
    )


DOCKET = {
    fv.KIND_POISON: (0, "approve = always ask first; reject = leave as is"),
    fv.KIND_BELOW_GATE: (1, "approve or reject this mapping"),
    fv.KIND_NOVEL: (2, "approve = define it next; reject = noise"),
}


def docket(queue: DataFrame) -> DataFrame:
    """Pending rows with the decision asked for: ambiguous terms first, then proposals, then new words."""
    rank, text = F.lit(2), F.lit("review")
    for kind, (place, wording) in DOCKET.items():
        rank = F.when(F.col("kind") == kind, place).otherwise(rank)
        text = F.when(F.col("kind") == kind, wording).otherwise(text)
    return (
        queue.where(F.col("status") == "pending")
        .select(
            "id", "kind", "term", "entity", F.round("confidence", 2).alias("confidence"), "distinct_users",
            text.alias("decision"), "evidence", rank.alias("place"),
        )
        .orderBy("place", F.desc("confidence"), "id")
    )


def grant_roles(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Add grants that are not active yet; an active grant of the same role is left alone."""
    fresh = one_per_key(new, ["principal", "role"], [F.col("granted_at")])
    active = grants.where(F.col("revoked_at").isNull()).select("principal", "role")
    added = fresh.join(active, ["principal", "role"], "left_anti")
    return grants.unionByName(added, allowMissingColumns=True)


def revoke_roles(grants: DataFrame, revoked: DataFrame, at) -> DataFrame:
    """Soft revoke: the grant keeps its row and gets an end."""
    hit = revoked.select("principal", "role", F.lit(True).alias("_hit")).distinct()
    ended = F.when(F.col("_hit") & F.col("revoked_at").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("revoked_at"))
    return grants.join(hit, ["principal", "role"], "left").withColumn("revoked_at", ended).drop("_hit").select(*grants.columns)


def verification(queue: DataFrame) -> DataFrame:
    """Counts by status and by decider in one pass: each row counts under its status and, when it was
    decided, under its decider."""
    names = F.array_compact(F.array("status", F.concat(F.lit("decided by "), "decided_by")))
    return queue.select(F.explode(names).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
