"""Term-to-entity proposals: scoring, conflicts, triage, healing plan, glossary, instruction versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.ranking import global_rank
from tallyloom.functions.text import mapped


def role_weights(retail: bool = True) -> dict[str, float]:
    return {**fv.ROLE_WEIGHTS, **(fv.RETAIL_ROLE_WEIGHTS if retail else {})}


def score(
    corrections: DataFrame,
    now: float,
    weights: dict[str, float] | None = None,
    min_users: int = fv.MIN_DISTINCT_USERS,
) -> DataFrame:
    """Confidence per (term, entity): role weight halved every week of age, summed and squashed into
    (0, 1), then halved when fewer than ``min_users`` users say it. A zero time counts as fresh.

    The sums combine before the shuffle, so a proposal with a third of all reports is no hot spot.
    """
    weights = weights or role_weights()
    weight = mapped("role", weights, weights["unknown"])
    age = F.when(F.col("ts") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(now) - F.col("ts")))
    strength = weight * F.pow(F.lit(0.5), age / fv.FRESHNESS_HALF_LIFE_S)
    few = F.col("distinct_users") < min_users
    squashed = 1 - F.exp(-F.col("raw") / 2)
    return (
        corrections.groupBy("term", "entity")
        .agg(
            F.sum(strength).alias("raw"),
            F.countDistinct("user").alias("distinct_users"),
            F.count(F.lit(1)).alias("evidence_count"),
        )
        .select(
            "term",
            "entity",
            F.round(F.when(few, squashed * 0.5).otherwise(squashed), 4).alias("confidence"),
            "distinct_users",
            "evidence_count",
        )
    )


def evidence(corrections: DataFrame) -> DataFrame:
    """Every report of every proposal, newest first. One row per report under a global order instead
    of a list per proposal: a list of a popular proposal would not fit one row at scale."""
    return corrections.select("term", "entity", "user", "role", "ts", "source_message_id").orderBy(
        "term", "entity", F.desc("ts"), "source_message_id"
    )


def conflicts(corrections: DataFrame) -> DataFrame:
    """Rows (term, entity, reports, entities) of terms that stand for more than one entity.

    An entity is any word that a user typed, so they are rows and not a list; the term's number of entities is counted
    apart and joined back."""
    pairs = corrections.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("reports"))
    several = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") > 1)
    return pairs.join(several, "term").select("term", "entity", "reports", "entities")


def conflict_texts(conflicted: DataFrame, shown: int = fv.CONFLICT_ENTITIES) -> DataFrame:
    """One row per conflicted term: its number of entities and, for reading, the ``shown`` most reported of them."""
    turn = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("reports"), "entity"))
    return (
        conflicted.withColumn("_turn", turn).where(F.col("_turn") <= shown)
        .groupBy("term", "entities").agg(F.array_sort(F.collect_list(F.struct("_turn", "entity"))).alias("_list"))
        .select("term", "entities", F.col("_list.entity").alias("top_entities"))
    )


def without_conflicts(proposals: DataFrame, conflicted: DataFrame) -> DataFrame:
    return proposals.join(conflicted.select("term").distinct(), "term", "left_anti")


def gate(confidence: float = fv.AUTO_APPROVE_CONFIDENCE) -> Column:
    return (F.col("confidence") >= confidence) & (F.col("distinct_users") >= fv.MIN_DISTINCT_USERS)


def triage(proposals: DataFrame, confidence: float = fv.AUTO_APPROVE_CONFIDENCE) -> DataFrame:
    return proposals.withColumn("lane", F.when(gate(confidence), "auto").otherwise("review"))


def resolved(proposals: DataFrame, schema: str) -> DataFrame:
    """Add ``fq_table`` and ``column_name`` for entities of two to four dotted parts; a bare name
    stays unresolved (both NULL)."""
    catalog = schema.split(".")[0]
    parts = F.filter(
        F.transform(F.split("entity", r"\."), lambda p: F.btrim(p, F.lit("`"))), lambda p: p != ""
    )
    n = F.size("_parts")
    path = F.slice("_parts", 1, n - 1)
    table = (
        F.when(n == 2, F.concat(F.lit(f"{schema}."), F.element_at("_parts", 1)))
        .when(n == 3, F.concat(F.lit(f"{catalog}."), F.array_join(path, ".")))
        .when(n > 3, F.array_join(F.slice(path, -3, 3), "."))
    )
    return (
        proposals.withColumn("_parts", parts)
        .withColumn("fq_table", table)
        .withColumn("column_name", F.when(n >= 2, F.element_at("_parts", -1)))
        .drop("_parts")
    )


def targets(proposals: DataFrame) -> DataFrame:
    """Where a proposal lands: ``home_table``/``home_column`` for a column, ``view``/``measure`` for a
    metric-view synonym. The lookups are small fixed maps, so they are literals in the plan."""
    entity = F.btrim("entity", F.lit("`"))
    dotted = entity.contains(".")
    last = F.regexp_extract(entity, r"([^.]*)$", 1)
    owner = F.regexp_extract(entity, r"([^.]*)\.[^.]*$", 1)
    in_view = dotted & owner.isin(fv.METRIC_VIEW_NAMES)
    views = {k: v for k, (v, _) in fv.MEASURE_TARGET.items()}
    measures = {k: v for k, (_, v) in fv.MEASURE_TARGET.items()}
    return proposals.withColumns(
        {
            "home_table": F.when(~dotted, mapped(entity, fv.COLUMN_HOME)).when(~in_view, owner),
            "home_column": F.when(~dotted, entity).when(~in_view, last),
            "view": F.when(in_view, owner).when(~dotted, mapped(entity, views)),
            "measure": F.when(in_view, last).when(~dotted, mapped(entity, measures)),
        }
    )


def proposal_key(term: str = "term", entity: str = "entity") -> Column:
    return F.concat(F.lower(term), F.lit("→"), F.lower(entity))


def healing_plan(
    proposals: DataFrame, schema: str, dry_run: bool, label_chars: int = fv.PAYLOAD_CHARS, tag_chars: int = fv.TAG_CHARS
) -> DataFrame:
    """One ledger row per approved, resolvable proposal and surface. The statements are rendered as
    data with quotes escaped; nothing is executed here. ``payload`` is whole; ``payload_label`` is its short form for
    lists, with a tag of ``tag_chars`` and ``label_chars`` characters in all at most."""
    quoted = F.replace("term", F.lit("'"), F.lit("''"))
    bare = F.replace("term", F.lit("'"), F.lit(""))
    column = F.concat_ws(".", "fq_table", "column_name")
    note = F.concat(F.lit("COMMENT ON COLUMN "), column, F.lit(" IS 'Learned synonym: ''"), quoted, F.lit("''.'"))

    def tag(value: Column) -> Column:
        return F.concat(
            F.lit("ALTER TABLE "), F.col("fq_table"), F.lit(" ALTER COLUMN "), F.col("column_name"),
            F.lit(" SET TAGS ('learned_synonym' = '"), value, F.lit("')"),
        )

    actions = F.array(
        F.struct(F.lit("uc_comment").alias("action"), note.alias("payload"), note.alias("label")),
        F.struct(F.lit("uc_tag").alias("action"), tag(bare).alias("payload"), tag(F.substring(bare, 1, tag_chars)).alias("label")),
        F.struct(F.lit("space_update").alias("action"), F.col("term").alias("payload"), F.col("term").alias("label")),
    )
    ready = resolved(proposals, schema).where(gate() & F.col("column_name").isNotNull())
    return ready.select(
        column.alias("target"), proposal_key().alias("proposal_key"), F.explode(actions).alias("a")
    ).select(
        "a.action",
        "target",
        "proposal_key",
        "a.payload",
        F.substring("a.label", 1, label_chars).alias("payload_label"),
        F.lit("approved" if dry_run else "applied").alias("status"),
        F.lit("auto").alias("approver"),
    )


def held_report(proposals: DataFrame, schema: str, confidence: float = fv.AUTO_APPROVE_CONFIDENCE) -> DataFrame:
    """Proposals that wait for a person, with the reason."""
    reason = F.when(~gate(confidence), "below gate").when(F.col("column_name").isNull(), "entity not table.column-shaped")
    return (
        resolved(proposals, schema)
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("term", "entity", "confidence", "distinct_users", "reason")
    )


def pending(proposals: DataFrame) -> DataFrame:
    return proposals.where(F.col("status").isin("proposed", "approved"))


def glossary(safe: DataFrame, conflicted: DataFrame) -> DataFrame:
    """Glossary rows: a mapping line per safe proposal, an ask-first line per conflicted term, which names its most
    reported entities."""
    mapping = safe.select(
        F.lit("mapping").alias("line_kind"),
        "term",
        F.concat(F.lit("Term '"), "term", F.lit("' means "), "entity", F.lit(".")).alias("text"),
    )
    ask = conflict_texts(conflicted).select(
        F.lit("ask_first").alias("line_kind"),
        "term",
        F.concat(
            F.lit("Term '"), "term", F.lit("' is ambiguous: "), F.array_join("top_entities", ", "),
            F.lit(". Ask which one is meant before answering."),
        ).alias("text"),
    )
    return mapping.unionByName(ask)


def next_instructions(current: DataFrame, lines: DataFrame) -> DataFrame:
    """The next version of the instruction text: the latest version's lines, then the new ones in
    text order. ``current`` has ``(version, line_no, text)``."""
    newest = current.agg(F.max("version")).scalar()
    count = current.where(F.col("version") == newest).agg(F.max("line_no")).scalar()
    version = (F.coalesce(newest, F.lit(0)) + 1).alias("version")
    kept = current.where(F.col("version") == newest).select(version, "line_no", "text")
    numbered = global_rank(lines.select("text"), [F.col("text")], "lines")
    added = numbered.select(version, (F.coalesce(count, F.lit(0)) + F.col("_rank")).alias("line_no"), "text")
    return kept.unionByName(added)


def restored_instructions(current: DataFrame, version: int) -> DataFrame:
    """An old version published again under the next number."""
    newest = current.agg(F.max("version")).scalar()
    return current.where(F.col("version") == version).select((newest + 1).alias("version"), "line_no", "text")
