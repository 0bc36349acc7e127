"""Question telemetry: flattening, role enrichment, correction mining, answer judgment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed_values as fv
from tallyloom.functions.text import clean_text, correction_pairs, is_correction, words
from tallyloom.sources.tables import one_per_key

CONVERSATION_SCHEMA = """
  conversation_id STRING, id STRING, user_id STRING,
  messages ARRAY<STRUCT<
    message_id: STRING, id: STRING, user_id: STRING, content: STRING, created_timestamp: BIGINT,
    feedback: STRING, attachments: ARRAY<STRUCT<query: STRUCT<query: STRING>, text: STRING>>>>
"""


def flatten_conversations(conversations: DataFrame) -> DataFrame:
    """One row per message. The last query attachment is the generated SQL; the rating is a plain word
    or the ``rating`` of an object; a message without a user belongs to the conversation's user."""
    conv = F.coalesce(F.nullif("conversation_id", F.lit("")), F.col("id"))
    rows = conversations.select(
        conv.alias("conversation_id"), F.col("user_id").alias("owner"), F.explode("messages").alias("m")
    ).where(F.coalesce("conversation_id", F.lit("")) != "")
    queries = F.filter(
        F.transform(F.coalesce("m.attachments", F.array()), lambda a: a["query"]["query"]),
        lambda q: F.coalesce(q, F.lit("")) != "",
    )
    feedback = F.col("m.feedback")
    in_object = F.coalesce(F.get_json_object(feedback, "$.rating"), F.lit(""))
    created = F.coalesce("m.created_timestamp", F.lit(0))
    return rows.select(
        "conversation_id",
        F.coalesce("m.message_id", "m.id", F.lit("")).alias("message_id"),
        F.coalesce(F.nullif("m.user_id", F.lit("")), "owner", F.lit("unknown")).alias("user_id"),
        clean_text("m.content").alias("content"),
        F.coalesce(F.try_element_at(queries, F.lit(-1)), F.lit("")).alias("sql"),
        F.when(feedback.startswith("{"), in_object).otherwise(clean_text(feedback)).alias("feedback_rating"),
        F.when(created != 0, F.timestamp_millis(created)).alias("created_ts"),
    )


PAGE = 200  # turns of a conversation in one exported line


def export_pages(turns: DataFrame) -> DataFrame:
    """(value): the nested export as JSON lines, of (conversation_id, turn, role, content) rows. A conversation is cut into
    pages of ``PAGE`` turns, so a line is bounded however long a conversation grows; messages are in the order of turns."""
    paged = turns.withColumn("page", F.expr(f"turn div {PAGE}"))
    message = F.struct("turn", "role", "content")
    lines = paged.groupBy("conversation_id", "page").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return lines.select(F.to_json(F.struct("conversation_id", "page", "messages")).alias("value"))


def read_export(lines: DataFrame) -> DataFrame:
    """(conversation_id, page, position, turn, role, content) of exported lines, read as VARIANT: messages may have any
    other fields, or lack these, which are NULL then. A line that is no JSON gives no rows."""
    read = lines.select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    pages = read.select(
        F.try_variant_get("v", "$.conversation_id", "string").alias("conversation_id"), F.try_variant_get("v", "$.page", "bigint").alias("page"),
        F.try_variant_get("v", "$.messages", "array<variant>").alias("messages"),
    )
    one = pages.select("conversation_id", "page", F.posexplode("messages").alias("position", "m"))
    fields = {"turn": "bigint", "role": "string", "content": "string"}
    return one.select("conversation_id", "page", "position", *[F.try_variant_get("m", f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def with_roles(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """Role per user, ``unknown`` when there is none. ``roles`` has one row per user; the adaptive
    planner broadcasts it when its measured size allows."""
    known = roles.select("user_id", F.col("role").alias("_role"))
    kept = [c for c in messages.columns if c != "role"]
    return messages.join(known, "user_id", "left").select(*kept, F.coalesce("_role", F.lit("unknown")).alias("role"))


def corrections(messages: DataFrame) -> DataFrame:
    """Rows ``(term, entity, user, role, ts, source_message_id)`` for messages that parse as one."""
    return messages.select(
        F.inline(correction_pairs("content")),
        F.col("user_id").alias("user"),
        "role",
        F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("ts"),
        F.col("message_id").alias("source_message_id"),
    )


def mergeable(mined: DataFrame) -> DataFrame:
    """Corrections that can be merged idempotently: with a message id, one per message."""
    usable = mined.where(F.coalesce("source_message_id", F.lit("")) != "")
    return one_per_key(usable, ["source_message_id"], [F.col("ts"), F.col("term"), F.col("entity")])


def judged(manifest: DataFrame) -> DataFrame:
    """Rate scripted turns: right when the expected entity occurs in the SQL. Noise is always wrong; a
    correction is filed only on a wrong answer of a correctable kind."""
    noise = F.col("kind").isin("vague", "unanswerable")
    expected = clean_text("expect")
    right = ~noise & (expected != "") & F.lower(clean_text("sql")).contains(F.lower(expected))
    filed = ~right & F.col("kind").isin("jargon", "collision")
    return manifest.withColumns(
        {
            "rated": F.when(right, "POSITIVE").otherwise("NEGATIVE"),
            "correction": F.when(filed, clean_text("filed_text")).otherwise(""),
        }
    )


def manifest_corrections(judged_rows: DataFrame) -> DataFrame:
    """Corrections filed in scripted sessions, attributed to the persona."""
    return corrections(
        judged_rows.select(
            F.col("correction").alias("content"), F.col("persona").alias("user_id"), "role", "ts", "message_id"
        )
    )


def failed_question_corrections(failures: DataFrame, run_id: str, now: float) -> DataFrame:
    """The correction an expert would file for a failed question: the first keyword of the priority
    list that the question contains. The list is fixed, so it is an expression and not a join. The message id names
    run and question, so that a merge keeps one correction for each question."""
    low = F.lower("question")
    text: Column = F.coalesce(*[F.when(low.contains(k), F.lit(t)) for k, t in fv.KEYWORD_CORRECTIONS])
    return corrections(
        failures.select(
            text.alias("content"),
            F.lit("benchmark_eval").alias("user_id"),
            F.lit("data_scientist").alias("role"),
            F.lit(now).alias("ts"),
            F.concat(F.lit(f"bench:{run_id}:"), F.sha2("question", 256)).alias("message_id"),
        )
    )


def intents(judged_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What each persona means by the term it used, confirmed on a right answer and corrected on a
    wrong one. ``catalogue`` has one row per (persona, question)."""
    prefix = F.when(F.col("rated") == "POSITIVE", "confirm:").otherwise("correct:")
    found = judged_rows.join(catalogue.select("persona", "question", "intent_text"), ["persona", "question"])
    return corrections(
        found.select(
            F.col("intent_text").alias("content"),
            F.col("persona").alias("user_id"),
            "role",
            "ts",
            F.concat(prefix, "message_id").alias("message_id"),
        )
    )


def unparsed_negatives(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Negative messages that no correction explains: the candidates for a second extraction."""
    return (
        messages.where(F.upper(clean_text("feedback_rating")) == "NEGATIVE")
        .where((clean_text("content") != "") & ~is_correction("content"))
        .join(known.select(F.col("source_message_id").alias("message_id")), "message_id", "left_anti")
        .select("message_id", "content", "user_id", "role")
    )


def extraction_corrections(replies: DataFrame, now: float) -> DataFrame:
    """Validated (term, entity) pairs out of free-text replies: the outermost braces hold JSON."""
    body = F.regexp_extract("extracted", r"(?s)\{.*\}", 0)
    pair = F.from_json(body, "term STRING, entity STRING")
    term = F.lower(F.trim(clean_text(pair["term"])))
    entity = F.lower(F.btrim(F.trim(clean_text(pair["entity"])), F.lit("`")))
    return (
        replies.select(
            term.alias("term"),
            entity.alias("entity"),
            F.col("user_id").alias("user"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.lit(now).alias("ts"),
            F.col("message_id").alias("source_message_id"),
        )
        .where((F.col("term") != "") & (F.col("entity") != "") & (F.col("term") != F.col("entity")))
    )


def manifest_summary(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.agg(
        F.countDistinct("session_id").alias("sessions"),
        F.count(F.lit(1)).alias("interactions"),
        F.count_if(F.col("rated") == "POSITIVE").alias("positives"),
        F.count_if(F.col("correction") != "").alias("corrections"),
    )


def feedback_events(audit: DataFrame, service: str, space: str) -> DataFrame:
    """Feedback actions of one question space, newest first."""
    return (
        audit.where(
            (F.col("service_name") == service)
            & F.array_contains(words(fv.FEEDBACK_ACTIONS), F.col("action_name"))
            & (F.col("request_params.space_id") == space)
        )
        .select(
            "event_time",
            F.col("user_identity.email").alias("user"),
            "action_name",
            F.col("request_params.space_id").alias("space_id"),
            F.col("request_params.feedback_rating").alias("rating"),
        )
        .orderBy(F.desc("event_time"))
    )


def latest_statements(history: DataFrame, application: str, n: int = 500) -> DataFrame:
    """The newest statements one application sent (a top-n report)."""
    return (
        history.where(F.col("client_application") == application)
        .orderBy(F.desc("start_time"), "statement_text", "executed_by", F.desc("total_duration_ms"))
        .limit(n)
        .select("statement_text", "executed_by", "start_time", "total_duration_ms")
    )
