"""Telemetry mining, drift scoring, novelty and review-queue cases."""

from pyspark.sql import functions as F

from registered.base import CTES, case
from tallyloom import fixed_values as fv
from tallyloom.operators import drift, escalation, metric_view, novelty, telemetry
from tallyloom.operators.drift import role_weights
from tallyloom.plans.marts import Marts
from tallyloom.session import scratch_path
from tallyloom.sources import warehouse as wh

NOW = 1767830400.0
NOW_TS = "2026-06-01 00:00:00"
SCHEMA = "main.gold"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def cases_of(subject: str, values: list[str], default: str) -> str:
    arms = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"CASE {subject} {arms} ELSE {default} END"


CTES["telemetry"] = f"""
SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '-' || turn || mark AS message_id, 'u' || (conv_id % 7) AS user_id,
  {cases_of('conv_id % 5', wh.DOMAIN_ROLES, "'unknown'")} AS role, content,
  CASE WHEN (conv_id + turn) % 12 = 5 THEN '{wh.QUESTION_SQL}' ELSE '' END AS sql_text,
  CASE WHEN (conv_id + turn) % 12 = 5 THEN 'POSITIVE' WHEN (conv_id + turn) % 12 IN (3,4,6,7,9) THEN 'NEGATIVE' ELSE '' END AS feedback_rating,
  CAST(1767225600 + conv_id * 3600 + turn * 60 AS DOUBLE) AS ts, conv_id * 60 + turn AS n
FROM (SELECT conv_id, turn, '' AS mark, text AS content FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, '-f', {cases_of('(conv_id + turn) % 12', wh.QUESTION_FORMS, 'NULL')} FROM conversations
    WHERE role = 'user' AND (conv_id + turn) % 12 < {len(wh.QUESTION_FORMS)})"""

PARSE = (
    r"""'[''"]?([\p{L}\p{N}_ %/&-]{2,60}?)[''"]?\s+(?:means|refers to|maps to|is on|is in|should use|should map to)\s+"""
    r"""[''"]?([\p{L}\p{N}_.`]{2,120})[''"]?'"""
)


def parsed(text: str, rest: str, source: str) -> str:
    return f"""
SELECT term, entity, {rest} FROM (
  SELECT *, lower(trim(trim(regexp_extract({text}, {PARSE}, 1, 'i')), '''"')) AS term,
    lower(trim(trim(regexp_extract({text}, {PARSE}, 2, 'i')), '''"`')) AS entity FROM {source})
WHERE term <> '' AND entity <> '' AND term <> entity"""


CTES["corrections"] = parsed("content", "user_id, role, ts, message_id", "telemetry")
WEIGHT = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in role_weights().items()) + " ELSE 0.5 END"
CTES["proposals"] = f"""
SELECT term, entity, round(CASE WHEN users < 2 THEN 0.5 ELSE 1 END * (1 - exp(-raw / 2)), 4) AS confidence, users AS distinct_users, evidence_count FROM (
  SELECT term, entity, sum(CAST({WEIGHT} AS DOUBLE) * pow(0.5, greatest(0.0, {NOW} - ts) / 604800)) AS raw, count(DISTINCT user_id) AS users, count(*) AS evidence_count
  FROM corrections GROUP BY 1, 2)"""
CTES["conflicts"] = """
SELECT term, list(entity ORDER BY n DESC, entity) AS entities FROM (SELECT term, entity, count(*) AS n FROM corrections GROUP BY 1, 2) GROUP BY term HAVING count(*) > 1"""
CTES["part_proposals"] = """
SELECT p_name || ' ' || p_partkey AS term, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'fact_sales.' WHEN 2 THEN 'gold.`fact_sales`.' ELSE 'main.gold.fact_sales.' END || 'c' || p_size AS entity,
  round((p_partkey % 100) / 100.0::DOUBLE, 2) AS confidence, CAST(p_size % 5 AS BIGINT) AS distinct_users, CAST(p_size % 9 + 1 AS BIGINT) AS evidence_count,
  CASE p_partkey % 5 WHEN 1 THEN 'approved' WHEN 2 THEN 'applied' WHEN 3 THEN 'rejected' ELSE 'proposed' END AS status, p_size, p_partkey FROM part"""
CTES["resolved_parts"] = """
SELECT *, CASE p_size % 4 WHEN 0 THEN NULL ELSE 'main.gold.fact_sales' END AS fq_table, CASE p_size % 4 WHEN 0 THEN NULL ELSE 'c' || p_size END AS column_name FROM part_proposals"""
CTES["manifest"] = """
SELECT *, CASE WHEN kind NOT IN ('vague', 'unanswerable') AND expect IS NOT NULL AND contains(lower(coalesce(sql_text, '')), lower(expect)) THEN 'POSITIVE' ELSE 'NEGATIVE' END AS rated FROM (
 SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'SELECT 1' ELSE 'SELECT SUM(' || upper(expect) || ') FROM t' END AS sql_text FROM (
  SELECT 'sess-' || conv_id AS session_id, conv_id, turn, 'persona' || (conv_id % 6) AS persona, CASE conv_id % 5 WHEN 0 THEN 'finance' WHEN 1 THEN 'pm' WHEN 2 THEN 'marketing' WHEN 3 THEN 'merchandising' ELSE 'unknown' END AS role,
    text AS question, CASE (conv_id + turn) % 6 WHEN 0 THEN 'jargon' WHEN 1 THEN 'clean' WHEN 2 THEN 'collision' WHEN 3 THEN 'vague' WHEN 4 THEN 'jargon' ELSE 'unanswerable' END AS kind,
    CASE (conv_id + turn) % 6 WHEN 0 THEN 'gross_revenue' WHEN 1 THEN 'net_revenue' WHEN 2 THEN 'monetary' WHEN 3 THEN NULL WHEN 4 THEN 'aov' ELSE 'recency_days' END AS expect,
    CASE (conv_id + turn) % 6 WHEN 0 THEN 'GMV means gross_revenue in gold_daily_revenue' WHEN 2 THEN 'whales refers to gold_customer_rfm.monetary' WHEN 4 THEN 'AOV means revenue_metrics.aov'
      WHEN 5 THEN 'churn risk is in gold_customer_rfm.recency_days' ELSE '' END AS filed_text,
    conv_id || '-' || turn AS message_id, CAST(1767225600 + conv_id * 60 AS DOUBLE) AS ts FROM conversations))"""
CTES["judged"] = """
SELECT *, CASE WHEN rated = 'NEGATIVE' AND kind IN ('jargon', 'collision') THEN filed_text ELSE '' END AS correction FROM manifest"""

# ---- telemetry -----------------------------------------------------------------------------------


def packed_conversations(m: Marts):
    """Telemetry folded back into the nested shape an export has; messages of one conversation only."""
    queries = F.array(
        F.struct(F.struct(F.lit("SELECT 0").alias("query")).alias("query"), F.lit(None).cast("string").alias("text")),
        F.struct(F.struct(F.col("sql").alias("query")).alias("query"), F.lit("note").alias("text")),
    )
    rating = F.when(F.col("feedback_rating") == "NEGATIVE", F.to_json(F.struct(F.lit("NEGATIVE").alias("rating")))).otherwise(
        F.nullif("feedback_rating", F.lit(""))
    )
    msg = F.struct(
        F.col("message_id"), F.lit(None).cast("string").alias("id"),
        F.when(F.col("user_id") != "u0", F.col("user_id")).alias("user_id"), "content",
        (F.col("ts") * 1000).cast("bigint").alias("created_timestamp"), rating.alias("feedback"),
        F.when(F.col("sql") != "", queries).alias("attachments"),
    )
    rows = wh.telemetry(m.tables).select("conversation_id", F.lit("u0").alias("user_id"), F.array(msg).alias("messages"))
    return rows.select("conversation_id", F.lit(None).cast("string").alias("id"), "user_id", "messages")


MESSAGES = "SELECT conversation_id, message_id, user_id, content, sql_text AS sql, feedback_rating, make_timestamp(CAST(ts * 1000000 AS BIGINT)) AS created_ts FROM telemetry"


@case("tel01_flatten_conversations", MESSAGES)
def _(m: Marts):
    return telemetry.flatten_conversations(packed_conversations(m))


@case(
    "tel01_nested_export",
    "SELECT 'c' || conv_id AS conversation_id, turn, role, text AS content, row_number() OVER (PARTITION BY conv_id, turn // 200 ORDER BY turn, role, text) - 1 AS position FROM conversations",
)
def _(m: Marts):
    """Every turn of every conversation, users and assistants, exported in nested lines and read back by position."""
    turns = m.tables("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content")
    )
    path = scratch_path(m.spark, "export")
    telemetry.export_pages(turns).write.text(path)
    return telemetry.read_export(m.spark.read.text(path)).select("conversation_id", "turn", "role", "content", "position")


ROLES = "SELECT 'u' || c_custkey AS user_id, min(c_mktsegment) AS role FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1"


@case(
    "tel02_role_enrichment",
    f"SELECT t.message_id, t.user_id, coalesce(r.role, 'unknown') AS role FROM telemetry t LEFT JOIN ({ROLES}) r ON t.user_id = r.user_id",
)
def _(m: Marts):
    roles = m.tables("customer").where(F.col("c_mktsegment") != "BUILDING").groupBy(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id")
    ).agg(F.min("c_mktsegment").alias("role"))
    return telemetry.with_roles(wh.telemetry(m.tables), roles).select("message_id", "user_id", "role")


CORR = "SELECT term, entity, {0} AS \"user\", role, ts, {1} AS source_message_id FROM {2}"


@case("tel03_correction_parse", "SELECT message_id, term, entity FROM corrections")
def _(m: Marts):
    return telemetry.corrections(wh.telemetry(m.tables)).select(F.col("source_message_id").alias("message_id"), "term", "entity")


@case("tel04_corrections", CORR.format("user_id", "message_id", "corrections"))
def _(m: Marts):
    return telemetry.mergeable(telemetry.corrections(wh.telemetry(m.tables)))


@case(
    "tel05_manifest_corrections",
    CORR.format("persona", "message_id", "(" + parsed("correction", "persona, role, ts, message_id", "judged") + ")"),
)
def _(m: Marts):
    return telemetry.manifest_corrections(telemetry.judged(wh.session_manifest(m.tables)))


KEYWORD = "CASE " + " ".join(f"WHEN contains(lower(content), '{k}') THEN '{t}'" for k, t in fv.KEYWORD_CORRECTIONS) + " END"


@case(
    "tel06_failed_question_corrections",
    CORR.format(
        "'benchmark_eval'", "'bench:run1:' || sha256(question)",
        f"(SELECT term, entity, question, 'data_scientist' AS role, CAST({NOW} AS DOUBLE) AS ts FROM ("
        + parsed("filed", "question", f"(SELECT content AS question, {KEYWORD} AS filed FROM telemetry WHERE {KEYWORD} IS NOT NULL)") + "))",
    ),
)
def _(m: Marts):
    failed = wh.telemetry(m.tables).select(F.col("content").alias("question"))
    return telemetry.failed_question_corrections(failed, "run1", NOW)


@case(
    "tel07_intents",
    CORR.format(
        "persona", "CASE WHEN rated = 'POSITIVE' THEN 'confirm:' ELSE 'correct:' END || message_id",
        "(" + parsed("intent_text", "j_persona AS persona, role, ts, message_id, rated",
          "(SELECT j.*, j.persona AS j_persona, c.intent_text FROM judged j JOIN (SELECT persona, question, min(filed_text) AS intent_text FROM manifest WHERE filed_text <> '' GROUP BY 1, 2) c "
          "ON j.persona = c.persona AND j.question = c.question)") + ")",
    ),
)
def _(m: Marts):
    manifest = wh.session_manifest(m.tables)
    catalogue = manifest.where(F.col("filed_text") != "").groupBy("persona", "question").agg(F.min("filed_text").alias("intent_text"))
    return telemetry.intents(telemetry.judged(manifest), catalogue)


@case("tel08_answer_judgment", "SELECT message_id, kind, rated, correction FROM judged")
def _(m: Marts):
    return telemetry.judged(wh.session_manifest(m.tables)).select("message_id", "kind", "rated", "correction")


@case(
    "tel09_unparsed_negatives",
    "SELECT message_id, content, user_id, role FROM telemetry WHERE upper(feedback_rating) = 'NEGATIVE' AND content <> '' "
    "AND message_id NOT IN (SELECT message_id FROM corrections)",
)
def _(m: Marts):
    rows = wh.telemetry(m.tables)
    return telemetry.unparsed_negatives(rows, telemetry.corrections(rows))


def extraction_replies(m: Marts):
    """Free-text replies that carry a JSON pair, built from the mined corrections."""
    c = telemetry.corrections(wh.telemetry(m.tables))
    bad = F.col("user") == "u3"
    body = F.when(bad, F.lit("no mapping {broken")).otherwise(
        F.concat(F.lit("Sure: "), F.to_json(F.struct(F.upper("term").alias("term"), F.concat(F.lit("`"), "entity", F.lit("`")).alias("entity"))), F.lit(" done"))
    )
    return c.select(F.col("source_message_id").alias("message_id"), F.col("user").alias("user_id"), "role", body.alias("extracted"))


@case(
    "tel10_extraction_replies",
    f"SELECT term, entity, user_id AS \"user\", role, CAST({NOW} AS DOUBLE) AS ts, message_id AS source_message_id FROM corrections WHERE user_id <> 'u3'",
)
def _(m: Marts):
    return telemetry.extraction_corrections(extraction_replies(m), NOW)


@case(
    "tel11_manifest_summary",
    "SELECT count(DISTINCT session_id) AS sessions, count(*) AS interactions, count(*) FILTER (WHERE rated = 'POSITIVE') AS positives, "
    "count(*) FILTER (WHERE correction <> '') AS corrections FROM judged",
)
def _(m: Marts):
    return telemetry.manifest_summary(telemetry.judged(wh.session_manifest(m.tables)))


@case(
    "tel12_feedback_events",
    "SELECT ts AS event_time, 'u' || user_id AS \"user\", CASE event_type WHEN 'click' THEN 'updateConversationMessageFeedback' ELSE 'createConversationMessageComment' END AS action_name, "
    "'space1' AS space_id, CASE WHEN value > 20 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS rating FROM events WHERE event_type IN ('click', 'view') AND user_id < 50",
)
def _(m: Marts):
    audit = m.tables("events").select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.lit("assistant").alias("service_name"),
        F.when(F.col("event_type") == "click", fv.FEEDBACK_ACTIONS[0]).when(F.col("event_type") == "view", fv.FEEDBACK_ACTIONS[1]).otherwise("viewSpace").alias("action_name"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email")).alias("user_identity"),
        F.struct(
            F.when(F.col("user_id") < 50, "space1").otherwise("space2").alias("space_id"),
            F.when(F.col("value") > 20, "POSITIVE").otherwise("NEGATIVE").alias("feedback_rating"),
        ).alias("request_params"),
    )
    return telemetry.feedback_events(audit, "assistant", "space1")


CTES["query_history"] = """
SELECT 'q' || (o_orderkey % 40) || ' ' || o_orderpriority AS statement_text, 'user' || (o_custkey % 20) AS executed_by, o_orderdate AS start_time,
  CAST(floor(o_totalprice) AS BIGINT) AS total_duration_ms, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS execution_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'Assistant' WHEN 1 THEN 'SQL Editor' WHEN 2 THEN 'Dashboard' END AS client_application,
  CAST(floor(o_totalprice) AS BIGINT) * 1048576 AS read_bytes FROM orders"""


@case(
    "tel13_latest_statements",
    "SELECT statement_text, executed_by, start_time, total_duration_ms FROM query_history WHERE client_application = 'Assistant' "
    "ORDER BY start_time DESC, statement_text, executed_by, total_duration_ms DESC LIMIT 500",
)
def _(m: Marts):
    return telemetry.latest_statements(wh.query_history(m.tables), "Assistant")


# ---- drift ---------------------------------------------------------------------------------------


def corrections_of(m: Marts):
    return telemetry.corrections(wh.telemetry(m.tables))


def proposals_of(m: Marts):
    return drift.score(corrections_of(m), NOW)


@case("drf01_scored_proposals", "SELECT * FROM proposals")
def _(m: Marts):
    return proposals_of(m)


@case("drf02_evidence", CORR.format("user_id", "message_id", "corrections"))
def _(m: Marts):
    return drift.evidence(corrections_of(m))


@case(
    "drf03_conflicts",
    "SELECT term, entity, count(*) AS reports, (SELECT len(entities) FROM conflicts f WHERE f.term = c.term) AS entities FROM corrections c "
    "WHERE term IN (SELECT term FROM conflicts) GROUP BY 1, 2",
)
def _(m: Marts):
    return drift.conflicts(corrections_of(m))


BASE_WEIGHT = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in fv.ROLE_WEIGHTS.items()) + " ELSE 0.5 END"


@case(
    "drf04_role_weight_override",
    "SELECT b.term, b.entity, b.confidence AS base_confidence, p.confidence AS retail_confidence FROM (" + CTES["proposals"].replace(WEIGHT, BASE_WEIGHT)
    + ") b JOIN proposals p ON b.term = p.term AND b.entity = p.entity",
)
def _(m: Marts):
    c = corrections_of(m)
    base = drift.score(c, NOW, role_weights(retail=False)).select("term", "entity", F.col("confidence").alias("base_confidence"))
    retail = drift.score(c, NOW).select("term", "entity", F.col("confidence").alias("retail_confidence"))
    return base.join(retail, ["term", "entity"])


GATE = "confidence >= 0.75 AND distinct_users >= 2"


@case("drf05_triage", f"SELECT term, entity, CASE WHEN {GATE} THEN 'auto' ELSE 'review' END AS lane FROM part_proposals")
def _(m: Marts):
    return drift.triage(wh.part_proposals(m.tables)).select("term", "entity", "lane")


@case("drf06_without_conflicts", "SELECT term, entity, confidence FROM proposals WHERE term NOT IN (SELECT term FROM conflicts)")
def _(m: Marts):
    c = corrections_of(m)
    return drift.without_conflicts(drift.score(c, NOW), drift.conflicts(c)).select("term", "entity", "confidence")


@case("drf07_resolved_entities", "SELECT term, entity, fq_table, column_name FROM resolved_parts")
def _(m: Marts):
    return drift.resolved(wh.part_proposals(m.tables), SCHEMA).select("term", "entity", "fq_table", "column_name")


HOME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.COLUMN_HOME.items())
VIEW = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.MEASURE_TARGET.items())
MEASURE = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in fv.MEASURE_TARGET.items())
CTES["proposal_targets"] = f"""
SELECT term, entity, CASE WHEN in_view THEN NULL WHEN dotted THEN owner ELSE CASE entity {HOME} END END AS home_table,
  CASE WHEN in_view THEN NULL WHEN dotted THEN last_part ELSE entity END AS home_column,
  CASE WHEN in_view THEN owner WHEN NOT dotted THEN CASE entity {VIEW} END END AS view, CASE WHEN in_view THEN last_part WHEN NOT dotted THEN CASE entity {MEASURE} END END AS measure
FROM (SELECT *, contains(entity, '.') AS dotted, split_part(entity, '.', -1) AS last_part, CASE WHEN contains(entity, '.') THEN split_part(entity, '.', -2) END AS owner,
  contains(entity, '.') AND split_part(entity, '.', -2) IN ('revenue_metrics', 'funnel_metrics') AS in_view FROM proposals)"""


@case("drf08_targets", "SELECT * FROM proposal_targets")
def _(m: Marts):
    return drift.targets(proposals_of(m)).select("term", "entity", "home_table", "home_column", "view", "measure")


@case(
    "drf09_healing_plan",
    "SELECT a.action, fq_table || '.' || column_name AS target, lower(term) || '→' || lower(entity) AS proposal_key, CASE a.action "
    "WHEN 'uc_comment' THEN 'COMMENT ON COLUMN ' || fq_table || '.' || column_name || ' IS ''Learned synonym: ''''' || replace(term, '''', '''''') || '''''.''' "
    "WHEN 'uc_tag' THEN 'ALTER TABLE ' || fq_table || ' ALTER COLUMN ' || column_name || ' SET TAGS (''learned_synonym'' = ''' || replace(term, '''', '') || ''')' "
    f"ELSE term END AS payload, left(payload, 1000) AS payload_label, 'approved' AS status, 'auto' AS approver FROM resolved_parts, (VALUES ('uc_comment'), ('uc_tag'), ('space_update')) a(action) WHERE {GATE} AND column_name IS NOT NULL",
)
def _(m: Marts):
    return drift.healing_plan(wh.part_proposals(m.tables), SCHEMA, dry_run=True)


CTES["glossary_lines"] = """
SELECT 'mapping' AS line_kind, term, 'Term ''' || term || ''' means ' || entity || '.' AS text FROM proposals WHERE term NOT IN (SELECT term FROM conflicts)
UNION ALL SELECT 'ask_first', term, 'Term ''' || term || ''' is ambiguous: ' || array_to_string(entities[1:10], ', ') || '. Ask which one is meant before answering.' FROM conflicts"""


def glossary_of(m: Marts):
    c = corrections_of(m)
    conflicted = drift.conflicts(c)
    return drift.glossary(drift.without_conflicts(drift.score(c, NOW), conflicted), conflicted)


@case("drf10_glossary", "SELECT * FROM glossary_lines")
def _(m: Marts):
    return glossary_of(m)


@case(
    "drf11_instruction_versions",
    "WITH base AS (SELECT 1 AS version, row_number() OVER (ORDER BY p_type) AS line_no, 'Note on ' || p_type AS text FROM (SELECT DISTINCT p_type FROM part)), "
    "nxt AS (SELECT 2 AS version, line_no, text FROM base UNION ALL SELECT 2, (SELECT count(*) FROM base) + row_number() OVER (ORDER BY text), text FROM glossary_lines) "
    "SELECT CAST(version AS BIGINT) AS version, line_no, text FROM (SELECT * FROM base UNION ALL SELECT * FROM nxt UNION ALL SELECT 3, line_no, text FROM base)",
)
def _(m: Marts):
    from pyspark.sql import Window

    types = m.tables("part").select("p_type").distinct()
    base = types.select(
        F.lit(1).alias("version"),
        F.row_number().over(Window.orderBy("p_type")).alias("line_no"),
        F.concat(F.lit("Note on "), "p_type").alias("text"),
    )
    history = base.unionByName(drift.next_instructions(base, glossary_of(m)))
    return history.unionByName(drift.restored_instructions(history, 1))


@case(
    "drf12_held_report",
    f"SELECT term, entity, confidence, distinct_users, CASE WHEN NOT ({GATE}) THEN 'below gate' ELSE 'entity not table.column-shaped' END AS reason "
    f"FROM resolved_parts WHERE NOT ({GATE}) OR column_name IS NULL",
)
def _(m: Marts):
    return drift.held_report(wh.part_proposals(m.tables), SCHEMA)


@case("drf13_pending_proposals", "SELECT term, entity, confidence, distinct_users, status FROM part_proposals WHERE status IN ('proposed', 'approved')")
def _(m: Marts):
    return drift.pending(wh.part_proposals(m.tables)).select("term", "entity", "confidence", "distinct_users", "status")


# ---- synonyms ------------------------------------------------------------------------------------

HELD = "SELECT 'revenue_metrics' AS view, p_type AS name, p_brand AS synonym, min(p_partkey) AS position FROM part GROUP BY 2, 3"
LEARNED = "SELECT 'revenue_metrics' AS view, p_type AS name, CASE p_size % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN upper(p_name) ELSE p_name END AS synonym, p_partkey AS position FROM part"


def synonym_sql(owner: str, fold: str) -> str:
    return (
        f"WITH held AS ({HELD}), learned AS ({LEARNED}), room AS (SELECT {owner}, count(*) AS n, max(position) AS last_pos FROM held GROUP BY ALL), "
        f"fresh AS (SELECT {owner}, arg_min(synonym, position) AS synonym, min(position) AS position FROM learned "
        f"WHERE (name, {fold.format('synonym')}) NOT IN (SELECT (name, {fold.format('synonym')}) FROM held) GROUP BY {owner}, {fold.format('synonym')}), "
        f"turned AS (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY position, synonym) AS turn FROM fresh) "
        f"SELECT {owner}, synonym, position, FALSE AS held_back FROM held UNION ALL "
        f"SELECT {', '.join('t.' + o.strip() for o in owner.split(','))}, synonym, coalesce(last_pos, 0) + turn, turn + coalesce(n, 0) > 10 FROM turned t LEFT JOIN room r ON t.name = r.name"
    )


@case("mv06_synonym_merge", synonym_sql("view, name", "lower({})"))
def _(m: Marts):
    return metric_view.merge_synonyms(wh.held_synonyms(m.tables), wh.learned_synonyms(m.tables), ["view", "name"])


@case(
    "mv07_column_synonym_merge",
    synonym_sql("view, name", "{}").replace("SELECT view, name, synonym", "SELECT view AS table_name, name AS column_name, synonym").replace("SELECT t.view, t.name", "SELECT t.view AS table_name, t.name AS column_name"),
)
def _(m: Marts):
    owner = {"view": "table_name", "name": "column_name"}
    held, learned = (f(m.tables).withColumnsRenamed(owner) for f in (wh.held_synonyms, wh.learned_synonyms))
    return metric_view.merge_synonyms(held, learned, list(owner.values()), fold_case=False)


EDGE = r"[^\p{L}\p{N}_]"


@case(
    "mv08_synonym_resolution",
    "SELECT DISTINCT message_id, view, measure AS name, term AS synonym FROM telemetry t JOIN proposal_targets p ON p.view IS NOT NULL "
    f"AND regexp_matches(lower(content), '(^|{EDGE})' || term || '($|{EDGE})')",
)
def _(m: Marts):
    synonyms = drift.targets(proposals_of(m)).where(F.col("view").isNotNull()).select(
        "view", F.col("measure").alias("name"), F.col("term").alias("synonym")
    )
    return metric_view.resolve_synonyms(wh.telemetry(m.tables), synonyms, "message_id", "content")


# ---- novelty -------------------------------------------------------------------------------------

STOP = quoted(fv.STOPWORDS)
KNOWN = quoted(fv.KNOWN_TERMS)
GOVERNED = quoted(fv.GOVERNED_WORDS)
SINGULAR = "CASE WHEN {0} LIKE '%ies' AND length({0}) > 4 THEN left({0}, length({0}) - 3) || 'y' WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"
FILLER = "({0} IN (" + STOP + ") OR regexp_full_match({0}, '[0-9]+'))"
CTES["grams"] = """
SELECT message_id, user_id, content, feedback_rating, ts, g, split_part(g, ' ', 1) AS a, split_part(g, ' ', 2) AS b FROM (
  SELECT *, unnest(list_distinct(toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS g
  FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS toks FROM telemetry))"""
CTES["candidates"] = f"""
SELECT message_id, user_id, content, feedback_rating, ts, g AS term FROM grams
WHERE NOT {FILLER.format('a')} AND (b = '' OR NOT {FILLER.format('b')}) AND g NOT IN ({KNOWN})
  AND NOT ({SINGULAR.format('a')} IN ({GOVERNED}) AND (b = '' OR {SINGULAR.format('b')} IN ({GOVERNED})))"""
CTES["mined_candidates"] = """
SELECT * FROM candidates WHERE feedback_rating = 'NEGATIVE' AND message_id NOT IN (SELECT message_id FROM corrections)"""
NOVEL = """
SELECT term, occurrences, distinct_users FROM q WHERE contains(term, ' ') OR term NOT IN (SELECT unnest(string_split(term, ' ')) FROM q WHERE contains(term, ' '))"""
CTES["novel"] = (
    "WITH q AS (SELECT term, count(*) AS occurrences, count(DISTINCT user_id) AS distinct_users FROM mined_candidates GROUP BY term HAVING count(*) >= 2) " + NOVEL
)


@case("nov01_candidate_terms", "SELECT message_id, term FROM candidates")
def _(m: Marts):
    return novelty.candidate_terms(wh.telemetry(m.tables).select("message_id", "content"), "content").select("message_id", "term")


@case(
    "nov02_singular_forms",
    f"SELECT a AS word, {SINGULAR.format('a')} AS singular, count(*) AS uses FROM grams WHERE b = '' GROUP BY 1, 2",
)
def _(m: Marts):
    from tallyloom.functions.text import plain_tokens, singular

    w = wh.telemetry(m.tables).select(F.explode(F.array_distinct(plain_tokens("content"))).alias("word"))
    return w.select("word", singular(F.col("word")).alias("singular")).groupBy("word", "singular").agg(F.count(F.lit(1)).alias("uses"))


@case(
    "nov03_failed_questions",
    "SELECT message_id FROM telemetry WHERE feedback_rating = 'NEGATIVE' AND message_id NOT IN (SELECT message_id FROM corrections)",
)
def _(m: Marts):
    return novelty.failed_questions(wh.telemetry(m.tables), "content", ["feedback_rating"]).select("message_id")


def failed_of(m: Marts):
    return novelty.failed_questions(wh.telemetry(m.tables), "content", ["feedback_rating"])


@case("nov04_novel_terms", "SELECT * FROM novel")
def _(m: Marts):
    return novelty.novel_terms(failed_of(m), "content", "user_id")


@case(
    "nov04_novel_terms_all_questions",
    "WITH q AS (SELECT term, count(*) AS occurrences, count(DISTINCT user_id) AS distinct_users FROM candidates WHERE message_id NOT IN (SELECT message_id FROM corrections) "
    "GROUP BY term HAVING count(*) >= 2) " + NOVEL,
)
def _(m: Marts):
    rows = novelty.failed_questions(wh.telemetry(m.tables), "content", ["feedback_rating"], only_negative=False)
    return novelty.novel_terms(rows, "content", "user_id")


@case(
    "nov05_example_questions",
    "SELECT term, string_agg(content, ' | ' ORDER BY ts, message_id, content) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ts, message_id, content) AS turn FROM ("
    "SELECT term, content, min(ts) AS ts, arg_min(message_id, (ts, message_id)) AS message_id FROM mined_candidates GROUP BY 1, 2)) WHERE turn <= 3 GROUP BY term",
)
def _(m: Marts):
    found = novelty.example_questions(failed_of(m), "content", ["ts", "message_id"])
    return found.select("term", F.array_join("example_questions", " | ").alias("examples"))


# ---- escalation ----------------------------------------------------------------------------------

CTES["batch"] = f"""
SELECT 'below_gate_proposal:' || term AS proposal_key, 'below_gate_proposal' AS kind, term, entity, confidence, distinct_users FROM proposals WHERE NOT ({GATE}) OR term IN (SELECT term FROM conflicts)
UNION ALL SELECT 'poison_conflict:' || c.term, 'poison_conflict', c.term, NULL, 0.0::DOUBLE, (SELECT count(DISTINCT user_id) FROM corrections k WHERE k.term = c.term) FROM conflicts c
UNION ALL SELECT 'novel_term:' || term, 'novel_term', term, NULL, 0.0::DOUBLE, distinct_users FROM novel"""
BATCH = "proposal_key, kind, term, entity, confidence, distinct_users"


def batch_of(m: Marts):
    c = corrections_of(m)
    return escalation.build(drift.score(c, NOW), drift.conflicts(c), novelty.novel_terms(failed_of(m), "content", "user_id"), c)


@case("esc01_escalations", f"SELECT {BATCH} FROM batch")
def _(m: Marts):
    return batch_of(m).select(*BATCH.split(", "))


CTES["review_queue"] = f"""
SELECT p_partkey AS id, kind || ':' || term AS proposal_key, term, CASE WHEN kind = 'below_gate_proposal' THEN 'fact_sales.c' || p_size END AS entity,
  round((p_partkey % 75) / 100.0::DOUBLE, 2) AS confidence, CAST(p_size % 5 + 1 AS BIGINT) AS distinct_users, kind, {cases_of('p_size % 4', wh.QUEUE_STATES, "''")} AS status,
  created AS created_at, CASE WHEN p_size % 4 <> 0 THEN created + INTERVAL 1 DAY END AS decided_at, CASE WHEN p_size % 4 <> 0 THEN 'human:' || lower(p_type) END AS decided_by, p_size * 3 AS occurrences
FROM (SELECT *, {cases_of('p_partkey % 3', wh.QUEUE_KINDS, "''")} AS kind, p_name || ' ' || p_partkey AS term,
  TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(p_partkey % 2000 AS INT)) AS created FROM part)"""


def queue_batch(m: Marts):
    """A batch that meets a queue: the queue's own keys again, changed keys and repeats."""
    q = wh.review_queue(m.tables)
    fresh = F.explode(F.array(F.lit(""), F.lit(" v2"), F.lit(" v2")))
    return q.select("kind", "term", "entity", "confidence", "distinct_users", fresh.alias("suffix")).select(
        F.concat(F.col("kind"), F.lit(":"), F.col("term"), F.col("suffix")).alias("proposal_key"), "kind",
        F.concat("term", "suffix").alias("term"), "entity", "confidence", "distinct_users",
    )


NEXT = "SELECT kind || ':' || term || suffix AS proposal_key, kind, term || suffix AS term, entity, confidence, distinct_users, 'pending' AS status FROM review_queue, (VALUES (''), (' v2')) s(suffix)"


@case("esc02_enqueue_unless_pending", f"SELECT * FROM ({NEXT}) WHERE proposal_key NOT IN (SELECT proposal_key FROM review_queue WHERE status = 'pending')")
def _(m: Marts):
    return escalation.enqueue(wh.review_queue(m.tables), queue_batch(m), only_pending=True)


@case("esc03_enqueue_unless_known", f"SELECT * FROM ({NEXT}) WHERE proposal_key NOT IN (SELECT proposal_key FROM review_queue)")
def _(m: Marts):
    return escalation.enqueue(wh.review_queue(m.tables), queue_batch(m))


@case("esc04_pending", "SELECT id, proposal_key, confidence FROM review_queue WHERE status = 'pending'")
def _(m: Marts):
    return escalation.pending(wh.review_queue(m.tables)).select("id", "proposal_key", "confidence")


CTES["allowed_rulings"] = """
SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'approve' ELSE 'reject' END AS ruling, 'user' || (p_partkey % 20) AS principal FROM part
WHERE p_retailprice > 950 AND p_size % 3 < 2 AND 'user' || (p_partkey % 20) IN (SELECT 'user' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0)"""
DECIDED = f"""SELECT q.id, CASE WHEN r.id IS NOT NULL AND q.status = 'pending' THEN CASE r.ruling WHEN 'approve' THEN 'approved' ELSE 'rejected' END ELSE q.status END AS status,
  CASE WHEN r.id IS NOT NULL AND q.status = 'pending' THEN TIMESTAMP '{NOW_TS}' ELSE decided_at END AS decided_at,
  CASE WHEN r.id IS NOT NULL AND q.status = 'pending' THEN 'human:' || principal ELSE decided_by END AS decided_by FROM review_queue q LEFT JOIN allowed_rulings r ON q.id = r.id"""


def rulings_of(m: Marts):
    return escalation.allowed_rulings(wh.queue_rulings(m.tables), wh.role_grants(m.tables), "metric_reviewer")


@case("esc05_decide", DECIDED)
def _(m: Marts):
    out = escalation.decide(wh.review_queue(m.tables), rulings_of(m), NOW_TS)
    return out.select("id", "status", "decided_at", "decided_by")


PAYLOAD = (
    "CASE WHEN kind <> 'below_gate_proposal' THEN 'ruling recorded for ''' || term || ''' (' || kind || ')' "
    "ELSE 'mapped ''' || term || ''' to main.gold.' || entity END"
)


@case(
    "esc06_apply_approved",
    f"SELECT TIMESTAMP '{NOW_TS}' AS ts, kind AS action, coalesce(entity, term) AS target, proposal_key, {PAYLOAD} AS payload, 'applied' AS status, coalesce(decided_by, 'reviewer') AS approver "
    "FROM review_queue WHERE status = 'approved'",
)
def _(m: Marts):
    return escalation.application_ledger(escalation.applications(wh.review_queue(m.tables), SCHEMA), NOW_TS)


@case("esc06_queue_after_apply", "SELECT id, CASE status WHEN 'approved' THEN 'applied' ELSE status END AS status FROM review_queue")
def _(m: Marts):
    q = wh.review_queue(m.tables)
    return escalation.mark_applied(q, escalation.applications(q, SCHEMA)).select("id", "status")


@case(
    "esc07_queue_stats",
    f"SELECT status, kind, count(*) AS n, round(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(confidence), 2) AS avg_confidence, min(created_at) AS oldest, "
    f"max(date_diff('day', created_at, TIMESTAMP '{NOW_TS}')) AS max_age_days FROM review_queue GROUP BY 1, 2",
)
def _(m: Marts):
    return escalation.stats(wh.review_queue(m.tables), NOW_TS)


@case(
    "esc08_novel_by_occurrences",
    f"SELECT id, term, CAST(occurrences AS BIGINT) AS occurrences, distinct_users, date_diff('day', created_at, TIMESTAMP '{NOW_TS}') AS age_days FROM review_queue WHERE status = 'pending' AND kind = 'novel_term'",
)
def _(m: Marts):
    return escalation.novel_by_occurrences(wh.review_queue(m.tables), NOW_TS)


DECISION = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t) in escalation.DOCKET.items()) + " END"
PLACE = "CAST(CASE kind WHEN 'poison_conflict' THEN 0 WHEN 'below_gate_proposal' THEN 1 ELSE 2 END AS BIGINT)"


@case(
    "esc09_docket",
    f"SELECT id, kind, term, entity, round(confidence, 2) AS confidence, distinct_users, {DECISION} AS decision, {PLACE} AS place FROM review_queue WHERE status = 'pending'",
)
def _(m: Marts):
    return escalation.docket(wh.review_queue(m.tables)).drop("evidence")


@case("esc10_role_gate", "SELECT * FROM allowed_rulings")
def _(m: Marts):
    return rulings_of(m)


GRANTS = "SELECT 'user' || c_custkey AS principal, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'metric_reviewer' ELSE 'viewer' END AS role, c_acctbal < 0 AS ended, c_acctbal, c_mktsegment FROM customer"


@case(
    "esc11_role_grants",
    f"WITH g AS ({GRANTS}) SELECT principal, role, ended OR c_mktsegment = 'AUTOMOBILE' AS ended FROM g UNION ALL SELECT principal, 'viewer', FALSE FROM g WHERE role <> 'viewer' OR ended",
)
def _(m: Marts):
    grants = wh.role_grants(m.tables)
    leavers = m.tables("customer").where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("principal"), F.lit("viewer").alias("role")
    )
    wanted = grants.select("principal", F.lit("viewer").alias("role"), F.lit("lead").alias("granted_by"), F.lit(NOW_TS).cast("timestamp").alias("granted_at"))
    added = escalation.grant_roles(grants, wanted)
    ended = escalation.revoke_roles(added, leavers.join(grants.where(F.col("revoked_at").isNull()), ["principal", "role"], "left_semi"), NOW_TS)
    return ended.select("principal", "role", F.col("revoked_at").isNotNull().alias("ended"))


@case(
    "esc12_verification",
    "SELECT status, count(*) AS n FROM review_queue GROUP BY 1 UNION ALL SELECT 'decided by ' || decided_by, count(*) FROM review_queue WHERE decided_by IS NOT NULL GROUP BY 1",
)
def _(m: Marts):
    return escalation.verification(wh.review_queue(m.tables))
