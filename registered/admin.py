"""Sources and sinks, streaming, monitoring, dashboard and daily-report cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from registered.base import CTES, case
from registered.loop import corrections_of
from registered.retail import RULE_NAMES, d
from registered.scoring import results_of, scores_of
from tallyloom import fixed_values as fv
from tallyloom.operators import clickstream, monitoring, report
from tallyloom.operators.faults import ground_truth
from tallyloom.plans.marts import Marts
from tallyloom.plans.refresh import StoredMarts, refresh_landed
from tallyloom.plans.report_job import DailyReport
from tallyloom.session import PACKED, scratch_path, writing
from tallyloom.sources import tables, warehouse as wh
from tallyloom.sources.labels import read_labels
from tallyloom.sources.suite import read_suite
from tallyloom.streaming import dedup, ingest, merged

NOW = "2001-08-01 00:00:00"

# ---- sources and sinks ---------------------------------------------------------------------------


@case(
    "src01_csv_ingest",
    "SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country FROM bronze_sales",
)
def _(m: Marts):
    """Write the sales lines as CSV files with the original headers, then ingest them as a stream."""
    folder, out, mark = (scratch_path(m.spark, n) for n in ("csv", "bronze", "mark"))
    headers = [F.col(n).alias(h) for h, n in fv.CSV_HEADERS.items()]
    m.bronze_sales.select(*headers).write.option("header", True).csv(folder)
    return ingest.ingest_sales(m.spark, folder, out, mark).drop("_source_file", "_ingested_at")


@case(
    "src02_jsonl_ingest",
    "SELECT event_id, session_id, event_type, event_ts, is_v2 FROM seen_events_v3",
)
def _(m: Marts):
    folder, out, mark = (scratch_path(m.spark, n) for n in ("jsonl", "events", "mark"))
    m.event_lines.write.text(folder)
    landed = ingest.ingest_events(m.spark, folder, out, mark)
    seen = clickstream.unify(clickstream.parse_lines(landed.select("value")), accept_v3=True)
    return seen.select("event_id", "session_id", "event_type", F.col("event_ts").try_cast("timestamp").alias("event_ts"), "is_v2")


@case("src02_rescued_lines", "SELECT count(*) AS lines, count(*) FILTER (WHERE ver = 0) AS rescued FROM feed")
def _(m: Marts):
    parsed = clickstream.parse_lines(m.event_lines)
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count("_rescued").alias("rescued"))


@case("src03_label_files", "SELECT event_id, array_to_string(labels, ',') AS labels FROM event_truth")
def _(m: Marts):
    path = scratch_path(m.spark, "labels")
    ground_truth(m.injected_events).write.json(path)
    return read_labels(m.spark, path).select("event_id", F.concat_ws(",", "labels").alias("labels"))


@case("src04_suite_file", "SELECT text AS question, CASE item_id % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'collision' ELSE 'bad' END AS trap FROM benchmark")
def _(m: Marts):
    path = scratch_path(m.spark, "suite")
    wh.eval_suite(m.tables).write.json(path)
    return read_suite(m.spark, path).select("question", "trap")


CORRECTIONS = "SELECT term, entity, user_id AS \"user\", role, ts, message_id AS source_message_id FROM corrections"


def correction_table(m: Marts) -> tables.SnapshotTable:
    schema = 'term STRING, entity STRING, `user` STRING, role STRING, ts DOUBLE, source_message_id STRING'
    return tables.SnapshotTable(m.spark, scratch_path(m.spark, "corrections"), schema)


@case("src05_full_rebuild", "SELECT term, entity, \"user\" FROM (" + CORRECTIONS + ")")
def _(m: Marts):
    """Rebuild twice, the second time with other columns; readers see the last version only."""
    table = correction_table(m)
    c = corrections_of(m)
    table.publish(c)
    table.publish(c.select("term", "entity", "user"))
    return table.read()


@case(
    "src06_append_with_new_column",
    "SELECT message_id, user_id, NULL AS role FROM telemetry UNION ALL SELECT message_id, user_id, role FROM telemetry",
)
def _(m: Marts):
    log = tables.AppendLog(m.spark, scratch_path(m.spark, "log"))
    rows = wh.telemetry(m.tables)
    log.append(rows.select("message_id", "user_id"))
    log.append(rows.select("message_id", "user_id", "role"))
    return log.read().select("message_id", "user_id", "role")


@case("src07_insert_only_merge", CORRECTIONS.replace("entity,", "CASE WHEN user_id IN ('u0', 'u1', 'u2') THEN 'held' ELSE entity END AS entity,"))
def _(m: Marts):
    """The table holds three users' corrections under another entity; the batch carries every
    correction twice. Held rows stay, the others arrive once."""
    table = correction_table(m)
    c = corrections_of(m)
    table.publish(c.where(F.col("user").isin("u0", "u1", "u2")).withColumn("entity", F.lit("held")))
    order = [F.col("ts"), F.col("term"), F.col("entity")]
    return table.change(lambda old: tables.insert_only(old, c.unionByName(c), ["source_message_id"], order))


CTES["fresh_scores"] = """
SELECT term, entity, round(confidence / 2, 4) AS confidence, distinct_users + 1 AS distinct_users, evidence_count + 1 AS evidence_count FROM part_proposals WHERE p_size > 25
UNION ALL SELECT 'new ' || term, entity, confidence, distinct_users, evidence_count FROM part_proposals WHERE p_size <= 10"""


def fresh_scores(m: Marts):
    p = wh.part_proposals(m.tables).withColumn("size", F.regexp_extract("entity", "c([0-9]+)$", 1).cast("int"))
    again = p.where(F.col("size") > 25).withColumns(
        {
            "confidence": F.round(F.col("confidence") / 2, 4),
            "distinct_users": F.col("distinct_users") + 1,
            "evidence_count": F.col("evidence_count") + 1,
        }
    )
    new = p.where(F.col("size") <= 10).withColumn("term", F.concat(F.lit("new "), "term"))
    return again.unionByName(new).drop("size", "status")


SCORES = ["confidence", "distinct_users", "evidence_count"]


@case(
    "src08_upsert_keeps_status",
    "SELECT coalesce(n.term, o.term) AS term, coalesce(n.entity, o.entity) AS entity, coalesce(n.confidence, o.confidence) AS confidence, "
    "coalesce(n.distinct_users, o.distinct_users) AS distinct_users, coalesce(n.evidence_count, o.evidence_count) AS evidence_count, coalesce(o.status, 'proposed') AS status "
    "FROM part_proposals o FULL JOIN fresh_scores n ON o.term = n.term AND o.entity = n.entity",
)
def _(m: Marts):
    return tables.upsert(wh.part_proposals(m.tables), fresh_scores(m), ["term", "entity"], SCORES, {"status": "proposed"})


@case(
    "src09_update_only",
    "SELECT term, entity, CASE WHEN confidence >= 0.75 AND distinct_users >= 2 THEN 'applied' ELSE status END AS status FROM part_proposals",
)
def _(m: Marts):
    p = wh.part_proposals(m.tables)
    decided = p.where((F.col("confidence") >= 0.75) & (F.col("distinct_users") >= 2)).select("term", "entity", F.lit("applied").alias("status"))
    return tables.update_only(p, decided, ["term", "entity"]).select("term", "entity", "status")


@case(
    "src10_guarded_transition",
    "SELECT id, CASE WHEN status = 'pending' AND p_retailprice > 950 THEN 'approved' ELSE status END AS status FROM review_queue JOIN part ON id = p_partkey",
)
def _(m: Marts):
    moves = wh.queue_rulings(m.tables).select("id", F.lit("approved").alias("status"))
    return tables.guarded_transition(wh.review_queue(m.tables), moves, ["id"], "pending").select("id", "status")


@case("src12_append_ledger", "SELECT ts, action, proposal_key, payload FROM audit_ledger")
def _(m: Marts):
    log = tables.AppendLog(m.spark, scratch_path(m.spark, "ledger"))
    log.append(wh.audit_ledger(m.tables))
    return log.read().select("ts", "action", "proposal_key", "payload")


@case("src13_table_from_query", f"SELECT sale_date, {d('net_revenue')} FROM daily_revenue")
def _(m: Marts):
    name = "tl_daily_" + scratch_path(m.spark, "t").rsplit("-", 1)[1]
    return tables.table_from_query(m.daily_revenue.select("sale_date", "net_revenue"), name, scratch_path(m.spark, "ctas"))


@case("src14_defensive_scan", "SELECT message_id, CAST(NULL AS VARCHAR) AS harvested_note FROM telemetry")
def _(m: Marts):
    name = "tl_messages_" + scratch_path(m.spark, "t").rsplit("-", 1)[1]
    wh.telemetry(m.tables).select("message_id").write.option("path", scratch_path(m.spark, "scan")).saveAsTable(name)
    wanted = {"message_id": "string", "harvested_note": "string"}
    absent = tables.with_columns_of(m.spark, "tl_no_such_table", wanted)
    return tables.with_columns_of(m.spark, name, wanted).unionByName(absent)


@case("str01_stream_dedup", "SELECT event_id, session_id, event_type, event_ts FROM silver_events")
def _(m: Marts):
    folder, out, mark = (scratch_path(m.spark, n) for n in ("feed", "dedup", "mark"))
    m.event_lines.write.text(folder)
    kept = dedup.run_dedup(m.spark, folder, out, mark)
    return dedup.settled_events(kept, dedup.settle(m.spark.read.text(folder), kept))


@case("str01_merged_runs", "SELECT event_id, session_id, visitor_id, event_type, stock_code, event_ts, pii_detected, is_v2 FROM silver_events")
def _(m: Marts):
    """The feed in two deliveries, each merged by a run of its own into a table with one folder for each date."""
    folder, out, mark = (scratch_path(m.spark, n) for n in ("feed", "merged", "mark"))
    table, part = merged.MergedEvents(m.spark, out), F.pmod(F.xxhash64("value"), F.lit(3))
    for delivery in (part > 0, part == 0):
        m.event_lines.where(delivery).write.mode("append").text(folder)
        table.run(folder, mark)
    return table.events().drop("referrer")


EVENT_RULES = {
    "has_event_id": "event_id IS NOT NULL", "known_event_type": "coalesce(event_type IN ('view','add_to_cart','purchase'), FALSE)", "parseable_ts": "event_ts IS NOT NULL",
}


def landed_and_refreshed(m: Marts) -> StoredMarts:
    """Sales and events delivered in two parts each, with a refresh behind each delivery."""
    root, csv, lines = (scratch_path(m.spark, n) for n in ("medallion", "csv", "jsonl"))
    headers = [F.col(n).alias(h) for h, n in fv.CSV_HEADERS.items()]
    packed = {"compression": "gzip", "maxRecordsPerFile": PACKED["maxRecordsPerFile"]}  # one task reads a gzipped file
    one, two = F.pmod(F.xxhash64("invoice"), F.lit(4)), F.pmod(F.xxhash64("value"), F.lit(4))
    for sold, seen in ((one > 0, two > 0), (one == 0, two == 0)):
        with writing(m.spark):
            m.bronze_sales.where(sold).select(*headers).write.mode("append").options(header=True, **packed).csv(csv)
            m.event_lines.where(seen).write.mode("append").options(**packed).text(lines)
        refresh_landed(m.spark, csv, lines, root)
    return StoredMarts(m.spark, root, m.tables)


@case(
    "dq07_refresh_expectations",
    " UNION ALL ".join(
        [f"SELECT 'sales' AS feed, '{n}' AS rule, count(*) FILTER (WHERE r{i}) AS passed, count(*) FILTER (WHERE NOT r{i}) AS failed FROM ruled_sales" for i, n in enumerate(RULE_NAMES, 1)]
        + [f"SELECT 'events', '{n}', count(*) FILTER (WHERE {rule}), count(*) FILTER (WHERE NOT ({rule})) FROM seen_events" for n, rule in EVENT_RULES.items()]
    ),
)
def _(m: Marts):
    """The rule counts that the second refresh observed while it wrote its tables."""
    return landed_and_refreshed(m).expectations


@case(
    "src01_refreshed_quarantine",
    "SELECT reasons, count(*) AS rows, TRUE AS landing_known FROM (SELECT array_to_string(reasons, ',') AS reasons FROM tagged_events WHERE len(reasons) > 0) GROUP BY reasons",
)
def _(m: Marts):
    """Quarantined events of refreshed tables by reason, and whether each carries the file and time it landed with."""
    bad = landed_and_refreshed(m).quarantine_events
    known = F.bool_and(F.col("_source_file").isNotNull() & F.col("_ingested_at").isNotNull())
    return bad.groupBy(F.concat_ws(",", "quarantine_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"), known.alias("landing_known"))


# ---- monitoring ----------------------------------------------------------------------------------

CTES["audit_ledger"] = """
SELECT ts, CASE event_id % 5 WHEN 0 THEN 'uc_comment' WHEN 1 THEN 'uc_tag' WHEN 2 THEN 'space_update' WHEN 3 THEN 'metric_view_synonyms' ELSE 'disambiguation_instruction' END AS action,
  'gold.col' || (event_id % 13) AS target, 'term' || (event_id % 97) AS proposal_key, 'payload ' || event_id AS payload, CASE event_id % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'failed' ELSE 'applied' END AS status,
  CASE user_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'human:ann' WHEN 2 THEN 'human:bo' END AS approver FROM events"""
CTES["recent_history"] = f"SELECT * FROM query_history WHERE start_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS"
TIE = "executed_by, start_time, statement_text"


@case(
    "adm01_top_users",
    "SELECT executed_by, count(*) AS statements, CAST(sum(total_duration_ms) AS BIGINT) AS total_duration_ms, round(CAST(sum(total_duration_ms) AS DOUBLE) / count(*), 0) AS avg_duration_ms "
    "FROM recent_history GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10",
)
def _(m: Marts):
    return monitoring.top_users(wh.query_history(m.tables), NOW)


@case(
    "adm02_slowest_statements",
    f"SELECT start_time, executed_by, client_application, execution_status, total_duration_ms, left(statement_text, 200) AS statement_preview FROM recent_history ORDER BY total_duration_ms DESC, {TIE} LIMIT 20",
)
def _(m: Marts):
    return monitoring.slowest(wh.query_history(m.tables), NOW)


@case(
    "adm03_repeated_failures",
    "SELECT sha256(trim(regexp_replace(lower(statement_text), '\\s+', ' ', 'g'))) AS statement_fingerprint, min(left(statement_text, 120)) AS statement_label, executed_by, count(*) AS failures, max(start_time) AS last_seen FROM query_history "
    "WHERE execution_status = 'FAILED' AND start_time >= TIMESTAMP '2001-08-01' - INTERVAL 2000 DAYS GROUP BY 1, 3 HAVING count(*) >= 2 ORDER BY 4 DESC, 1, 3 LIMIT 20",
)
def _(m: Marts):
    return monitoring.repeated_failures(wh.query_history(m.tables), NOW, days=2000)


@case(
    "adm04_source_share",
    "SELECT source, statements, round(100 * CAST(statements AS DOUBLE) / sum(statements) OVER (), 2) AS pct_of_statements, total_duration_ms FROM ("
    "SELECT CASE WHEN client_application = 'Assistant' THEN 'assistant' ELSE coalesce(client_application, 'unknown') END AS source, count(*) AS statements, "
    "CAST(sum(total_duration_ms) AS BIGINT) AS total_duration_ms FROM recent_history GROUP BY 1)",
)
def _(m: Marts):
    return monitoring.source_share(wh.query_history(m.tables), NOW)


@case(
    "adm05_largest_scans",
    f"SELECT start_time, executed_by, client_application, read_bytes, round(read_bytes / 1073741824.0::DOUBLE, 2) AS read_gib, total_duration_ms, left(statement_text, 200) AS statement_preview "
    f"FROM recent_history ORDER BY read_bytes DESC, {TIE} LIMIT 20",
)
def _(m: Marts):
    return monitoring.largest_scans(wh.query_history(m.tables), NOW)


@case("adm06_healing_activity", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, approver, action, status, count(*) AS healings FROM audit_ledger GROUP BY ALL")
def _(m: Marts):
    return monitoring.healing_activity(wh.audit_ledger(m.tables))


@case("adm07_ledger_status", "SELECT status, count(*) AS actions, min(ts) AS first_seen, max(ts) AS last_seen FROM audit_ledger GROUP BY 1")
def _(m: Marts):
    return monitoring.ledger_status(wh.audit_ledger(m.tables))


@case("adm08_queue_depth", "SELECT status, count(*) AS items, min(created_at) AS oldest FROM review_queue GROUP BY 1")
def _(m: Marts):
    return monitoring.queue_depth(wh.review_queue(m.tables))


@case(
    "adm08_oldest_pending",
    "SELECT id, kind, term, entity, confidence, distinct_users, created_at FROM review_queue WHERE status = 'pending' ORDER BY created_at, id LIMIT 20",
)
def _(m: Marts):
    return monitoring.oldest_pending(wh.review_queue(m.tables))


# ---- dashboards ----------------------------------------------------------------------------------


@case("dsh01_accuracy_trend", "SELECT phase, stratum, correct, total, round(correct / CAST(total AS DOUBLE), 3) AS accuracy, recorded_at FROM scores")
def _(m: Marts):
    return monitoring.accuracy_trend(scores_of(m))


@case("dsh02_funnel_health", "SELECT event_date, sessions_ AS sessions, views, add_to_carts, purchases, round(session_conversion_rate, 4) AS conversion FROM funnel_daily")
def _(m: Marts):
    return monitoring.funnel_health(m.funnel_daily)


@case("dsh03_revenue_trend", f"SELECT sale_date, {d('gross_revenue', 'returns_value', 'net_revenue')}, invoices FROM daily_revenue")
def _(m: Marts):
    return monitoring.revenue_trend(m.daily_revenue)


@case(
    "dsh04_latest_actions",
    "SELECT ts, action, target, proposal_key, status, approver FROM audit_ledger ORDER BY ts DESC, proposal_key, action, target LIMIT 100",
)
def _(m: Marts):
    return monitoring.latest_actions(wh.audit_ledger(m.tables))


# ---- daily report --------------------------------------------------------------------------------

W = report.ReportWindow(date(2024, 1, 20), datetime(2024, 1, 20, 18, 0, 0))
Q = report.ReportWindow(date(2026, 2, 10), datetime(2026, 6, 1))
IN = "epoch({0}) >= {1} AND epoch({0}) < {2}"
DAY = IN.format("ts", W.start, W.end)
WEEK = IN.format("ts", W.week_start, W.end)
DEFS = "action IN ('metric_view_synonyms', 'space_glossary', 'uc_comment_tag', 'disambiguation_instruction')"
LEDGER_KPIS = (
    f"SELECT 'definitions_evolved' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM audit_ledger WHERE {DEFS} AND {DAY} "
    f"UNION ALL SELECT 'definitions_evolved_7d', CAST(count(*) AS DOUBLE) FROM audit_ledger WHERE {DEFS} AND {WEEK} "
    f"UNION ALL SELECT 'new_terms_learned', CAST(count(DISTINCT proposal_key) AS DOUBLE) FROM audit_ledger WHERE action LIKE 'space%' AND {DAY}"
)
APPROVER_KPIS = f"SELECT 'healing_activity_' || coalesce(approver, 'unknown') AS kpi, CAST(count(*) AS DOUBLE) AS value FROM audit_ledger WHERE {DAY} GROUP BY 1"
QUEUE_KPIS = (
    f"SELECT 'escalations_opened' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM review_queue WHERE {IN.format('created_at', Q.start, Q.end)} "
    f"UNION ALL SELECT 'escalations_decided', CAST(count(*) AS DOUBLE) FROM review_queue WHERE {IN.format('decided_at', Q.start, Q.end)} "
    f"UNION ALL SELECT 'pending_age_max_days', round(max(({Q.end} - epoch(created_at)) / 86400), 6) FROM review_queue WHERE status = 'pending'"
)
ACCURACY_KPIS = "SELECT 'eval_accuracy_latest_' || stratum AS kpi, arg_max(accuracy, recorded_at) AS value FROM scores GROUP BY stratum"
CTES["harvested"] = "SELECT *, make_timestamp(CAST((ts + 86400) * 1000000 AS BIGINT)) AS harvested_at FROM telemetry"
H = report.ReportWindow(date(2026, 1, 3), datetime(2026, 6, 1))
CORPUS_KPIS = (
    "SELECT 'corpus_size' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM harvested "
    f"UNION ALL SELECT 'corpus_growth_24h', CAST(count(*) AS DOUBLE) FROM harvested WHERE {IN.format('harvested_at', H.start, H.end)}"
)
ROUTER_KPIS = (
    "SELECT 'noise_deflected' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM arm_results WHERE NOT answerable AND NOT arm_b_sent "
    "UNION ALL SELECT 'router_pass_rate', round(avg(CAST(arm_b_sent AS INT)), 6) FROM arm_results WHERE answerable"
)
QUARANTINE_KPIS = "SELECT 'quarantine_rows_24h' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM tagged_events WHERE len(reasons) > 0"


def harvested_of(m: Marts):
    return wh.telemetry(m.tables).withColumn("harvested_at", F.timestamp_seconds(F.col("ts") + 86400))


def ledger_of(m: Marts):
    return wh.audit_ledger(m.tables)


PARTS = {
    "rpt03_definitions_evolved": (LEDGER_KPIS, lambda m: report.ledger_kpis(ledger_of(m), W)),
    "rpt05_healing_by_approver": (APPROVER_KPIS, lambda m: report.approver_kpis(ledger_of(m), W)),
    "rpt06_queue": (QUEUE_KPIS, lambda m: report.queue_kpis(wh.review_queue(m.tables), Q)),
    "rpt07_eval_accuracy": (ACCURACY_KPIS, lambda m: report.accuracy_kpis(scores_of(m))),
    "rpt08_corpus": (CORPUS_KPIS, lambda m: report.corpus_kpis(harvested_of(m), H)),
    "rpt09_router": (ROUTER_KPIS, lambda m: report.router_kpis(results_of(m))),
    "rpt10_quarantine": (QUARANTINE_KPIS, lambda m: report.quarantine_kpis(m.quarantine_events, W)),
}


def part_case(name: str, sql: str, build) -> None:
    case(name, sql)(lambda m: build(m).select("kpi", "value"))


for part_name, (part_sql, part_build) in PARTS.items():
    part_case(part_name, part_sql, part_build)

case(
    "rpt01_report_windows",
    f"SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE {DAY}) AS in_day, count(*) FILTER (WHERE {WEEK}) AS in_week FROM audit_ledger GROUP BY 1",
)(
    lambda m: ledger_of(m).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(report.inside("ts", W.start, W.end)).alias("in_day"), F.count_if(report.inside("ts", W.week_start, W.end)).alias("in_week")
    )
)
case(
    "rpt02_epoch_windows",
    f"SELECT count(*) FILTER (WHERE {IN.format('harvested_at', H.start, H.end)}) AS by_timestamp, count(*) FILTER (WHERE ts >= {H.start} AND ts < {H.end}) AS by_seconds FROM harvested",
)(
    lambda m: harvested_of(m).agg(
        F.count_if(report.inside("harvested_at", H.start, H.end)).alias("by_timestamp"), F.count_if(report.inside("ts", H.start, H.end)).alias("by_seconds")
    )
)
case("rpt04_new_terms_learned", LEDGER_KPIS.split("UNION ALL ")[2].replace("'new_terms_learned',", "'new_terms_learned' AS kpi,").replace("AS DOUBLE) FROM", "AS DOUBLE) AS value FROM"))(
    lambda m: report.ledger_kpis(ledger_of(m), W).where(F.col("kpi") == "new_terms_learned").select("kpi", "value")
)


def report_of(m: Marts):
    parts = [build(m) for _, build in PARTS.values()]
    parts.append(report.missing(parts[0], ["pager_load"], "source absent"))
    return report.assembled(parts, W.day)


REPORT = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql, _ in PARTS.values()) + " UNION ALL SELECT 'pager_load', NULL"


@case("rpt11_daily_report", f"SELECT DATE '2024-01-20' AS report_date, kpi, value FROM ({REPORT})")
def _(m: Marts):
    return report_of(m).select("report_date", "kpi", "value")


def at(sql: str, was: report.ReportWindow, now: report.ReportWindow) -> str:
    """A check written for one window, for another."""
    for edge in ("week_start", "start", "end"):
        sql = sql.replace(str(getattr(was, edge)), str(getattr(now, edge)))
    return sql


def stored_report_sql(w: report.ReportWindow, approvers: str) -> str:
    timed = f"SELECT 'quarantine_rows_24h' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM tagged_events WHERE len(reasons) > 0 AND {IN.format('event_ts', w.start, w.end)}"
    parts = [at(LEDGER_KPIS, W, w), approvers, at(QUEUE_KPIS, Q, w), ACCURACY_KPIS, at(CORPUS_KPIS, H, w), timed]
    gone = "SELECT 'noise_deflected', NULL UNION ALL SELECT 'router_pass_rate', NULL"
    return f"SELECT DATE '{w.day}' AS report_date, kpi, value FROM ({' UNION ALL '.join(f'SELECT * FROM ({p})' for p in parts)} UNION ALL {gone})"


@case(
    "rpt11_stored_report",
    stored_report_sql(W, APPROVER_KPIS) + " UNION ALL " + stored_report_sql(Q, "SELECT 'healing_activity_total' AS kpi, 0.0::DOUBLE AS value"),
)
def _(m: Marts):
    """The report job over stored tables, for two days, one of them twice; the router's table is not there. Quarantined events
    carry the time they landed, taken to be that of the event."""
    sources = {
        "ledger": ledger_of(m), "queue": wh.review_queue(m.tables), "scores": scores_of(m), "messages": harvested_of(m),
        "quarantine": m.quarantine_events.select("event_id", F.col("event_ts").try_cast("timestamp").alias("_ingested_at")),
    }
    names = {}
    for label, df in sources.items():
        path = scratch_path(m.spark, label)
        names[label] = "tl_report_" + path.rsplit("-", 1)[1]
        tables.table_from_query(df, names[label], path)
    job = DailyReport(m.spark, scratch_path(m.spark, "report"), names | {"router": "tl_no_such_table"})
    for window in (W, Q, W):
        job.run(window)
    return job.read().drop("detail")


@case("rpt11_null_kpis","SELECT DATE '2024-01-20' AS report_date, 'pager_load' AS kpi")
def _(m: Marts):
    ledger = report.ledger_kpis(ledger_of(m), W)
    held = report.assembled([ledger, report.missing(ledger, ["pager_load"], "source absent")], W.day)
    return report.null_kpis(held).select("report_date", "kpi")


@case(
    "src11_kpi_upsert",
    f"SELECT DATE '2024-01-20' AS report_date, kpi, value FROM ({LEDGER_KPIS}) UNION ALL SELECT DATE '2024-01-20', kpi, value FROM ({APPROVER_KPIS}) "
    f"UNION ALL SELECT DATE '2024-01-19', kpi, -1.0 FROM ({LEDGER_KPIS})",
)
def _(m: Marts):
    """The report table holds yesterday's and a stale version of today's ledger KPIs."""
    today = report.assembled([report.ledger_kpis(ledger_of(m), W), report.approver_kpis(ledger_of(m), W)], W.day)
    stale = report.assembled([report.ledger_kpis(ledger_of(m), W)], W.day).withColumn("value", F.lit(-1.0))
    held = stale.unionByName(stale.withColumn("report_date", F.date_sub("report_date", 1)))
    return tables.upsert(held, today, ["report_date", "kpi"], ["value", "detail"]).drop("detail")
