"""Aggregations over findings, actions, items and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators import findings as fnd
from waybill.operators import mapping as mp
from waybill.operators import runlog, state
from waybill.operators import documents as docs
from waybill.operators import quality
from waybill.operators import verify as vf
from waybill.plans import summary
from workload.inputs import (
    CHECKPOINTS, ITEMS, MAPPED_OPTIONS, MAPPINGS, RUN_STATUS, checkpoints, items, mapped_options, mappings, run_status,
)
from workload.registry import query
from workload.tables import (
    ACTIONS, COLLECTIONS, DESTINATION, FIELDS, FINDINGS, RAW_BLOCKS, RECORDS, SEQ, Tables, with_,
)

RANK = "CASE outcome " + " ".join(
    f"WHEN '{v}' THEN {i}" for i, v in enumerate(vocab.OUTCOMES_BY_RANK)
) + " END"
BY_RANK = "['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed']"
TALLY = ", ".join(f"count(*) FILTER (outcome = '{o}')::BIGINT AS {o}" for o in vocab.OUTCOMES)


@query("worst_outcome", with_(FINDINGS) + f"SELECT entity, {BY_RANK}[max({RANK}) + 1] AS outcome FROM findings GROUP BY entity")
def worst_outcome(t: Tables) -> DataFrame:
    return fnd.worst_outcome(t.findings, ["entity"])


@query(
    "item_outcome",
    with_(FINDINGS) + f"""SELECT entity, CASE WHEN max({RANK}) = 4 THEN 'lossy' ELSE {BY_RANK}[max({RANK}) + 1] END AS outcome
FROM findings GROUP BY entity""",
)
def item_outcome(t: Tables) -> DataFrame:
    return fnd.item_outcome(t.findings, ["entity"])


@query("tally_outcomes", with_(FINDINGS) + f"SELECT code, {TALLY} FROM findings GROUP BY code")
def tally_outcomes(t: Tables) -> DataFrame:
    return fnd.tally_outcomes(t.findings, ["code"])


AGGREGATE = f"""
agg AS (
  SELECT code, outcome, field, sum(coalesce(count, 1))::BIGINT AS count,
         arg_min(severity, o) AS severity, arg_min(category, o) AS category,
         arg_min(message, o) AS message, arg_min(collection, o) AS collection
  FROM (SELECT *, row_number() OVER (ORDER BY {SEQ}) AS o FROM findings) GROUP BY code, outcome, field)"""


@query("aggregate_findings", with_(FINDINGS, AGGREGATE) + "SELECT * FROM agg")
def aggregate_findings(t: Tables) -> DataFrame:
    return fnd.aggregate_findings(t.findings)


@query("inventory", with_(FINDINGS, AGGREGATE) + "SELECT * FROM agg WHERE outcome IN ('transformed', 'lossy', 'unsupported')")
def inventory(t: Tables) -> DataFrame:
    return fnd.inventory(t.findings)


@query(
    "not_preserved",
    with_(FINDINGS, AGGREGATE, ACTIONS, CHECKPOINTS) + """
SELECT code, outcome, field, count, severity, category, message, collection FROM agg WHERE outcome IN ('lossy', 'unsupported')
UNION ALL
SELECT CASE status WHEN 'failed' THEN 'ACTION_FAILED' ELSE 'ACTION_BLOCKED' END, 'failed', NULL, count(*)::BIGINT, 'error',
       'destination', CASE status WHEN 'failed' THEN 'Rejected by the destination; not created.'
       ELSE 'Not attempted: a prerequisite failed.' END, NULL
FROM checkpoints WHERE status IN ('failed', 'blocked') GROUP BY status""",
)
def not_preserved(t: Tables) -> DataFrame:
    failures = fnd.failure_findings(checkpoints(t).select("seq", "status"))
    return fnd.not_preserved(fnd.inventory(t.findings), failures)


@query(
    "plan_summary",
    with_(RECORDS, COLLECTIONS, FIELDS, MAPPINGS, FINDINGS, ACTIONS) + f"""
SELECT a.*, m.*, n.*, e.* FROM
 (SELECT count(*)::BIGINT AS total, count(*) FILTER (disposition = 'execute')::BIGINT AS to_execute,
         count(*) FILTER (disposition = 'skip')::BIGINT AS to_skip,
         {", ".join(f"count(*) FILTER (outcome = '{o}')::BIGINT AS items_{o}" for o in vocab.OUTCOMES)} FROM actions) a,
 (SELECT {", ".join(f"count(*) FILTER (outcome = '{o}')::BIGINT AS fields_{o}" for o in vocab.OUTCOMES)} FROM mappings) m,
 (SELECT sum(coalesce(count, 1)) FILTER (outcome = 'unsupported')::BIGINT AS unsupported,
         sum(coalesce(count, 1)) FILTER (outcome = 'lossy')::BIGINT AS lossy FROM findings) n,
 (SELECT count(*) FILTER (severity = 'error')::BIGINT AS blocking_errors,
         count(DISTINCT code || '|' || coalesce(field, '')) FILTER (severity = 'warning')::BIGINT AS warnings FROM findings) e""",
)
def plan_summary(t: Tables) -> DataFrame:
    return summary.plan_summary(t.actions, mappings(t), t.findings, fnd.inventory(t.findings))


@query("actions_by_kind", with_(ACTIONS) + "SELECT kind, count(*)::BIGINT AS n FROM actions GROUP BY kind")
def actions_by_kind(t: Tables) -> DataFrame:
    return summary.actions_by_kind(t.actions)


@query("distinct_warnings", with_(FINDINGS) + "SELECT count(DISTINCT code || '|' || coalesce(field, ''))::BIGINT AS warnings FROM findings WHERE severity = 'warning'")
def distinct_warnings(t: Tables) -> DataFrame:
    return fnd.distinct_warnings(t.findings)


@query(
    "estimate_requests",
    with_(ACTIONS) + """
SELECT w AS write_requests, floor(w / 90 * 10 + 0.5) / 10 AS minutes
FROM (SELECT sum(estimated_requests) FILTER (disposition = 'execute')::BIGINT AS w FROM actions)""",
)
def estimate_requests(t: Tables) -> DataFrame:
    return summary.estimate_requests(t.actions, 90)


@query(
    "read_write_summary",
    """SELECT count(*) FILTER (event_type = 'view' AND event_id % 11 <> 0)::BIGINT AS reads,
       count(*) FILTER (event_type <> 'view' AND event_id % 11 <> 0)::BIGINT AS writes,
       count(*) FILTER (event_id % 11 = 0)::BIGINT AS blocked FROM events""",
)
def read_write_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", F.lit("read")).when(F.col("event_type") != "click", F.lit("write"))
    return runlog.read_write_summary(
        t.events.select(kind.alias("class"), (F.col("event_id") % 11 == 0).alias("blocked"))
    )


COUNTS = """count(*) FILTER (status = 'verified')::BIGINT AS verified, count(*) FILTER (status = 'mismatched')::BIGINT AS mismatched,
  count(*) FILTER (status = 'missing')::BIGINT AS missing, count(*) FILTER (status = 'unverified')::BIGINT AS unverified"""


@query(
    "verification_counts",
    with_(DESTINATION, ITEMS) + f"""
SELECT *, CASE WHEN mismatched > 0 OR missing > 0 THEN 'failed' WHEN unverified > 0 THEN 'incomplete' ELSE 'passed' END AS result
FROM (SELECT scope, {COUNTS} FROM items GROUP BY scope)""",
)
def verification_counts(t: Tables) -> DataFrame:
    return vf.verification_counts(items(t), "scope")


@query(
    "item_status_from_checks",
    with_(DESTINATION, ITEMS) + "SELECT action_id, status FROM items",
)
def item_status_from_checks(t: Tables) -> DataFrame:
    return vf.item_status_from_checks(vf.checks_long(items(t), ["action_id"]), ["action_id"])


@query(
    "targets_expected_found",
    with_(DESTINATION, ITEMS) + "SELECT scope AS target, count(*)::BIGINT AS expected, count(*) FILTER (status <> 'missing')::BIGINT AS found FROM items GROUP BY scope",
)
def targets_expected_found(t: Tables) -> DataFrame:
    return vf.targets_expected_found(items(t), "scope")


RUN_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS {s}" for s in vocab.ACTION_STATUSES)
RUN_COUNTS_CTE = f"run_counts AS (SELECT run_id, {RUN_COUNTS} FROM checkpoints GROUP BY run_id)"


@query("run_counts", with_(ACTIONS, CHECKPOINTS, RUN_COUNTS_CTE) + "SELECT * FROM run_counts")
def run_counts(t: Tables) -> DataFrame:
    return state.run_counts(checkpoints(t))


TOTAL = " + ".join(vocab.ACTION_STATUSES)


@query(
    "run_progress",
    with_(ACTIONS, CHECKPOINTS, RUN_COUNTS_CTE) + f"""
SELECT run_id, succeeded + skipped AS done, {TOTAL} AS total, floor((succeeded + skipped) / ({TOTAL}) * 100)::BIGINT AS percent FROM run_counts""",
)
def run_progress(t: Tables) -> DataFrame:
    return state.run_progress(state.run_counts(checkpoints(t))).select("run_id", "done", "total", "percent")


@query(
    "run_outcome",
    with_(ACTIONS, CHECKPOINTS, RUN_COUNTS_CTE) + """
SELECT run_id, CASE WHEN pending + in_flight + failed + ambiguous + blocked = 0 THEN 'applied' ELSE 'failed' END AS outcome FROM run_counts""",
)
def run_outcome(t: Tables) -> DataFrame:
    return state.run_outcome(state.run_counts(checkpoints(t))).select("run_id", "outcome")


@query(
    "report_state",
    with_(RUN_STATUS) + """
SELECT run_id, CASE WHEN status IS NULL THEN 'planned_only' WHEN status IN ('approved', 'applying', 'verifying') THEN 'in_progress'
  WHEN status = 'stopped' THEN 'partial' WHEN status = 'applied' THEN 'applied_unverified'
  WHEN status = 'verified' THEN CASE WHEN verification = 'passed' THEN 'verified' ELSE 'applied_unverified' END
  ELSE status END AS state FROM run_status""",
)
def report_state(t: Tables) -> DataFrame:
    return run_status(t).select(
        "run_id", state.report_state(F.col("status"), F.col("verification")).alias("state")
    )


@query(
    "migration_phase",
    with_(RUN_STATUS) + """
SELECT run_id, CASE WHEN status IS NULL THEN CASE WHEN errors > 60 THEN 'blocked' ELSE 'planned' END
  WHEN status = 'applied' THEN CASE WHEN verification = 'incomplete' THEN 'verification_incomplete' ELSE 'applied' END
  ELSE status END AS phase FROM run_status""",
)
def migration_phase(t: Tables) -> DataFrame:
    blocking = F.greatest(F.col("errors") - 60, F.lit(0))
    return run_status(t).select(
        "run_id", state.migration_phase(F.col("status"), blocking, F.col("verification")).alias("phase")
    )


@query(
    "findings_by_outcome",
    with_(FINDINGS) + """
SELECT outcome, count(*)::BIGINT AS kinds, sum(coalesce(count, 1))::BIGINT AS occurrences,
  (list_position(['unsupported', 'lossy', 'transformed', 'failed', 'skipped', 'supported'], outcome) - 1)::INT AS position
FROM findings GROUP BY outcome""",
)
def findings_by_outcome(t: Tables) -> DataFrame:
    return fnd.findings_by_outcome(t.findings)


@query(
    "outcome_chip_counts",
    with_(RECORDS, COLLECTIONS, FIELDS, MAPPINGS) + """
SELECT 'all' AS outcome, count(*)::BIGINT AS n FROM mappings UNION ALL SELECT outcome, count(*) FROM mappings GROUP BY outcome""",
)
def outcome_chip_counts(t: Tables) -> DataFrame:
    return mp.outcome_chip_counts(mp.filter_mappings(mappings(t), t.collections))


@query(
    "outcome_shares",
    with_(FINDINGS) + """
SELECT outcome, n, CASE WHEN v < 0.1 THEN '<0.1%' WHEN v < 10 THEN printf('%.1f', v) || '%' ELSE floor(v + 0.5)::BIGINT || '%' END AS share
FROM (SELECT outcome, n, n / sum(n) OVER () * 100 AS v FROM (SELECT outcome, count(*)::BIGINT AS n FROM findings GROUP BY outcome))""",
)
def outcome_shares(t: Tables) -> DataFrame:
    return fnd.outcome_shares(t.findings)


@query(
    "approval_summary",
    with_(ACTIONS) + """
SELECT kind, scope AS target, count(*)::BIGINT AS n, CASE WHEN count(*) = 1 THEN 'task' ELSE 'tasks' END AS noun,
       false AS experimental, false AS unrecognised FROM actions WHERE disposition = 'execute' GROUP BY kind, scope""",
)
def approval_summary(t: Tables) -> DataFrame:
    return summary.approval_summary(t.actions.withColumn("target", F.col("scope")))


@query("approval_totals", with_(ACTIONS) + "SELECT count(*) FILTER (disposition = 'execute')::BIGINT AS to_write, count(*) FILTER (disposition <> 'execute')::BIGINT AS to_skip FROM actions")
def approval_totals(t: Tables) -> DataFrame:
    return summary.approval_totals(t.actions)


@query(
    "task_summary",
    with_(RECORDS, COLLECTIONS, FIELDS, MAPPINGS, ACTIONS, FINDINGS) + """
, own AS (SELECT f.*, a.id AS action_id FROM findings f JOIN actions a ON f.entity = a.source),
n AS (SELECT action_id, sum(coalesce(count, 1)) FILTER (outcome = 'transformed')::BIGINT AS transformed,
        sum(coalesce(count, 1)) FILTER (outcome = 'lossy')::BIGINT AS lossy,
        sum(coalesce(count, 1)) FILTER (outcome = 'unsupported')::BIGINT AS unsupported FROM own GROUP BY action_id),
b AS (SELECT a.id AS action_id, r.collection FROM actions a JOIN records r ON a.source = r.key
      UNION SELECT action_id, collection FROM own WHERE collection IS NOT NULL),
k AS (SELECT collection, count(*) FILTER (outcome = 'supported') AS kept FROM mappings GROUP BY collection),
p AS (SELECT action_id, count(*)::BIGINT AS collections, sum(coalesce(kept, 0))::BIGINT AS preserved FROM b LEFT JOIN k USING (collection) GROUP BY action_id)
SELECT a.id AS action_id, coalesce(collections, 0) AS collections, preserved, coalesce(transformed, 0) AS transformed,
       coalesce(lossy, 0) AS lossy, coalesce(unsupported, 0) AS unsupported
FROM actions a LEFT JOIN n ON n.action_id = a.id LEFT JOIN p ON p.action_id = a.id""",
)
def task_summary(t: Tables) -> DataFrame:
    # The segment of the customer plays the destination list of an action.
    lists = t.records.select(F.col("key").alias("source"), F.col("collection").alias("list_id"))
    actions = t.actions.select("id", "source").join(lists, "source")
    own = t.findings.join(t.actions.select("id", F.col("source").alias("entity")), "entity").select(
        F.col("id").alias("action_id"), "outcome", "count", "collection"
    )
    collections = t.collections.select("key", F.col("key").alias("list_id"))
    return fnd.task_summary(actions, own, mappings(t), collections)


@query(
    "user_tally",
    """
WITH u AS (SELECT o_orderkey, o_custkey, o_custkey % 3 = 0 AS mapped, o_orderkey % 10 <> 0 AS live FROM orders)
SELECT count(DISTINCT o_custkey) FILTER (mapped)::BIGINT AS mapped, count(DISTINCT o_custkey) FILTER (NOT mapped)::BIGINT AS unmapped,
       count(*) FILTER (mapped AND live)::BIGINT AS notify FROM u""",
)
def user_tally(t: Tables) -> DataFrame:
    assigned = t.actions.select(F.col("id").alias("action_id"), F.col("o_custkey").alias("user_key"), "disposition")
    member = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey"))
    return mp.user_tally(assigned, t.customer.select(F.col("c_custkey").alias("key"), member.alias("member_id")))


@query("source_totals", with_(RECORDS, COLLECTIONS) + 'SELECT system, count(*)::BIGINT AS collections, sum(record_count)::BIGINT AS "rows" FROM collections GROUP BY system')
def source_totals(t: Tables) -> DataFrame:
    return summary.source_totals(t.collections)


@query(
    "url_hosts",
    r"""
WITH u AS (SELECT unnest(regexp_extract_all(url, '(?i)\b([a-z][a-z0-9+.-]*://[^\s"''<>)\]]+)', 1)) AS url FROM pages
  UNION ALL SELECT unnest(regexp_extract_all(html, '(?i)\b([a-z][a-z0-9+.-]*://[^\s"''<>)\]]+)', 1)) FROM pages)
SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM u
WHERE NOT regexp_matches(url, '://[^/?#:]*\.example\.org')""",
)
def url_hosts(t: Tables) -> DataFrame:
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    allowed = t.pages.select(host.alias("host")).where(F.col("host").rlike(r"\.example\.org$")).distinct()
    return quality.url_hosts(t.pages, ["url", "html"], allowed)


@query("block_stats", with_(RAW_BLOCKS) + "SELECT doc, type AS kind, count(*)::BIGINT AS blocks FROM raw_blocks GROUP BY doc, type")
def block_stats(t: Tables) -> DataFrame:
    return docs.block_stats(t.raw_blocks.withColumnRenamed("type", "kind"))


@query(
    "field_rule_outcomes",
    with_(RECORDS, COLLECTIONS, FIELDS, MAPPED_OPTIONS) + """
SELECT field_id, kind, target_kind, target_type, count(option)::BIGINT AS options,
  count(*) FILTER (target IS NULL)::BIGINT AS unmapped,
  CASE WHEN count(*) FILTER (target IS NULL) > 0 THEN 'lossy' WHEN target_kind = 'priority' THEN 'transformed' ELSE 'supported' END AS outcome
FROM mapped_options GROUP BY field_id, kind, target_kind, target_type""",
)
def field_rule_outcomes(t: Tables) -> DataFrame:
    return mp.field_rule_outcomes(mapped_options(t))
