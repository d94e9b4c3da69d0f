"""Order-dependent operators along the run log, per group, and inside conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import dates, text
from waybill.operators import cells, findings as fnd, graph, mapping as mp, ordered, runlog, state
from workload.registry import query
from workload.tables import COLLECTIONS, FINDINGS, LOG, PAGE_TREE, RECORDS, SEQ, Tables, with_

WIDTH = 1024  # events per chunk here; a cluster keeps the default of a million


@query(
    "first_owner",
    """SELECT 'cust:' || o_custkey AS entity, 'act_' || min(o_orderkey) AS owner FROM orders GROUP BY o_custkey""",
)
def first_owner(t: Tables) -> DataFrame:
    return fnd.first_owner(
        t.actions.select("id", "seq", F.concat(F.lit("cust:"), "o_custkey").alias("source"))
    )


@query(
    "claim_targets",
    with_(RECORDS, COLLECTIONS) + """
, f AS (SELECT key AS collection, x.* FROM collections CROSS JOIN (VALUES
  ('f0', 'status', 'Due date', false, false), ('f1', 'due_date', 'd', true, false), ('f2', 'start_date', 'Start', false, false),
  ('f3', NULL, 'Start/end', false, false), ('f4', 'assignees', 'Owner', false, false), ('f5', NULL, 'Lead', false, false),
  ('f6', 'priority', 'x', true, false), ('f7', 'priority', 'y', true, true), ('f8', NULL, 'Prio', false, false)) x(field_id, target, n, explicit, conflict))
SELECT collection, field_id, target, explicit, conflict FROM f""",
)
def claim_targets(t: Tables) -> DataFrame:
    """Nine declared fields per collection: two explicit claims on one target, rivals, a fallback."""
    row = lambda i, kind, name, to=None: F.struct(
        F.lit(f"f{i}").alias("field_id"), F.lit(kind).alias("kind"), F.lit(name).alias("name"),
        F.lit(i).alias("pos"), F.lit(to).cast("string").alias("explicit_to"),
    )
    declared = F.array(
        row(0, "status", "Due date"), row(1, "date", "When", "due_date"), row(2, "date", "Start"),
        row(3, "date", "Start/end"), row(4, "person", "Owner"), row(5, "person", "Lead"),
        row(6, "select", "Urgency", "priority"), row(7, "select", "Rank", "priority"), row(8, "select", "Prio"),
    )
    fields = t.collections.select(F.col("key").alias("collection"), F.inline(declared))
    return mp.claim_targets(fields).select("collection", "field_id", "target", "explicit", "conflict")


@query(
    "limit_per_group",
    with_(FINDINGS) + """
, agg AS (SELECT code, outcome, field, sum(coalesce(count, 1))::BIGINT AS count FROM findings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY count DESC, code, coalesce(field, '')) AS rn,
             count(*) OVER (PARTITION BY outcome) AS n FROM agg)
SELECT outcome, code, field, count, greatest(n - 8, 0)::BIGINT AS hidden FROM r WHERE rn <= 8""",
)
def limit_per_group(t: Tables) -> DataFrame:
    return fnd.limit_per_group(fnd.aggregate_findings(t.findings), 8).select(
        "outcome", "code", "field", "count", "hidden"
    )


@query(
    "merge_findings",
    with_(FINDINGS) + f"""
, u AS (SELECT *, CASE WHEN outcome IN ('lossy', 'unsupported') THEN 0 ELSE 1 END AS l FROM findings),
r AS (SELECT *, row_number() OVER (PARTITION BY code, outcome, severity, collection, field, message ORDER BY l, {SEQ}) AS rn FROM u)
SELECT code, outcome, severity, collection, field, message, entity, category, count FROM r WHERE rn = 1""",
)
def merge_findings(t: Tables) -> DataFrame:
    lost = t.findings.where(F.col("outcome").isin("lossy", "unsupported"))
    return fnd.merge_findings(lost, t.findings).drop("seq")


@query(
    "running_written",
    with_(LOG) + "SELECT id, run_id, count(*) FILTER (type = 'action_succeeded') OVER (PARTITION BY run_id ORDER BY id)::BIGINT AS written FROM log",
)
def running_written(t: Tables) -> DataFrame:
    return runlog.running_written(t.log.select("id", "run_id", "type"), WIDTH).select("id", "run_id", "written")


@query(
    "last_milestone",
    with_(LOG) + "SELECT id, run_id, coalesce(max(id) FILTER (type = 'approved') OVER (PARTITION BY run_id ORDER BY id), -1)::BIGINT AS milestone_id FROM log",
)
def last_milestone(t: Tables) -> DataFrame:
    return runlog.last_milestone(t.log.select("id", "run_id", "type"), WIDTH).select("id", "run_id", "milestone_id")


@query(
    "numbered_runs",
    """
WITH c AS (SELECT conv_id, turn, turn % 3 <> 0 AS numbered FROM conversations),
g AS (SELECT *, count(*) FILTER (NOT numbered) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM c)
SELECT conv_id, turn, CASE WHEN numbered THEN count(*) FILTER (numbered) OVER (PARTITION BY conv_id, g ORDER BY turn) ELSE 0 END::BIGINT AS ordinal FROM g""",
)
def numbered_runs(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn")
    return ordered.numbered_runs(rows, ["conv_id"], "turn", F.col("turn") % 3 != 0, width=4)


FAILURES_CTE = """
, c AS (SELECT *, count(*) FILTER (type = 'action_succeeded') OVER (PARTITION BY run_id ORDER BY id) AS g FROM log),
f AS (SELECT id, run_id, type, count(*) FILTER (type = 'action_failed') OVER (PARTITION BY run_id, g ORDER BY id)::BIGINT AS failures FROM c)"""


@query(
    "consecutive_failures",
    with_(LOG) + FAILURES_CTE + "SELECT id, run_id, failures, type = 'action_failed' AND failures >= 5 AS tripped FROM f",
)
def consecutive_failures(t: Tables) -> DataFrame:
    return runlog.consecutive_failures(t.log.select("id", "run_id", "type"), WIDTH).select(
        "id", "run_id", "failures", "tripped"
    )


@query(
    "merge_adjacent_spans",
    """
WITH c AS (SELECT *, CASE WHEN turn % 4 < 2 THEN 'plain' ELSE role END AS style FROM conversations),
l AS (SELECT *, CASE WHEN lag(style) OVER w IS NOT DISTINCT FROM style THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM l)
SELECT conv_id, island, style, md5(string_agg(text, '' ORDER BY turn)) AS md5 FROM i GROUP BY conv_id, island, style""",
)
def merge_adjacent_spans(t: Tables) -> DataFrame:
    style = F.when(F.col("turn") % 4 < 2, F.lit("plain")).otherwise(F.col("role"))
    rows = t.conversations.select("conv_id", "turn", style.alias("style"), "text")
    merged = ordered.merge_adjacent(rows, ["conv_id"], "turn", ["style"], "text", width=4)
    return merged.select("conv_id", "island", "style", F.md5("text").alias("md5"))


@query(
    "latest_run",
    with_(LOG) + """
SELECT run_id, arg_max(id, (floor(value)::BIGINT, id)) AS id, arg_max(type, (floor(value)::BIGINT, id)) AS type FROM log GROUP BY run_id""",
)
def latest_run(t: Tables) -> DataFrame:
    runs = t.log.select("run_id", "id", "type", F.floor("value").alias("approved_at"), F.col("id").alias("seq"))
    return state.latest_run(runs, ["run_id"], ["id", "type"])


@query(
    "sibling_order",
    with_(PAGE_TREE) + """
, m AS (SELECT key, parent, title, CASE WHEN pos % 3 = 0 THEN 1000000 - pos END AS mention FROM page_tree WHERE parent IS NOT NULL)
SELECT key, parent, row_number() OVER (PARTITION BY parent ORDER BY coalesce(mention, 4611686018427387904), title, key)::BIGINT AS ordinal FROM m""",
)
def sibling_order(t: Tables) -> DataFrame:
    children = t.page_tree.where(F.col("parent").isNotNull())
    mentions = children.where(F.col("pos") % 3 == 0).select("parent", "key", (1_000_000 - F.col("pos")).alias("pos"))
    return graph.sibling_order(children.select("key", "parent", "title"), mentions).select("key", "parent", "ordinal")


@query(
    "first_difference",
    """
WITH d AS (SELECT doc_id, text AS a, replace(text, chr(10) || 'E', chr(10) || chr(10) || 'X') AS b FROM documents),
s AS (SELECT doc_id, string_split(a, chr(10)) AS e, string_split(b, chr(10)) AS g FROM d),
p AS (SELECT *, list_filter(range(1, len(e) + 1), lambda i: e[i] IS DISTINCT FROM g[i]) AS diffs FROM s),
q AS (SELECT *, coalesce(diffs[1], least(len(e), len(g)) + 1) AS line FROM p)
SELECT doc_id, line::BIGINT AS line,
  md5(coalesce(list_filter(e[line:], lambda x: trim(x) <> '')[1], '(end of text)')) AS expected_md5,
  md5(coalesce(list_filter(g[line:], lambda x: trim(x) <> '')[1], '(end of text)')) AS actual_md5 FROM q""",
)
def first_difference(t: Tables) -> DataFrame:
    changed = F.replace("text", F.lit("\nE"), F.lit("\n\nX"))
    found = text.with_first_difference(t.spread("documents"), F.col("text"), changed, "d")
    return found.select(
        "doc_id", "d.line", F.md5("d.expected").alias("expected_md5"), F.md5("d.actual").alias("actual_md5")
    )


@query(
    "date_conflicts",
    """
WITH b AS (SELECT o_orderkey, o_orderkey % 2 AS order_, epoch_ms(o_orderdate) AS ms, o_orderkey % 3 = 0 AS dr, o_orderkey % 5 = 0 AS sr,
                  o_orderkey % 7 = 0 AS no_start FROM orders)
SELECT o_orderkey AS record,
  CASE WHEN dr THEN ms + 86400000 ELSE ms END AS due_ms,
  CASE WHEN NOT no_start THEN ms + 1000 WHEN dr THEN ms END AS start_ms,
  CASE WHEN no_start THEN NULL WHEN dr AND order_ = 1 THEN 'DATE_RANGE_START_LOST'
       WHEN sr AND order_ = 0 THEN 'DATE_RANGE_END_LOST' END AS lost FROM b""",
)
def date_conflicts(t: Tables) -> DataFrame:
    """A due-date and a start-date field per order; either may be a range, either may come first."""
    k = F.col("o_orderkey")
    ms = dates.epoch_ms(F.col("o_orderdate"))
    cell = lambda target, pos, start, end: F.struct(
        F.lit(target).alias("target"), pos.alias("pos"), start.alias("start_ms"), end.alias("end_ms")
    )
    none = F.lit(None).cast("bigint")
    due = cell("due_date", k % 2, ms, F.when(k % 3 == 0, ms + 86_400_000))
    start = cell("start_date", F.lit(1).cast("bigint") - k % 2, ms + 1000, F.when(k % 5 == 0, ms + 5000).otherwise(none))
    both = F.array_compact(F.array(due, F.when(k % 7 != 0, start)))
    return mp.date_slots(t.orders.select(k.alias("record"), F.inline(both)))


@query(
    "dedupe_users",
    """
WITH s AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'name ' || o_orderkey END AS name, o_orderkey AS seq FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name = '', seq) AS rn FROM s)
SELECT id, name, seq FROM r WHERE rn = 1""",
)
def dedupe_users(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("name "), "o_orderkey"))
    seen = t.orders.select(F.col("o_custkey").alias("id"), name.alias("name"), F.col("o_orderkey").alias("seq"))
    return cells.dedupe_users(seen)
