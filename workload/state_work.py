"""Run state, the id map, plan identity, redaction and leak scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import secrets
from waybill.operators import needles, quality, state
from waybill.plans import report, seal
from workload.functions_work import CANONICAL_ORDER_SQL, canonical_order
from workload.inputs import CHECKPOINTS, TRANSITIONS, checkpoints, items, transitions
from workload.joins_work import REPORT_ITEMS, report_items_of
from workload.registry import query
from workload.tables import ACTIONS, DESTINATION, Tables, with_


def adopted_actions(t: Tables) -> DataFrame:
    prior = F.when(F.col("seq") % 20 == 0, F.concat(F.lit("dst-"), "seq"))
    return t.actions.withColumn("existing_destination_id", prior)


@query(
    "new_run_rows",
    with_(ACTIONS) + """
SELECT 'checkpoint' AS "table", id AS key, disposition = 'skip' AS skipped, CASE WHEN seq % 20 = 0 THEN 'dst-' || seq END AS destination_id FROM actions
UNION ALL SELECT 'id_map', source, true, 'dst-' || seq FROM actions WHERE seq % 20 = 0 AND seq % 60 <> 0""",
)
def new_run_rows(t: Tables) -> DataFrame:
    actions = adopted_actions(t)
    known = t.id_map.join(
        t.actions.where(F.col("seq") % 60 == 0).select(F.col("idempotency_key").alias("source_key")), "source_key", "left_semi"
    ).select("source_key", "scope")
    rows = state.new_run_rows(actions, "run_1").select(
        F.lit("checkpoint").alias("table"), F.col("action_id").alias("key"), (F.col("status") == "skipped").alias("skipped"), "destination_id"
    )
    added = state.adopted_mappings(actions, known).select(
        F.lit("id_map").alias("table"), F.col("source_key").alias("key"), F.lit(True).alias("skipped"), "destination_id"
    )
    return rows.unionByName(added)


@query(
    "fold_checkpoints",
    with_(TRANSITIONS) + """
, m AS (SELECT run_id, action_id, min(seq) FILTER (event = 'succeeded') AS done, max(seq) FILTER (event = 'pending') AS reset,
    arg_max(event, seq) AS last, arg_max(destination_id, seq) FILTER (event = 'succeeded') AS dest FROM transitions GROUP BY run_id, action_id)
SELECT t.run_id, t.action_id, CASE WHEN m.done IS NOT NULL THEN 'succeeded' ELSE m.last END AS status,
  count(*) FILTER (event = 'in_flight' AND (done IS NULL OR seq < done))::BIGINT AS attempts, any_value(m.dest) AS destination_id,
  min(ts) FILTER (event = 'in_flight' AND done IS NULL AND (reset IS NULL OR seq > reset)) AS in_flight_since,
  arg_max(error_code, seq) FILTER (event = 'failed' AND done IS NULL AND (reset IS NULL OR seq > reset)) AS last_error_code
FROM transitions t JOIN m USING (run_id, action_id) GROUP BY t.run_id, t.action_id, m.done, m.last""",
)
def fold_checkpoints(t: Tables) -> DataFrame:
    return state.fold_checkpoints(transitions(t))


@query(
    "resume_states",
    with_(ACTIONS, CHECKPOINTS) + """
SELECT action_id, CASE status WHEN 'in_flight' THEN 'ambiguous' WHEN 'failed' THEN 'pending' WHEN 'blocked' THEN 'pending' ELSE status END AS status FROM checkpoints""",
)
def resume_states(t: Tables) -> DataFrame:
    return state.resume_states(checkpoints(t)).select("action_id", "status")


@query(
    "id_map_upsert",
    """
SELECT 'tpch:order:' || o_orderkey AS source_key, CASE WHEN o_orderkey % 30 = 0 THEN 'conflict' WHEN o_orderkey % 10 = 0 THEN 'same' ELSE 'insert' END AS result
FROM orders""",
)
def id_map_upsert(t: Tables) -> DataFrame:
    k = F.col("seq")
    new = t.actions.select(
        F.col("idempotency_key").alias("source_key"), "scope",
        F.when(k % 30 == 0, F.lit("dst-other")).otherwise(F.concat(F.lit("dst-"), k)).alias("destination_id"),
    )
    return state.id_map_upsert(new, t.id_map).select("source_key", "result")


@query(
    "assume_not_created",
    with_(ACTIONS, CHECKPOINTS) + "SELECT action_id, CASE WHEN status = 'ambiguous' AND seq % 2 = 0 THEN 'pending' ELSE status END AS status FROM checkpoints",
)
def assume_not_created(t: Tables) -> DataFrame:
    listed = t.actions.where(F.col("seq") % 2 == 0).select(F.col("id").alias("action_id"))
    return state.assume_not_created(checkpoints(t), listed).select("action_id", "status")


# -- plan identity -----------------------------------------------------------------------------------------
def fold_sql(name: str, row: str, source: str) -> str:
    return f"""{name}_r AS (SELECT sha256({row}) AS h FROM {source}),
{name}_n AS (SELECT h, h || 'x' || count(*) AS m FROM {name}_r GROUP BY h),
{name}_l AS (SELECT left(h, 6) AS b, sha256(string_agg(m, '' ORDER BY m)) AS h FROM {name}_n GROUP BY left(h, 6)),
{name}_m AS (SELECT left(b, 3) AS b, sha256(string_agg(b || ':' || h, '' ORDER BY b || ':' || h)) AS h FROM {name}_l GROUP BY left(b, 3)),
{name}_t AS (SELECT '{name}=' || sha256(string_agg(b || ':' || h, '' ORDER BY b || ':' || h)) AS t FROM {name}_m)"""


def plan_tables(t: Tables) -> list[DataFrame]:
    line = F.concat_ws("|", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"))
    return [
        seal.table_hash(t.spread("orders"), canonical_order(), "orders"),
        seal.table_hash(t.spread("lineitem"), line, "lines"),
    ]


SEAL = f"""
WITH {fold_sql("orders", CANONICAL_ORDER_SQL, "orders")},
{fold_sql("lines", "l_orderkey || '|' || l_partkey || '|' || l_linenumber", "lineitem")},
s AS (SELECT sha256(string_agg(t, '|' ORDER BY t)) AS hash FROM (SELECT t FROM orders_t UNION ALL SELECT t FROM lines_t))"""


@query("seal_plan", SEAL + " SELECT 'plan_' || left(hash, 12) AS plan_id, hash FROM s")
def seal_plan(t: Tables) -> DataFrame:
    return seal.seal_plan(plan_tables(t))


@query("verify_integrity", SEAL + " SELECT 'plan_' || left(hash, 12) AS plan_id, true AS hash_ok, true AS id_ok, true AS intact FROM s")
def verify_integrity(t: Tables) -> DataFrame:
    # The recorded seal is taken over the same rows in another order and partitioning.
    shuffled = [
        seal.table_hash(t.orders.repartition(5, "o_custkey"), canonical_order(), "orders"),
        seal.table_hash(
            t.lineitem.repartition(3), F.concat_ws("|", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")), "lines"
        ),
    ]
    return seal.verify_integrity(seal.seal_plan(shuffled), plan_tables(t))


@query("check_deterministic", SEAL + " SELECT 'plan is deterministic' AS \"check\", true AS ok, 1::BIGINT AS hashes FROM s")
def check_deterministic(t: Tables) -> DataFrame:
    again = seal.seal_plan(list(reversed(plan_tables(t))))
    hashes = seal.seal_plan(plan_tables(t)).unionByName(again).agg(F.count_distinct("hash").alias("hashes"))
    return hashes.select(F.lit("plan is deterministic").alias("check"), (F.col("hashes") == 1).alias("ok"), "hashes")


# -- redaction ----------------------------------------------------------------------------------------------
@query(
    "redact_report",
    with_(ACTIONS, CHECKPOINTS, REPORT_ITEMS) + """
SELECT action_id, '[item:' || left(sha256(action_id), 8) || ']' AS label, 'tpch:order:' || left(sha256(substr(source, 12)), 12) AS source, status, outcome,
  'dst-' || left(sha256(destination_id), 8) AS destination_id, split_part(error, ':', 1) AS error FROM report_items""",
)
def redact_report(t: Tables) -> DataFrame:
    return report.redact_items(report_items_of(t))


@query(
    "redact_verification",
    with_(DESTINATION) + """
SELECT 'act_' || o_orderkey AS action_id, 'tpch:order:' || left(sha256(o_orderkey::VARCHAR), 12) AS source,
  'dst-' || left(sha256('dst-' || o_orderkey), 8) AS destination_id, CASE WHEN d.destination_id IS NULL THEN 1 ELSE 4 END AS checks,
  0 AS shown
FROM orders LEFT JOIN destination d ON d.destination_id = 'dst-' || o_orderkey""",
)
def redact_verification(t: Tables) -> DataFrame:
    bare = report.redact_verification(items(t))
    # Nothing but the field and the status of a check is left; what was expected or found must not show.
    parts = [f.name for f in bare.schema["checks"].dataType.elementType.fields]
    secret = [c for c in ("expected", "actual", "note") if c in parts]
    shown = F.filter("checks", lambda c: F.coalesce(*[c[n] for n in secret], F.lit(None).cast("string")).isNotNull())
    return bare.select(
        "action_id", "source", "destination_id", F.size("checks").alias("checks"), F.size(shown).alias("shown")
    )


def leaky_documents(t: Tables) -> DataFrame:
    tag = F.md5(F.col("doc_id").cast("string"))
    shape = F.col("doc_id") % 8
    planted = (
        F.when(shape == 1, F.concat(F.lit(" sk-"), tag)).when(shape == 2, F.concat(F.lit(" Authorization: Bearer "), tag))
        .when(shape == 3, F.lit(" at /home/me/x")).when(shape == 4, F.lit(" by robin.")).when(shape == 5, F.lit(" by robins."))
        .otherwise(F.lit(""))
    )
    return t.spread("documents").select("doc_id", F.concat("text", planted).alias("text"), "source")


@query(
    "leak_scan",
    """
SELECT doc_id, 'text' AS path, 'API key' AS leak FROM documents WHERE doc_id % 8 = 1
UNION ALL SELECT doc_id, 'text', 'bearer credential' FROM documents WHERE doc_id % 8 = 2
UNION ALL SELECT doc_id, 'text', 'Authorization header' FROM documents WHERE doc_id % 8 = 2
UNION ALL SELECT doc_id, 'text', 'home folder' FROM documents WHERE doc_id % 8 = 3
UNION ALL SELECT doc_id, 'text', 'person' FROM documents WHERE doc_id % 8 = 4""",
)
def leak_scan(t: Tables) -> DataFrame:
    return quality.leak_scan(leaky_documents(t), ["doc_id"], {"robin": "person"}, {"/home/me": "home folder"})


# One place on a machine per shape, and near misses.
PLACES = {
    1: " at /Users/robin/x", 2: " in /home/", 3: " /private/y", 4: " /var/folders/z", 5: " (/tmp/a", 6: " /root", 7: " C:/x",
    8: r" \\host.x\share", 9: " FILE://x", 10: " ~/x", 11: " x/tmp/a", 12: " /rooted", 13: " abC:/x", 14: r" \host\x", 15: " a~/x",
}


def placed_documents(t: Tables) -> DataFrame:
    planted = F.lit("")
    for shape, text in PLACES.items():
        planted = F.when(F.col("doc_id") % 17 == shape, F.lit(text)).otherwise(planted)
    return t.spread("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))


@query(
    "leak_paths",
    "WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 17 "
    + " ".join(f"WHEN {shape} THEN '{text}'" for shape, text in PLACES.items())
    + " ELSE '' END AS text FROM documents), r(leak, pattern) AS (VALUES "
    + ", ".join(f"('{what}', '{pattern}')" for what, pattern in secrets.MACHINE_PATHS.items())
    + ") SELECT doc_id, 'text' AS path, leak FROM d, r WHERE regexp_matches(text, pattern)",
)
def leak_paths(t: Tables) -> DataFrame:
    return quality.leak_scan(placed_documents(t), ["doc_id"], rules=secrets.MACHINE_PATHS)


@query(
    "leak_needles",
    """
WITH d AS (SELECT doc_id, source, coalesce(text, '') || ' for Customer#' || lpad((doc_id % 2000)::VARCHAR, 9, '0')
  || CASE WHEN doc_id % 3 = 0 THEN '7' ELSE '.' END AS text FROM documents),
n AS (SELECT c_name AS needle, 'customer in ' || c_mktsegment AS what, true AS word FROM customer
  UNION ALL SELECT lower(n_name), 'country', true FROM nation UNION ALL SELECT source, 'source', false FROM documents),
u AS (SELECT DISTINCT * FROM n WHERE needle <> ''),
l AS (SELECT doc_id, 'text' AS path, text FROM d UNION ALL SELECT doc_id, 'source', source FROM d)
SELECT DISTINCT doc_id, path, what AS leak FROM l JOIN u ON contains(text, needle)
WHERE NOT word OR regexp_matches(text, '(^|[^A-Za-z0-9])' || needle || '($|[^A-Za-z0-9])')""",
)
def leak_needles(t: Tables) -> DataFrame:
    number = F.lpad((F.col("doc_id") % 2000).cast("string"), 9, "0")
    end = F.when(F.col("doc_id") % 3 == 0, F.lit("7")).otherwise(F.lit("."))
    docs = t.spread("documents").select(
        "doc_id", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(" for Customer#"), number, end).alias("text")
    )
    names = t.customer.select(F.col("c_name").alias("needle"), F.concat(F.lit("customer in "), "c_mktsegment").alias("what"))
    countries = t.nation.select(F.lower("n_name").alias("needle"), F.lit("country").alias("what"))
    sources = t.documents.select(F.col("source").alias("needle"), F.lit("source").alias("what")).distinct()
    wanted = names.union(countries).withColumn("word", F.lit(True)).union(sources.withColumn("word", F.lit(False)))
    return needles.needle_scan(docs, ["doc_id"], wanted)
