"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import text, values
from waybill.operators import cells, findings as fnd, mapping as mp
from waybill.operators import verify as vf
from waybill.plans import summary
from workload.inputs import ITEMS, MAPPINGS, items, mappings
from workload.registry import query
from workload.tables import (
    COLLECTIONS, DESTINATION, FIELDS, FINDINGS, PAGE_TREE, PRICE_TEXT, RECORDS, SEQ, Tables, key_of, with_,
)


@query(
    "live_rows",
    "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 OR o_orderkey % 52 = 0)",
)
def live_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    flagged = t.orders.select(
        k, F.when(k % 50 == 0, F.lit(True)).alias("in_trash"), F.when(k % 51 == 0, F.lit(True)).otherwise(F.lit(False)).alias("archived"),
        F.when(k % 52 == 0, F.lit(True)).alias("is_archived"),
    )
    return cells.live_rows(flagged, "in_trash", "archived", "is_archived").select("o_orderkey")


@query(
    "cells_long",
    with_(RECORDS, COLLECTIONS, FIELDS) + f"""
SELECT key AS record, collection, 'status' AS field_id, o_orderstatus AS text, 'status' AS kind FROM records
UNION ALL SELECT key, collection, 'priority', o_orderpriority, 'select' FROM records
UNION ALL SELECT key, collection, 'price', {PRICE_TEXT}, 'number' FROM records""",
)
def cells_long(t: Tables) -> DataFrame:
    bag = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"),
        F.lit("price"), text.number_text(F.col("o_totalprice")), F.lit("undeclared"), F.lit("x"),
    )
    rows = t.records.select("key", "collection", bag.alias("values"))
    return cells.cells_long(rows, t.fields).select("record", "collection", "field_id", "text", "kind")


@query(
    "record_projection",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Untitled' WHEN 1 THEN 'Untitled' ELSE 'Order ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://h.example/' || md5(o_orderkey::VARCHAR) ELSE 'https://o.example/' || o_orderkey END AS url
FROM orders""",
)
def record_projection(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    title = (
        F.when(k % 4 == 0, F.lit("  \n ")).when(k % 4 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" Order "), k, F.lit(" ")))
    )
    url = F.when(k % 3 != 0, F.concat(F.lit("https://o.example/"), k))
    return cells.record_projection(
        t.orders.select("o_orderkey"), title, url, "https://h.example/", F.md5(k.cast("string"))
    )


@query(
    "search_terms",
    "SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'the') AND contains(lower(text || ' ' || source), 'on')",
)
def search_terms(t: Tables) -> DataFrame:
    haystack = F.concat("text", F.lit(" "), "source")
    return t.documents.where(text.matches_terms(haystack, "  The ON ")).select("doc_id")


@query(
    "filter_mappings",
    with_(RECORDS, COLLECTIONS, FIELDS, MAPPINGS) + "SELECT id FROM mappings WHERE outcome = 'lossy' AND collection = 'tpch:segment:BUILDING'",
)
def filter_mappings(t: Tables) -> DataFrame:
    found = mp.filter_mappings(mappings(t), t.collections, "tpch:segment:BUILDING", "Review building", "lossy")
    return found.select("id")


@query(
    "filter_findings",
    with_(FINDINGS) + f"SELECT {SEQ.split(', l_quantity')[0]}, code FROM findings WHERE outcome = 'lossy' AND contains(lower(message), '7') AND field = 'field_2'",
)
def filter_findings(t: Tables) -> DataFrame:
    names = t.supplier.where(F.col("s_suppkey") < 4).select(
        F.concat(F.lit("tpch:supp:"), "s_suppkey").alias("key"), F.lit("Group").alias("name")
    )
    found = fnd.filter_findings(t.findings, names, "lossy", "FIELD_2 7 group")
    return found.where(F.contains("message", F.lit("7"))).select(
        "seq.l_orderkey", "seq.l_linenumber", "seq.l_partkey", "seq.l_suppkey", "code"
    )


@query(
    "blocking_findings",
    with_(FINDINGS) + """
SELECT code, message, count(*)::BIGINT AS n FROM (SELECT code, message FROM findings WHERE severity = 'error'
UNION ALL SELECT 'PRIORITY', o_orderpriority FROM orders WHERE o_orderkey % 9 = 0) GROUP BY ALL""",
)
def blocking_findings(t: Tables) -> DataFrame:
    action_level = t.orders.select(
        F.lit("PRIORITY").alias("code"), F.col("o_orderpriority").alias("message"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("error")).otherwise(F.lit("info")).alias("severity"),
    )
    both = fnd.blocking_findings(t.findings.select("code", "message", "severity"), action_level)
    return both.groupBy("code", "message").agg(F.count("*").alias("n"))


@query(
    "plan_issues",
    with_(FINDINGS) + "SELECT severity AS issue, code, count(*)::BIGINT AS n FROM findings GROUP BY ALL",
)
def plan_issues(t: Tables) -> DataFrame:
    return fnd.plan_issues(t.findings).groupBy("issue", "code").agg(F.count("*").alias("n"))


@query(
    "attention_filter",
    with_(FINDINGS) + """
SELECT entity, code, severity, outcome, category, message FROM findings WHERE severity <> 'info' AND
 (severity = 'error' OR outcome IN ('supported', 'skipped') OR category IN ('destination', 'scope', 'permission'))""",
)
def attention_filter(t: Tables) -> DataFrame:
    return fnd.attention_filter(t.findings).select("entity", "code", "severity", "outcome", "category", "message")


@query(
    "non_verified_items",
    with_(DESTINATION, ITEMS) + """
SELECT action_id, 'Create task ' || seq AS label, status, failing FROM items WHERE status <> 'verified'""",
)
def non_verified_items(t: Tables) -> DataFrame:
    found = vf.non_verified_items(items(t), t.actions)
    names = F.array_join(F.transform("failing", lambda c: c["field"]), ",")
    return found.select("action_id", "label", "status", names.alias("failing"))


def array_cells(t: Tables) -> DataFrame:
    """Each order as one array cell of zero to forty entries."""
    k = F.col("o_orderkey")
    kind = vocab.lookup(k % 4, {0: "relation", 1: "people", 2: "rich_text", 3: "select"})
    entries = F.array_repeat(F.col("o_orderpriority"), (k % 41).cast("int"))
    return t.orders.select(
        k.alias("record"), F.lit("lines").alias("field_id"), kind.alias("source_type"),
        entries.alias("items"), (k % 5 == 0).alias("has_more"),
    )


ARRAY_CELLS = """arrays AS (
  SELECT o_orderkey AS record, ['relation', 'people', 'rich_text', 'select'][o_orderkey % 4 + 1] AS source_type,
    o_orderkey % 41 AS n, o_orderkey % 5 = 0 AS has_more FROM orders)"""


@query(
    "truncated_values",
    with_(ARRAY_CELLS) + """
SELECT record, source_type FROM arrays WHERE (source_type <> 'select' AND n >= 25) OR (source_type = 'relation' AND has_more)""",
)
def truncated_values(t: Tables) -> DataFrame:
    return cells.truncated_values(array_cells(t)).select("record", "source_type")


@query(
    "overlay_full_items",
    with_(ARRAY_CELLS) + """
SELECT record, source_type, CASE WHEN record % 2 = 0 THEN n + 1 ELSE n END::INT AS n,
       source_type = 'relation' AND has_more AND record % 2 <> 0 AS truncated FROM arrays""",
)
def overlay_full_items(t: Tables) -> DataFrame:
    partial = array_cells(t)
    full = partial.where(F.col("record") % 2 == 0).select(
        "record", "field_id", F.array_append("items", F.lit("last")).alias("items")
    )
    done = cells.overlay_full_items(partial, full)
    return done.select("record", "source_type", F.size("items").alias("n"), "truncated")


@query(
    "validate_payloads",
    """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 6 = 0 THEN 'list_id' END, CASE WHEN o_orderkey % 10 = 0 THEN 'body.name' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'body.priority' END, CASE WHEN o_orderkey % 9 = 0 THEN 'body.assignees' END], lambda x: x IS NOT NULL), ',') AS failing,
  NOT (o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0) AS valid FROM orders""",
)
def validate_payloads(t: Tables) -> DataFrame:
    return cells.validate_payloads(payloads(t), cells.task_payload_rules()).select(
        "o_orderkey", F.array_join("failing", ",").alias("failing"), "valid"
    )


def payloads(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.when(k % 6 == 0, F.lit("../list")).otherwise(F.concat(F.lit("list_"), "o_orderstatus")).alias("list_id"),
        F.lit(None).cast("string").alias("marker"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("Order "), k)).alias("name"),
        F.col("o_orderpriority").alias("markdown"), F.lit(None).cast("string").alias("status"),
        F.when(k % 7 == 0, F.lit(9)).when(k % 2 == 0, F.lit(3)).alias("priority"),
        F.when(k % 9 == 0, F.array(F.lit(-1), F.lit(5))).otherwise(F.array(F.lit(5))).alias("assignees"),
        F.array(F.lit("tag")).alias("tags"),
    )


@query(
    "validate_state_document",
    """
WITH d AS (SELECT event_id, event_id % 7 AS s FROM events)
SELECT event_id, CASE s WHEN 1 THEN 'state.schemaVersion must be 1' WHEN 2 THEN 'state.mode is not allowed'
  WHEN 3 THEN 'state.plan.planId is missing' WHEN 4 THEN 'state.run.counts.pending must be a number'
  WHEN 5 THEN 'state.plan is null although state.mode is not "empty"' END AS problem FROM d""",
)
def validate_state_document(t: Tables) -> DataFrame:
    from waybill.sources.documents import state_document_problem

    shape = F.col("event_id") % 7
    counts = F.when(shape == 4, F.lit('"many"')).otherwise(F.get_json_object("props", "$.k"))
    plan = (
        F.when(shape == 3, F.lit('{"hash":"h"}')).when(shape == 5, F.lit("null"))
        .otherwise(F.concat(F.lit('{"planId":"plan_'), "event_id", F.lit('","hash":"h"}')))
    )
    document = F.concat(
        F.lit('{"schemaVersion":'), F.when(shape == 1, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"generatedAt":"2024","mode":"'), F.when(shape == 2, F.lit("odd")).otherwise(F.lit("live")),
        F.lit('","plan":'), plan, F.lit(',"run":{"runId":"r","status":"'), "event_type",
        F.lit('","counts":{"pending":'), counts, F.lit('}},"events":[]}'),
    )
    return state_document_problem(t.events.select("event_id", document.alias("doc")), "doc").select("event_id", "problem")


@query(
    "mapping_config_errors",
    with_(RECORDS, COLLECTIONS) + """
SELECT key AS collection, x.* FROM collections CROSS JOIN (VALUES
  ('Nope', 'MAPPING_UNKNOWN_FIELD', 'error'), ('Total price', 'MAPPING_INCOMPATIBLE', 'error')) x(field, code, severity)""",
)
def mapping_config_errors(t: Tables) -> DataFrame:
    entry = lambda n, to: F.struct(F.lit(n).alias("name"), F.lit(to).alias("to"))
    stated = F.array(
        entry("Nope", "status"), entry("Total price", "status"), entry("Priority", "priority"), entry("Order date", "due_date"),
        entry("Status", "skip"),
    )
    config = t.collections.select(F.col("key").alias("collection"), F.inline(stated))
    return mp.mapping_config_errors(t.fields, config)


def dropping_rules(t: Tables) -> DataFrame:
    fid = F.col("field_id")
    return mappings(t).withColumn(
        "target_kind", F.when(fid.isin("status", "priority"), F.lit("dropped")).otherwise(F.lit("description_table"))
    )


@query(
    "skipped_value_findings",
    with_(RECORDS) + """
SELECT 'FIELD_EXPLICITLY_SKIPPED' AS code, 'skipped' AS outcome, 'info' AS severity, key AS entity, collection, 'Priority' AS field FROM records
UNION ALL SELECT 'FIELD_DROPPED', 'unsupported', 'warning', key, collection, 'Status' FROM records WHERE o_orderstatus <> 'P'""",
)
def skipped_value_findings(t: Tables) -> DataFrame:
    present = F.col("text").isNotNull() & (F.col("text") != "P")
    return cells.skipped_value_findings(t.cells, dropping_rules(t), present)


@query(
    "text_fallback_rows",
    with_(RECORDS) + f"""
SELECT key AS record, 'Order date' AS label, 2 AS pos, created_at AS markdown, 'FIELD_PRESERVED_AS_TEXT' AS code, 'transformed' AS outcome FROM records
UNION ALL SELECT key, 'Total price', 3, {PRICE_TEXT}, 'FIELD_PRESERVED_AS_TEXT', 'transformed' FROM records""",
)
def text_fallback_rows(t: Tables) -> DataFrame:
    return cells.text_fallback_rows(t.cells, dropping_rules(t), F.col("text")).select(
        "record", "label", "pos", "markdown", "code", "outcome"
    )


@query(
    "custom_field_values",
    with_(RECORDS) + f"""
SELECT key AS record, 'priority' AS field_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'opt_a' WHEN '2-HIGH' THEN 'opt_b' END AS value,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'OPTION_VALUE_UNMAPPED' END AS code FROM records
UNION ALL SELECT key, 'price', {PRICE_TEXT}, NULL FROM records
UNION ALL SELECT key, 'ordered', (epoch_ms(o_orderdate) + 14400000)::VARCHAR, NULL FROM records""",
)
def custom_field_values(t: Tables) -> DataFrame:
    option = lambda i, c: F.struct(F.lit(i).alias("id"), F.lit(c).alias("canon"))
    chosen = F.array(option("opt_a", "1 urgent"), option("opt_b", "2 high"))
    fid = F.col("field_id")
    targets = t.fields.where(fid != "status").select(
        "collection", "field_id", F.concat(F.lit("cf_"), fid).alias("target_id"),
        vocab.lookup(fid, {"priority": "drop_down", "price": "number", "ordered": "date"}).alias("target_type"),
        chosen.alias("options"),
    )
    plain = t.cells.withColumn("plain", F.col("text"))
    return cells.custom_field_values(plain, targets, "UTC").select("record", "field_id", "value", "code")


@query(
    "source_feature_findings",
    with_(PAGE_TREE) + """
SELECT 'PAGE_BODY_INACCESSIBLE' AS code, 'unsupported' AS outcome, 'warning' AS severity, 'permission' AS category, key AS entity, NULL AS field FROM page_tree WHERE pos % 9 = 4
UNION ALL SELECT 'PAGE_ICON_NOT_MIGRATED', 'unsupported', 'info', 'source_feature', key, NULL FROM page_tree WHERE pos % 4 = 0
UNION ALL SELECT 'PAGE_COVER_NOT_MIGRATED', 'unsupported', 'info', 'source_feature', key, NULL FROM page_tree WHERE pos % 6 = 1
UNION ALL SELECT 'SOURCE_FIELD_UNREADABLE', 'unsupported', 'warning', 'field_type', NULL, n_name FROM nation
UNION ALL SELECT 'PROPERTY_VALUE_MALFORMED', 'unsupported', 'warning', 'data', 'tpch:order:' || o_orderkey, 'Total price' FROM orders WHERE o_orderkey % 8 = 0""",
)
def source_feature_findings(t: Tables) -> DataFrame:
    pos = F.col("pos")
    documents = t.page_tree.select(
        "key", F.lit(None).cast("string").alias("collection"),
        F.when(pos % 9 == 4, F.lit("inaccessible")).otherwise(F.lit("ok")).alias("body_status"),
        (pos % 4 == 0).alias("has_icon"), (pos % 6 == 1).alias("has_cover"),
    )
    fields = t.nation.select(
        F.lit("tpch:nations").alias("collection"), F.col("n_name").alias("name"), F.lit("unsupported").alias("kind")
    )
    read = t.orders.select(
        key_of("order", "o_orderkey").alias("record"), F.lit("c").alias("collection"),
        F.lit("Total price").alias("field_name"), (F.col("o_orderkey") % 8 == 0).alias("malformed"),
    )
    return cells.source_feature_findings(documents, fields, read).drop("collection", "message")


@query(
    "plan_advisories",
    """
WITH n AS (SELECT count(*) FILTER (o_orderkey % 3 = 0) AS m, count(*) FILTER (o_orderkey % 10 <> 0) * 2 AS a FROM orders),
d AS (SELECT count(*) AS docs FROM documents)
SELECT 'PROVENANCE_DISABLED' AS code, m::BIGINT AS n, 'supported' AS outcome, 'destination' AS category FROM n
UNION ALL SELECT 'ASSIGNEES_WILL_BE_NOTIFIED', a::BIGINT, 'supported', 'user_mapping' FROM n
UNION ALL SELECT 'DOCS_EXPERIMENTAL_DISABLED', docs::BIGINT, 'skipped', 'scope' FROM d""",
)
def plan_advisories(t: Tables) -> DataFrame:
    actions = t.actions.select(
        F.when(F.col("seq") % 3 != 0, F.col("source")).alias("marker"), F.lit(2).alias("assignees"), "disposition"
    )
    return summary.plan_advisories(actions, t.documents.select(F.col("doc_id").alias("key")))
