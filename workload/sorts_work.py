"""Orders, top rows, clipped texts, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import text
from waybill.operators import cells, findings as fnd, mapping as mp, ordered, runlog
from waybill.operators import verify as vf
from waybill.plans import build
from workload.aggregates_work import AGGREGATE, RANK
from workload.inputs import ITEMS, OPTIONS, items, options
from workload.registry import query
from workload.tables import COLLECTIONS, DESTINATION, FIELDS, FINDINGS, LOG, RECORDS, Tables, with_


@query(
    "order_inventory",
    with_(FINDINGS, AGGREGATE) + f"""
SELECT code, outcome, field, count, row_number() OVER (ORDER BY {RANK} DESC, count DESC, code, coalesce(field, ''))::INT AS place
FROM agg WHERE outcome IN ('transformed', 'lossy', 'unsupported')""",
)
def order_inventory(t: Tables) -> DataFrame:
    # The inventory has one row per kind of finding, so its window is small.
    order = Window.orderBy(
        vocab.outcome_rank(F.col("outcome")).desc(), F.col("count").desc(), "code", F.coalesce("field", F.lit(""))
    )
    return fnd.inventory(t.findings).select(
        "code", "outcome", "field", "count", F.row_number().over(order).alias("place")
    )


@query(
    "order_fields",
    with_(RECORDS, COLLECTIONS, FIELDS) + """
SELECT collection, field_id, row_number() OVER (PARTITION BY collection ORDER BY lower(name), field_id)::INT AS place FROM fields""",
)
def order_fields(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("collection").orderBy(*cells.field_order()))
    return t.fields.select("collection", "field_id", place.alias("place"))


@query(
    "canonical_order",
    with_(RECORDS) + "SELECT key, row_number() OVER (ORDER BY created_at, key)::BIGINT AS rank FROM records",
)
def canonical_order(t: Tables) -> DataFrame:
    rows = t.records.select("key", "created_at")
    return ordered.global_rank(rows, [F.col("created_at"), F.col("key")]).select("key", "rank")


@query(
    "default_task",
    """
WITH p AS (SELECT o_orderkey, least(length(o_orderpriority) * 10, 3000) / 100 + (o_orderkey % 7) * 5 + (o_orderkey % 5) * 5
  + (o_orderkey % 3) * 5 + CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS score FROM orders)
SELECT o_orderkey AS seq, score::DOUBLE AS score FROM p ORDER BY score DESC, o_orderkey LIMIT 1""",
)
def default_task(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    previews = t.orders.select(
        k.alias("seq"), F.repeat("o_orderpriority", F.lit(10)).alias("markdown"), (k % 7).alias("assignees"),
        (k % 5).alias("tags"), (k % 3).alias("custom_fields"), F.when(k % 2 == 0, k).alias("due_ms"),
        F.lit(None).cast("bigint").alias("start_ms"),
    )
    return build.default_task(previews).select("seq", "score")


@query(
    "events_after",
    with_(LOG) + "SELECT id, run_id, type FROM log WHERE run_id = 'run_3' AND id > 100 ORDER BY id LIMIT 500",
)
def events_after(t: Tables) -> DataFrame:
    return runlog.events_after(t.log, "run_3", 100).select("id", "run_id", "type")


@query(
    "events_tail",
    with_(LOG) + """
SELECT id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS rn FROM log) WHERE rn <= 40""",
)
def events_tail(t: Tables) -> DataFrame:
    return runlog.events_tail(t.log, 40).select("id", "run_id")


DETAIL = r"""CASE WHEN status = 'missing' THEN 'existence (No item with this id exists.)' ELSE
  array_to_string(list_filter([
    CASE WHEN price IS NULL THEN 'price (Not returned.)' WHEN price <> o_totalprice THEN 'price expected "' ||
      regexp_replace(o_totalprice::VARCHAR, '\.0$', '') || '" got "' || regexp_replace(price::VARCHAR, '\.0$', '') || '"' END,
    CASE WHEN priority <> o_orderpriority THEN 'priority expected "' || o_orderpriority || '" got "' || priority || '"' END],
    lambda x: x IS NOT NULL), '; ') END"""


@query(
    "top_problems",
    with_(DESTINATION, ITEMS) + f"SELECT action_id, status, {DETAIL} AS detail FROM items WHERE status <> 'verified' ORDER BY seq LIMIT 15",
)
def top_problems(t: Tables) -> DataFrame:
    return vf.top_problems(items(t), [F.col("seq")], 15).select("action_id", "status", "detail")


@query(
    "clip_messages",
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS clipped,
       md5(left(text, 1000)) AS cut_md5 FROM documents""",
)
def clip_messages(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.clip(F.col("text"), 120).alias("clipped"), F.md5(text.cut(F.col("text"), 1000)).alias("cut_md5")
    )


# -- set operations ----------------------------------------------------------------------------------------
@query(
    "plan_level_findings",
    with_(FINDINGS) + """
SELECT code, outcome, severity, message, origin, count(*)::BIGINT AS n FROM (
  SELECT code, outcome, severity, message, 'source' AS origin FROM findings WHERE category = 'data'
  UNION ALL SELECT code, outcome, severity, message, 'inspection' FROM findings WHERE category <> 'data'
  UNION ALL SELECT 'ORDER_' || o_orderstatus, 'supported', 'info', o_orderpriority, 'validation' FROM orders) GROUP BY ALL""",
)
def plan_level_findings(t: Tables) -> DataFrame:
    keep = ["code", "outcome", "severity", "message"]
    source = t.findings.where(F.col("category") == "data").select(*keep, F.lit("source").alias("origin"))
    inspection = t.findings.where(F.col("category") != "data").select(*keep, F.lit("inspection").alias("origin"))
    validation = t.orders.select(
        F.concat(F.lit("ORDER_"), "o_orderstatus").alias("code"), F.lit("supported").alias("outcome"),
        F.lit("info").alias("severity"), F.col("o_orderpriority").alias("message"), F.lit("validation").alias("origin"),
    )
    together = fnd.plan_level_findings(source, inspection, validation)
    return together.groupBy(*keep, "origin").agg(F.count("*").alias("n"))


@query(
    "union_distinct_findings",
    with_(FINDINGS) + """
SELECT code, outcome, severity, collection, field, message FROM findings
UNION SELECT 'ORDER_' || o_orderstatus, 'supported', 'info', NULL, NULL, o_orderpriority FROM orders""",
)
def union_distinct_findings(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    orders = t.orders.select(
        F.concat(F.lit("ORDER_"), "o_orderstatus").alias("code"), F.lit("supported").alias("outcome"), F.lit("info").alias("severity"),
        none.alias("collection"), none.alias("field"), F.col("o_orderpriority").alias("message"),
    )
    return fnd.union_distinct_findings(t.findings, orders)


@query(
    "option_difference",
    with_(OPTIONS) + "SELECT field_id, option FROM options WHERE option NOT IN ('1-URGENT', '3-MEDIUM')",
)
def option_difference(t: Tables) -> DataFrame:
    held = t.orders.where(F.col("o_orderpriority").rlike("^[13]-")).select(F.lower("o_orderpriority").alias("name"))
    return mp.option_difference(options(t).select("field_id", "option"), held)


@query(
    "tag_intersection",
    """
SELECT DISTINCT w AS tag FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
INTERSECT SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))""",
)
def tag_intersection(t: Tables) -> DataFrame:
    words = lambda df: df.select(F.explode(F.split("p_name", " ")).alias("tag"))
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return words(t.part).intersect(words(t.part.join(returned, "p_partkey", "left_semi")))


def tag_sets(t: Tables) -> DataFrame:
    """Planned tags of each order, and the held ones: reordered, respelt, or one short."""
    k = F.col("o_orderkey")
    tags = F.array(F.col("o_orderpriority"), F.concat(F.lit("Cust-"), "o_custkey"), F.concat(F.lit("St "), "o_orderstatus"))
    short = F.slice(F.reverse(tags), 1, 2)
    return t.orders.select(
        "o_orderkey", tags.alias("planned"),
        F.when(k % 3 == 0, short).when(k % 3 == 1, F.transform(F.reverse(tags), F.lower)).otherwise(F.reverse(tags)).alias("held"),
    )


@query("array_set_equal", "SELECT o_orderkey, o_orderkey % 3 = 2 AS same FROM orders")
def array_set_equal(t: Tables) -> DataFrame:
    return tag_sets(t).select("o_orderkey", vf.same_set(F.col("planned"), F.col("held")).alias("same"))


@query("array_subset", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS subset FROM orders")
def array_subset(t: Tables) -> DataFrame:
    return tag_sets(t).select("o_orderkey", vf.canon_subset(F.col("planned"), F.col("held")).alias("subset"))
