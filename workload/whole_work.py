"""The whole plan and the whole verification over all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.plans import migrate
from waybill.session import config_frame
from waybill.sources.sinks import stored
from workload.documents_work import ACT
from workload.registry import query
from workload.tables import PRICE_TEXT, RECORDS, Tables, with_


def snapshot_of(t: Tables) -> dict[str, DataFrame]:
    """Orders as records with four typed cells each."""
    none = F.lit(None)
    cell = lambda f, kind, **c: F.struct(
        F.lit(f).alias("field_id"), F.lit(kind).alias("kind"), none.cast("string").alias("text"),
        c.get("number", none.cast("double")).alias("number"), c.get("name", none.cast("string")).alias("name"),
        none.cast("array<string>").alias("names"), none.cast("boolean").alias("flag"),
        c.get("date", none.cast("struct<start:string,end:string,time_zone:string>")).alias("date"),
        none.cast("array<struct<id:string,name:string,email:string>>").alias("users"), none.cast("array<string>").alias("targets"),
    )
    day = F.struct(F.col("created_at").alias("start"), none.cast("string").alias("end"), none.cast("string").alias("time_zone"))
    values = F.array(
        cell("status", "status", name=F.col("o_orderstatus")), cell("priority", "select", name=F.col("o_orderpriority")),
        cell("ordered", "date", date=day), cell("price", "number", number=F.col("o_totalprice")),
    )
    title = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Order\n"), "o_orderkey")).otherwise(F.col("title"))
    records = t.records.select(
        "key", "collection", title.alias("title"), F.concat(F.lit("https://o.example/"), "o_orderkey").alias("url"), "created_at",
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
    )
    return {
        "collections": t.collections, "fields": t.fields, "records": records.select("key", "collection", "title", "url", "created_at"),
        "cells": records.select(F.col("key").alias("record"), "collection", F.inline(values)),
    }


def plan_of(t: Tables) -> dict[str, DataFrame]:
    names = ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"]
    lists = config_frame(t.spark, [(i, n.lower(), f"L{i}", f"List {i}") for i, n in enumerate(names)], "pos int, source string, list_id string, name string")
    statuses = config_frame(
        t.spark, [(f"L{i}", s, p) for i in range(4) for p, s in enumerate(["open", "Closed"])], "list_id string, name string, pos int"
    )
    collections = t.collections.select(F.col("key").alias("collection"))
    entry = lambda f, a, b, p: F.struct(
        F.lit(f).alias("field_name"), F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(p).alias("pos"))
    stated = F.array(entry("Status", "O", "OPEN", 0), entry("Status", "f", "closed", 1), entry("Priority", "1-URGENT", "urgent", 0), entry("Priority", "2 high", "2", 1))
    value_map = collections.select("collection", F.inline(stated))
    none = collections.select("collection", F.lit("Status").alias("name"), F.lit("status").alias("to"))
    id_map = t.id_map.join(t.records.select(F.col("key").alias("source_key"), "collection"), "source_key").join(
        t.collections.select(F.col("key").alias("collection"), F.lower("name").alias("source")), "collection"
    ).join(lists.select("source", "list_id"), "source").select(
        "source_key", F.concat(F.lit("dest:list:"), "list_id").alias("scope"), "destination_id"
    )
    return migrate.plan_migration(snapshot_of(t), statuses, lists, none, value_map, id_map)


PLANNED = f"""l AS (SELECT * FROM (VALUES ('BUILDING', 'L0', 'List 0'), ('MACHINERY', 'L1', 'List 1'), ('AUTOMOBILE', 'L2', 'List 2'), ('FURNITURE', 'L3', 'List 3')) v(seg, list_id, list_name)),
p AS (SELECT r.*, list_id, list_name, 'tpch:order:' || o_orderkey AS k,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'Closed' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS prio FROM records r JOIN l ON collection = 'tpch:segment:' || seg),
planned AS (SELECT *, 'Order ' || o_orderkey AS name, '**Properties**{{N}}{{N}}| Property | Value |{{N}}| --- | --- |' ||
    CASE WHEN status IS NULL THEN '{{N}}| Status | ' || o_orderstatus || ' |' ELSE '' END || CASE WHEN prio IS NULL THEN '{{N}}| Priority | ' || o_orderpriority || ' |' ELSE '' END ||
    '{{N}}| Total price | ' || {PRICE_TEXT} || ' |{{R}}_Migrated, created ' || created_at || '._ [Original](https://o.example/' || o_orderkey || '){{N}}{{N}}`waybill-key:' || k || '`' AS md,
    epoch_ms(o_orderdate) + 14400000 AS due, o_orderkey % 10 = 0 AS had, o_orderkey % 4 = 1 AS renamed FROM p)""".replace(
    "{R}", "' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '"
).replace("{N}", "' || chr(10) || '")


@query(
    "migration_plan",
    with_(RECORDS, PLANNED) + f"""
SELECT {ACT.format(kind='create_task', key='k')} AS id, k AS source, 'dest:list:' || list_id AS scope, 'Create task "' || name || '" in list "' || list_name || '"' AS label,
  CASE WHEN had THEN 'skip' ELSE 'execute' END AS disposition, CASE WHEN had THEN 'skipped' WHEN status IS NULL OR prio IS NULL THEN 'lossy' ELSE 'transformed' END AS outcome,
  list_id, name, status, prio AS priority, due AS due_date, md5(md) AS markdown_md5 FROM planned""",
)
def migration_plan(t: Tables) -> DataFrame:
    actions = plan_of(t)["actions"].withColumn("_p", F.from_json("payload", migrate.PAYLOAD_VIEW))
    return actions.select(
        "id", "source", "scope", "label", "disposition", "outcome", F.col("_p.list_id").alias("list_id"), F.col("_p.body.name").alias("name"),
        F.col("_p.body.status").alias("status"), F.col("_p.body.priority").alias("priority"), F.col("_p.body.due_date").alias("due_date"),
        F.md5("_p.body.markdown_content").alias("markdown_md5"),
    )


@query(
    "migration_findings",
    with_(RECORDS, PLANNED) + """
SELECT code, outcome, field, count(*)::BIGINT AS n FROM (
  SELECT 'STATUS_VALUE_UNMAPPED' AS code, 'lossy' AS outcome, 'Status' AS field FROM planned WHERE status IS NULL
  UNION ALL SELECT 'PRIORITY_VALUE_UNMAPPED', 'lossy', 'Priority' FROM planned WHERE prio IS NULL
  UNION ALL SELECT 'FIELD_PRESERVED_AS_TEXT', 'transformed', 'Total price' FROM planned
  UNION ALL SELECT 'NAME_NORMALIZED', 'transformed', NULL FROM planned WHERE renamed) GROUP BY ALL""",
)
def migration_findings(t: Tables) -> DataFrame:
    found = plan_of(t)["findings"]
    return found.groupBy("code", "outcome", "field").agg(F.count("*").alias("n"))


@query(
    "migration_accounting",
    with_(RECORDS, PLANNED) + """
SELECT collection, field_name, count(*)::BIGINT AS cells, count(*) FILTER (placed)::BIGINT AS placed, count(*) FILTER (NOT placed)::BIGINT AS text_rows,
  0::BIGINT AS findings_only, 0::BIGINT AS lost FROM (
  SELECT collection, 'Status' AS field_name, status IS NOT NULL AS placed FROM planned
  UNION ALL SELECT collection, 'Priority', prio IS NOT NULL FROM planned
  UNION ALL SELECT collection, 'Total price', false FROM planned
  UNION ALL SELECT collection, 'Order date', true FROM planned) GROUP BY ALL""",
)
def migration_accounting(t: Tables) -> DataFrame:
    """Every value of every cell is somewhere: in the payload, in a text row, or told of by a finding."""
    return plan_of(t)["accounting"]


@query(
    "migration_verification",
    with_(RECORDS, PLANNED) + """
SELECT k AS source, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderkey % 89 = 0 OR (o_orderkey % 83 = 0 AND o_orderkey % 79 <> 0) OR (o_orderkey % 73 = 0 AND prio IS NOT NULL) OR o_orderkey % 71 = 0 THEN 'mismatched'
  WHEN o_orderkey % 79 = 0 THEN 'unverified' ELSE 'verified' END AS status FROM planned""",
)
def migration_verification(t: Tables) -> DataFrame:
    """What the destination holds is the plan itself with known faults, written as another system would."""
    return verification_of(stored(plan_of(t)["actions"], "plan"))  # a plan is saved before it is verified


def verification_of(actions: DataFrame) -> DataFrame:
    """A stored plan beside its faulty twin."""
    k = F.element_at(F.split("source", ":"), 3).cast("bigint")
    dest = F.concat(F.lit("d-"), k)
    id_map = actions.select("scope", F.col("idempotency_key").alias("source_key"), dest.alias("destination_id"))
    view = actions.where(k % 97 != 0).withColumn("_p", F.from_json("payload", migrate.PAYLOAD_VIEW))
    body = lambda n: F.col(f"_p.body.{n}")
    text = F.replace(body("markdown_content"), F.lit("\n"), F.lit("  \r\n"))
    held = view.select(
        dest.alias("destination_id"), F.when(k % 89 == 0, F.lit("other")).otherwise(body("name")).alias("name"), F.upper(body("status")).alias("status"),
        F.when(k % 73 == 0, F.lit(4)).otherwise(body("priority")).alias("priority"),
        F.when(k % 71 == 0, body("due_date") + 86_400_000).otherwise(body("due_date") + 3_600_000).alias("due_date"),
        body("start_date").alias("start_date"),
        F.when(k % 79 == 0, F.lit(None).cast("string")).when(k % 83 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("markdown"),
    )
    return migrate.verify_migration(actions, id_map, held).select("source", "status")
