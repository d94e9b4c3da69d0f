"""Readers and writers, exercised on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import cells, findings as fnd
from waybill.plans import report
from waybill.sources import sinks, snapshot, targets
from workload.registry import query
from workload.tables import ACTIONS, COLLECTIONS, FIELDS, FINDINGS, ID_MAP, RECORDS, Tables, with_


@query(
    "scan_snapshot",
    with_(RECORDS, COLLECTIONS) + """
SELECT c.key AS collection, c.record_count, count(r.key)::BIGINT AS live FROM collections c
LEFT JOIN records r ON r.collection = c.key AND NOT r.archived GROUP BY ALL""",
)
def scan_snapshot(t: Tables) -> DataFrame:
    """Write a snapshot, read it back with declared schemas, count its live records."""
    home = sinks.shared_folder(t.spark, "snapshot")
    t.collections.write.parquet(f"{home}/collections")
    t.records.select("key", "collection", "title", "created_at", "archived").write.json(f"{home}/records")
    held = snapshot.scan_snapshot(t.spark, home, "parquet", ["collections"])["collections"]
    rows = snapshot.scan_snapshot(t.spark, home, "json", ["records"])["records"]
    live = rows.where(~F.col("archived")).groupBy("collection").agg(F.count("*").alias("live"))
    return held.join(live, held["key"] == live["collection"], "left").select(
        F.col("key").alias("collection"), "record_count", F.coalesce("live", F.lit(0).cast("bigint")).alias("live")
    )


@query(
    "scan_json_items",
    """
SELECT 'file:item:' || o_orderkey AS key, CASE WHEN (o_orderkey // 100) % 3 = 0 THEN 'Tasks' ELSE 'Batch' END AS list_title, o_orderpriority AS title,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus = 'F' END, false) AS done, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS notes,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS findings FROM orders""",
)
def scan_json_items(t: Tables) -> DataFrame:
    """Orders written as JSON documents of at most a hundred items, then read item by item."""
    k = F.col("o_orderkey")
    item = F.struct(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("title"),
        F.when(k % 2 == 0, F.col("o_orderstatus") == "F").alias("done"),
        F.when(k % 5 == 0, F.col("o_orderstatus")).alias("notes"),
        F.when(k % 7 == 0, F.lit("https://h.example/a")).alias("attachment_url"),
    )
    batch = F.floor(k / 100)
    docs = t.orders.groupBy(batch.alias("batch")).agg(F.collect_list(item).alias("items")).select(
        F.when(F.col("batch") % 3 != 0, F.lit("Batch")).alias("title"), "items"
    )
    home = sinks.shared_folder(t.spark, "items")
    docs.write.json(home)
    items = snapshot.scan_json_items(
        t.spark, home, "id:string,title:string,done:boolean,notes:string,attachment_url:string", {"done": False}, multi_line=False
    )
    records, found = snapshot.item_records(items, "file", ["attachment_url"])
    counted = found.groupBy(F.col("entity").alias("key")).agg(F.count("*").alias("findings"))
    titled = items.select(F.concat(F.lit("file:item:"), "id").alias("key"), "list_title")
    return records.drop("collection").join(titled, "key").join(counted, "key", "left").withColumn(
        "findings", F.coalesce("findings", F.lit(0).cast("bigint"))
    )


def spoilt_props(t: Tables) -> DataFrame:
    """Event properties, some cut short, some without the required member."""
    shape = F.col("event_id") % 10
    props = (
        F.when(shape == 3, F.substring("props", 1, 5)).when(shape == 6, F.lit('{"z": 1}'))
        .otherwise(F.replace("props", F.lit("}"), F.lit(', "extra": true}')))
    )
    return t.events.select("event_id", F.col("event_type").alias("collection"), props.alias("props"))


@query(
    "lenient_parse",
    """SELECT event_id, CASE WHEN event_id % 10 IN (3, 6) THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k,
       event_id % 10 IN (3, 6) AS quarantined FROM events""",
)
def lenient_parse(t: Tables) -> DataFrame:
    good, bad = snapshot.lenient_parse(spoilt_props(t), "props", "k bigint", ["k"])
    return good.select("event_id", "k", F.lit(False).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(True).alias("quarantined"))
    )


@query(
    "incremental_windowed_read",
    """SELECT event_id, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN value + 1 ELSE value END AS value FROM events""",
)
def incremental_windowed_read(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    first = t.events.where(F.col("ts") < day("2024-01-20")).select("event_id", "event_type", "value")
    second = t.events.where(F.col("ts") >= day("2024-01-10")).select("event_id", "event_type", (F.col("value") + 1).alias("value"))
    return snapshot.incremental_windowed_read([first, second], "event_id")


@query(
    "capped_read",
    """
SELECT * FROM (SELECT o_orderkey AS key, NULL::BIGINT AS "rows", NULL::BOOLEAN AS incomplete, NULL AS reason FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5000)
UNION ALL SELECT NULL, least(count(*), 5000)::BIGINT, count(*) > 5000, CASE WHEN count(*) > 5000 THEN 'max_records' END FROM orders""",
)
def capped_read(t: Tables) -> DataFrame:
    kept, told = cells.row_cap(t.orders, F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"], 5000)
    rows = kept.select(F.col("o_orderkey").alias("key"))
    return rows.unionByName(told, allowMissingColumns=True)


@query(
    "skipped_non_rows",
    """SELECT event_type AS collection, count(*)::BIGINT AS skipped, 'SOURCE_NON_PAGE_RESULTS_SKIPPED' AS code FROM events WHERE event_id % 10 IN (3, 6) GROUP BY event_type""",
)
def skipped_non_rows(t: Tables) -> DataFrame:
    good = F.get_json_object("props", "$.k").isNotNull()
    return snapshot.skipped_non_rows(spoilt_props(t), "collection", good)


@query(
    "resolve_container_ids",
    """
WITH w AS (SELECT s_suppkey AS pos, CASE s_suppkey % 3 WHEN 0 THEN 'nation:' || s_nationkey WHEN 1 THEN 'region:' || (s_nationkey % 5) ELSE 'none:' || s_suppkey END AS id FROM supplier),
r AS (SELECT pos, 'nation:' || n_nationkey AS resolved, n_name AS name FROM w JOIN nation ON w.id = 'nation:' || n_nationkey OR w.id = 'region:' || n_regionkey)
SELECT resolved, min(pos) AS pos, name, NULL AS code FROM r GROUP BY resolved, name
UNION ALL SELECT id, pos, NULL, 'SOURCE_NOT_ACCESSIBLE' FROM w WHERE id LIKE 'none:%'""",
)
def resolve_container_ids(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("nation:"), "s_nationkey"))
        .when(k % 3 == 1, F.concat(F.lit("region:"), F.col("s_nationkey") % 5)).otherwise(F.concat(F.lit("none:"), k))
    )
    sources = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    databases = t.nation.select(
        F.concat(F.lit("region:"), "n_regionkey").alias("database_id"), F.concat(F.lit("nation:"), "n_nationkey").alias("source_id")
    )
    named, unknown = snapshot.resolve_container_ids(t.supplier.select(k.alias("pos"), name.alias("id")), sources, databases)
    none = F.lit(None).cast("string")
    return named.select("resolved", "pos", "name", none.alias("code")).unionByName(
        unknown.select(F.col("id").alias("resolved"), "pos", none.alias("name"), "code")
    )


@query(
    "discover_catalog",
    """
SELECT 'folder' AS kind, n_nationkey::BIGINT AS id, n_name AS name, r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0
UNION ALL SELECT 'space', r_regionkey, CASE WHEN r_regionkey = 2 THEN 'Untitled' ELSE r_name END, '' FROM region
UNION ALL SELECT 'list', s_suppkey, s_name, r_name || ' / ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 5 <> 0""",
)
def discover_catalog(t: Tables) -> DataFrame:
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    level = lambda df, kind, key, name, path, trashed, row: df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), name.alias("name"), path.alias("path"),
        trashed.alias("trashed"), row.alias("in_database"),
    )
    no = F.lit(None).cast("boolean")
    spaces = level(
        t.region, "space", "r_regionkey", F.when(F.col("r_regionkey") == 2, F.lit("  ")).otherwise(F.col("r_name")), F.lit(""), no, no
    )
    folders = level(nation, "folder", "n_nationkey", F.col("n_name"), F.col("r_name"), F.col("n_nationkey") % 7 == 0, no)
    lists = level(
        t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "list", "s_suppkey", F.col("s_name"),
        F.concat_ws(" / ", "r_name", "n_name"), no, F.col("s_suppkey") % 5 == 0,
    )
    return snapshot.discover_catalog([spaces, folders, lists])


@query(
    "inspect_collections",
    with_(RECORDS, COLLECTIONS, FIELDS) + """
SELECT f.collection, f.field_id, f.name, f.kind, (SELECT count(*) FROM records r WHERE r.collection = f.collection AND NOT archived)::BIGINT AS record_count,
  'supported' AS support FROM fields f""",
)
def inspect_collections(t: Tables) -> DataFrame:
    live = cells.live_rows(t.records, "archived")
    return cells.inspect_collections(live, t.fields).drop("note")


@query(
    "write_plan_tables",
    with_(ACTIONS, ID_MAP) + """
SELECT 'actions' AS "table", count(*)::BIGINT AS n, true AS first_write, false AS second_write FROM actions
UNION ALL SELECT 'id_map', count(*), true, false FROM id_map""",
)
def write_plan_tables(t: Tables) -> DataFrame:
    """Persist a plan twice: the second time changes nothing."""
    home = sinks.shared_folder(t.spark, "plans")
    tables = {"actions": t.actions, "id_map": t.id_map}
    first = sinks.write_plan_tables("plan_demo", tables, home)
    second = sinks.write_plan_tables("plan_demo", tables, home)
    counted = [
        t.spark.read.parquet(f"{home}/plan_demo/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        for n in tables
    ]
    return counted[0].unionByName(counted[1]).select(
        "table", "n", F.lit(first).alias("first_write"), F.lit(second).alias("second_write")
    )


@query(
    "export_new_records",
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 9 = 0 THEN 'conflict' ELSE 'same' END AS result FROM orders""",
)
def export_new_records(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    content = F.concat_ws("|", "o_orderstatus", "o_orderpriority", "o_totalprice")
    planned = t.orders.select(k.alias("key"), content.alias("content"))
    held = t.orders.where(k % 4 != 0).select(
        k.alias("key"), F.when(k % 9 == 0, F.concat(content, F.lit("!"))).otherwise(content).alias("content")
    )
    home = sinks.shared_folder(t.spark, "export")
    held.write.parquet(home)
    return sinks.export_new_records(planned, t.spark.read.schema("key bigint, content string").parquet(home)).drop("content")


@query(
    "inspect_targets",
    """
SELECT 'path' AS part, s_suppkey AS id, concat_ws(' / ', 'W', r_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END, s_name) AS text, NULL::DOUBLE AS orderindex
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'option', s_suppkey, 'o1:' || s_name, 1.0 FROM supplier
UNION ALL SELECT 'option', s_suppkey, 'o2:label', NULL FROM supplier
UNION ALL SELECT 'missing', s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'DEST_LIST_FORBIDDEN' ELSE 'DEST_LIST_NOT_FOUND' END, NULL FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 6 = 1""",
)
def inspect_targets(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    nation = t.nation.select("n_nationkey", "n_regionkey")
    lists = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("folder_id"), F.col("n_regionkey").alias("space_id")
    )
    folders = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 == 0).alias("hidden"))
    spaces = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    none = F.lit(None).cast("double")
    paths = targets.target_paths(lists, folders, spaces, "W").select(
        F.lit("path").alias("part"), "id", F.col("path").alias("text"), none.alias("orderindex")
    )
    config = F.concat(
        F.lit('{"options":[{"id":"o1","name":"'), "s_name", F.lit('","orderindex":"1"},{"id":"o2","label":"label","orderindex":"x"},{"id":"o3"},{"name":"n"}]}')
    )
    opts = targets.field_options(t.supplier.select(k.alias("field_id"), config.alias("config"))).select(
        F.lit("option").alias("part"), F.col("field_id").alias("id"), F.concat_ws(":", "option_id", "name").alias("text"), "orderindex"
    )
    reachable = t.supplier.where(k % 6 != 1).select(k.alias("id"), (k % 4 == 0).alias("forbidden"))
    # A list that cannot be listed at all is also forbidden when its key says so.
    hidden = t.supplier.where((k % 6 == 1) & (k % 4 == 0)).select(k.alias("id"), F.lit(True).alias("forbidden"))
    gone = targets.unreachable_targets(t.supplier.select(k.alias("list_id")), reachable.unionByName(hidden)).select(
        F.lit("missing").alias("part"), F.col("list_id").alias("id"), F.col("code").alias("text"), none.alias("orderindex")
    )
    return paths.unionByName(opts).unionByName(gone)


@query(
    "export_report_json",
    with_(FINDINGS) + """
SELECT '{"kinds":' || count(*) || ',"occurrences":' || sum(coalesce(count, 1))::BIGINT || ',"outcome":"' || outcome || '"}' AS json FROM findings GROUP BY outcome""",
)
def export_report_json(t: Tables) -> DataFrame:
    home = sinks.shared_folder(t.spark, "report")
    sinks.export_json(fnd.findings_by_outcome(t.findings).select("kinds", "occurrences", "outcome"), home)
    return t.spark.read.text(home).select(F.col("value").alias("json"))
