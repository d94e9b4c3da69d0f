"""Joins that plan and verify a migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import dates
from waybill.operators import cells, findings as fnd, mapping as mp, relations as rel
from waybill.operators import verify as vf
from waybill.plans import build, report
from waybill.session import config_frame
from workload.inputs import (
    CHECKPOINTS, ITEMS, MAPPED_OPTIONS, checkpoints, items, mapped_options, options, statuses, value_map,
)
from workload.registry import query
from workload.tables import (
    ACTIONS, CELLS, COLLECTIONS, DESTINATION, EDGES, FIELDS, FINDINGS, ID_MAP, PAGE_TREE, RECORDS, SEQ, Tables,
    key_of, with_,
)


@query(
    "join_field_defs",
    with_(RECORDS, COLLECTIONS, FIELDS, CELLS) + """
SELECT record, c.collection, c.field_id, f.name AS field_name, f.kind, f.source_type, f.pos, c.text
FROM cells c JOIN fields f ON c.collection = f.collection AND c.field_id = f.field_id WHERE c.field_id <> 'price'""",
)
def join_field_defs(t: Tables) -> DataFrame:
    declared = t.fields.where(F.col("field_id") != "price")
    return cells.join_field_defs(t.cells, declared).drop("number")


@query(
    "status_groups",
    """
WITH g AS (SELECT o_orderstatus AS option_id, ['To-do', 'Complete', NULL][CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END] AS grp, o_custkey % 5 AS field FROM orders)
SELECT DISTINCT 'field_' || field AS field_id, option_id, grp AS "group" FROM g""",
)
def status_groups(t: Tables) -> DataFrame:
    opts = t.orders.select(
        F.concat(F.lit("field_"), F.col("o_custkey") % 5).alias("field_id"), F.col("o_orderstatus").alias("option_id")
    ).distinct()
    group = lambda n, p, ids: F.struct(
        F.lit(n).alias("group"), F.lit(p).alias("pos"), F.array(*[F.lit(i) for i in ids]).alias("option_ids")
    )
    groups = opts.select("field_id").distinct().select(
        "field_id", F.inline(F.array(group("Old", 0, ["F"]), group("To-do", 1, ["O"]), group("Complete", 2, ["F", "X"])))
    )
    return cells.status_groups(opts, groups)


@query(
    "match_collections",
    """
WITH c AS (SELECT DISTINCT p_type, p_brand FROM part)
SELECT 'part:' || p_type || ':' || p_brand AS key, CASE WHEN p_brand = 'Brand#1' THEN 'list_key' WHEN p_type = 'PROMO' THEN 'list_a'
   WHEN p_brand = 'Brand#7' THEN 'list_b' END AS list_id FROM c""",
)
def match_collections(t: Tables) -> DataFrame:
    config = t.part.select("p_type", "p_brand").distinct().where(F.col("p_brand") == "Brand#1").select(
        F.lit(0).alias("pos"), F.concat(F.lit(" part:"), "p_type", F.lit(":"), "p_brand").alias("source"), F.lit("list_key").alias("list_id")
    ).unionByName(config_frame(t.spark, [(1, " pro-MO ", "list_a"), (2, "brand#7", "list_b"), (3, "promo", "list_c")], "pos int, source string, list_id string"))
    return mp.match_collections(part_collections(t), config).select("key", "list_id")


def part_collections(t: Tables) -> DataFrame:
    kinds = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("record_count"))
    return kinds.select(
        F.concat(F.lit("part:"), "p_type", F.lit(":"), "p_brand").alias("key"), F.col("p_type").alias("id"),
        F.col("p_brand").alias("name"), "record_count",
    )


@query(
    "unselected_config",
    """SELECT s_suppkey AS pos, 'NATION_' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END AS source, 'CONFIG_SOURCE_NOT_SELECTED' AS code
FROM supplier WHERE s_suppkey % 3 = 0 OR s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)""",
)
def unselected_config(t: Tables) -> DataFrame:
    tail = F.when(F.col("s_suppkey") % 3 == 0, F.lit("x")).otherwise(F.lit(""))
    config = t.supplier.select(
        F.col("s_suppkey").alias("pos"), F.concat(F.lit("NATION_"), F.col("s_nationkey"), tail).alias("source")
    )
    read = t.nation.where(F.col("n_nationkey") % 2 == 0).select(
        key_of("nation", "n_nationkey").alias("key"), F.col("n_nationkey").cast("string").alias("id"), F.lower("n_name").alias("name")
    )
    return mp.unselected_config(read, config)


@query(
    "unmapped_collections",
    """SELECT 'part:' || p_type || ':' || p_brand AS key, p_brand AS name, count(*)::BIGINT AS record_count, 'COLLECTION_NOT_MAPPED' AS code
FROM part WHERE p_type <> 'PROMO' GROUP BY p_type, p_brand""",
)
def unmapped_collections(t: Tables) -> DataFrame:
    config = config_frame(t.spark, [(0, "promo", "list_a")], "pos int, source string, list_id string")
    return mp.unmapped_collections(mp.match_collections(part_collections(t), config))


@query(
    "value_map_join",
    with_(RECORDS, CELLS, MAPPED_OPTIONS) + """
SELECT record, c.field_id, text, m.target, CASE WHEN m.target IS NOT NULL THEN 'value_map' END AS via
FROM cells c LEFT JOIN mapped_options m ON m.field_id = c.field_id AND m.option = text""",
)
def value_map_join(t: Tables) -> DataFrame:
    """The cells of all fields; those without a map have no target."""
    own = t.cells.select("record", "field_id", "text")
    done = mp.value_map_join(own, "text", value_map(t), statuses(t), by=["field_id"])
    return done.select("record", "field_id", "text", "target", "via")


@query(
    "value_map_validate",
    "SELECT 'o-' || o_orderpriority AS \"from\", o_orderpriority AS \"to\" FROM (SELECT DISTINCT o_orderpriority FROM orders) WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')",
)
def value_map_validate(t: Tables) -> DataFrame:
    stated = t.orders.select(F.concat(F.lit("o-"), "o_orderpriority").alias("from"), F.col("o_orderpriority").alias("to")).distinct()
    held = t.orders.where(F.col("o_orderpriority").isin("2-HIGH", "5-LOW")).select(
        F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" / "))).alias("name")
    )
    return mp.value_map_validate(stated, held)


@query(
    "unmapped_options",
    with_(MAPPED_OPTIONS) + "SELECT field_id, string_agg(option, ',' ORDER BY option) AS unmapped FROM mapped_options WHERE target IS NULL GROUP BY field_id",
)
def unmapped_options(t: Tables) -> DataFrame:
    return mp.unmapped_options(mapped_options(t)).select("field_id", F.array_join("unmapped", ",").alias("unmapped"))


@query(
    "suggest_status",
    "SELECT DISTINCT o_orderstatus AS option, CASE o_orderstatus WHEN 'P' THEN 'Doing' WHEN 'O' THEN 'open' ELSE 'Closed' END AS suggestion FROM orders",
)
def suggest_status(t: Tables) -> DataFrame:
    opts = options(t).where(F.col("field_id") == "status").select("option", "group")
    names = statuses(t).where(F.col("field_id") == "status").select("name", "type")
    return mp.suggest_status(opts, names).select("option", "suggestion")


@query(
    "tag_match",
    """
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS tags FROM part),
h AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part WHERE p_partkey % 3 = 0),
e AS (SELECT p_partkey, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM w),
j AS (SELECT e.*, h.name FROM e LEFT JOIN h ON lower(h.name) = lower(e.tag)),
f AS (SELECT p_partkey, name, min(pos) AS pos FROM j WHERE name IS NOT NULL GROUP BY p_partkey, name),
a AS (SELECT p_partkey, string_agg(name, ',' ORDER BY pos) AS applied FROM f GROUP BY p_partkey),
m AS (SELECT p_partkey, string_agg(tag, ',' ORDER BY pos) AS missing FROM j WHERE name IS NULL GROUP BY p_partkey)
SELECT p_partkey, coalesce(applied, '') AS applied, coalesce(missing, '') AS missing FROM w LEFT JOIN a USING (p_partkey) LEFT JOIN m USING (p_partkey)""",
)
def tag_match(t: Tables) -> DataFrame:
    tags = F.split(F.concat(F.upper("p_name"), F.lit(" "), "p_type"), " ")
    rows = t.part.select("p_partkey", F.transform(tags, lambda x: F.when(x == F.col("p_type"), x).otherwise(F.lower(x))).alias("tags"))
    held = t.part.where(F.col("p_partkey") % 3 == 0).select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    done = mp.tag_match(rows, ["p_partkey"], "tags", held)
    return done.select("p_partkey", F.array_join("applied", ",").alias("applied"), F.array_join("missing", ",").alias("missing"))


@query(
    "dropdown_match",
    "SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '4%' THEN 'opt-' || left(o_orderpriority, 1) END AS option_id, CASE WHEN o_orderpriority LIKE '4%' THEN o_orderpriority END AS fallback FROM orders",
)
def dropdown_match(t: Tables) -> DataFrame:
    held = t.orders.where(~F.col("o_orderpriority").startswith("4")).select(
        F.concat(F.lit("opt-"), F.substring("o_orderpriority", 1, 1)).alias("option_id"),
        F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))).alias("name"), F.lit(0).alias("pos"),
    ).distinct()
    return mp.dropdown_match(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", held).select(
        "o_orderkey", "option_id", "fallback"
    )


@query(
    "resolve_custom_field",
    """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cf-' || p_brand WHEN 1 THEN 'cf-' || p_brand WHEN 2 THEN 'cf-' || p_brand END AS target_id,
  CASE WHEN p_partkey % 4 < 3 THEN 'number' END AS target_type,
  CASE WHEN p_partkey % 4 = 3 THEN 'MAPPING_CUSTOM_FIELD_UNKNOWN' WHEN p_partkey % 4 = 2 THEN 'MAPPING_CUSTOM_FIELD_TYPE' END AS code FROM part""",
)
def resolve_custom_field(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    wanted = t.part.select(
        "p_partkey", F.when(k == 2, F.lit("date")).otherwise(F.lit("number")).alias("kind"),
        F.when(k == 0, F.concat(F.lit("cf-"), "p_brand")).when(k == 3, F.lit("no such field"))
        .otherwise(F.upper(F.replace("p_brand", F.lit("#"), F.lit(" / ")))).alias("field"),
    )
    brands = t.part.select("p_brand").distinct()
    targets = brands.select(
        F.concat(F.lit("cf-"), "p_brand").alias("target_id"), F.col("p_brand").alias("target_name"),
        F.lit("number").alias("target_type"), F.col("p_brand").alias("pos"),
    )
    return mp.resolve_custom_field(wanted, targets).select("p_partkey", "target_id", "target_type", "code")


def users_of(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("key"), F.md5(k.cast("string")).alias("id"),
        F.concat(F.lit("C"), k, F.lit("@Example.com")).alias("email"),
    )


def members_of(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), F.concat(F.lit(" c"), k * 3, F.lit("@example.com")).alias("email"), k.alias("pos"))


def user_map_of(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    source = F.when(k % 2 == 0, F.upper(F.md5(k.cast("string")))).otherwise(F.concat(F.lit("c"), k, F.lit("@EXAMPLE.com")))
    return t.customer.where(k % 7 == 0).select(
        k.alias("pos"), source.alias("source"), F.when(k % 21 == 0, k + 1_000_000).otherwise(k % 10).alias("target")
    )


@query(
    "resolve_users",
    """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 21 <> 0 THEN c_custkey % 10
    WHEN c_custkey % 3 = 0 AND c_custkey / 3 < n THEN c_custkey // 3 END::BIGINT AS member_id,
  CASE WHEN c_custkey % 7 = 0 AND c_custkey % 21 <> 0 THEN 'explicit' WHEN c_custkey % 3 = 0 AND c_custkey / 3 < n THEN 'email' END AS via
FROM customer, n""",
)
def resolve_users(t: Tables) -> DataFrame:
    found = mp.resolve_users(users_of(t), user_map_of(t), members_of(t), match_by_email=True)
    return found.select("key", "member_id", "via")


@query("invalid_user_targets", "SELECT c_custkey AS pos, c_custkey + 1000000 AS target FROM customer WHERE c_custkey % 21 = 0")
def invalid_user_targets(t: Tables) -> DataFrame:
    return mp.invalid_user_targets(user_map_of(t), members_of(t)).select("pos", "target")


@query(
    "enrich_users",
    """
WITH u AS (SELECT DISTINCT o_custkey AS id FROM orders)
SELECT id, CASE WHEN id % 4 <> 0 THEN c_name ELSE 'embedded ' || id END AS name, CASE WHEN id % 3 = 0 THEN id || '@x.example' END AS email,
  CASE WHEN id % 4 <> 0 THEN c_mktsegment ELSE 'unknown' END AS type FROM u JOIN customer ON c_custkey = id""",
)
def enrich_users(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    k = F.col("o_custkey")
    embedded = t.orders.select(
        k.alias("id"), F.concat(F.lit("embedded "), k).alias("name"),
        F.when(k % 3 == 0, F.concat(k, F.lit("@x.example"))).alias("email"), none.alias("type"),
    ).distinct()
    directory = t.customer.where(F.col("c_custkey") % 4 != 0).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), none.alias("email"), F.col("c_mktsegment").alias("type")
    )
    return cells.enrich_users(embedded, directory)


@query(
    "resolve_relationships",
    """
SELECT l_partkey AS "from", 'made_by' AS field, l_suppkey AS "to", s_name AS to_title, s_suppkey IS NOT NULL AS resolved,
       coalesce(l_suppkey % 5 <> 0, false) AS in_scope, count(*)::BIGINT AS n
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 <> 0 GROUP BY ALL""",
)
def resolve_relationships(t: Tables) -> DataFrame:
    edges = t.edges.select(
        F.col("from_id").alias("from"), F.lit("made_by").alias("field"), F.col("to_id").alias("to"),
        (F.col("to_id") % 5).alias("to_collection"),
    )
    records = t.supplier.where(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))
    selected = t.region.where(F.col("r_regionkey") != 0).select(F.col("r_regionkey").alias("key"))
    done = rel.resolve_relationships(edges, records, selected)
    return done.groupBy(*done.columns).agg(F.count("*").alias("n"))


def relation_cells(t: Tables) -> DataFrame:
    """Each order points to one to five customers, counted on from its own."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 5)
    targets = F.transform(steps, lambda i: F.concat(F.lit("c"), F.col("o_custkey") + i * 13))
    return t.orders.select(F.col("o_orderkey").alias("record"), F.lit("placed_by").alias("field_id"), targets.alias("targets"))


RELATION_CELLS = """targets AS (
  SELECT o_orderkey AS record, i AS pos, o_custkey + i * 13 AS target FROM orders, range(5) r(i) WHERE i <= o_orderkey % 5)"""


@query(
    "out_of_scope_relations",
    with_(RELATION_CELLS) + """
SELECT record, count(*)::BIGINT AS n, string_agg('c' || target, ', ' ORDER BY pos) AS targets FROM targets
WHERE target NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY record""",
)
def out_of_scope_relations(t: Tables) -> DataFrame:
    records = t.customer.where(F.col("c_custkey") % 3 != 0).select(F.concat(F.lit("c"), "c_custkey").alias("key"))
    return rel.out_of_scope_relations(relation_cells(t), records).select("record", "n", "targets")


@query(
    "relation_as_text",
    with_(RELATION_CELLS) + """
SELECT record, string_agg(coalesce(c_name, '(item outside this migration)'), ', ' ORDER BY pos) AS text
FROM targets LEFT JOIN customer ON c_custkey = target AND c_custkey % 3 <> 0 GROUP BY record""",
)
def relation_as_text(t: Tables) -> DataFrame:
    records = t.customer.where(F.col("c_custkey") % 3 != 0).select(
        F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("title")
    )
    return rel.relation_as_text(relation_cells(t), records).select("record", "text")


@query(
    "link_pairs",
    with_(EDGES) + """
SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges
WHERE from_id <> to_id AND from_id % 4 <> 0 AND to_id % 4 <> 0""",
)
def link_pairs(t: Tables) -> DataFrame:
    return rel.link_pairs(t.edges, t.part.where(F.col("p_partkey") % 4 != 0).select("p_partkey"))


@query(
    "skip_already_migrated",
    with_(ACTIONS, ID_MAP) + """
SELECT id, CASE WHEN seq % 10 = 0 THEN 'skip' ELSE 'execute' END AS disposition, CASE WHEN seq % 10 = 0 THEN 'already_migrated' END AS skip_reason,
  CASE WHEN seq % 10 = 0 THEN 'dst-' || seq END AS existing_destination_id, CASE WHEN seq % 10 = 0 THEN 'skipped' ELSE 'supported' END AS outcome,
  CASE WHEN seq % 10 = 0 THEN 0 ELSE 1 END AS estimated_requests FROM actions""",
)
def skip_already_migrated(t: Tables) -> DataFrame:
    drafts = t.actions.select("id", "scope", "idempotency_key", F.lit("supported").alias("outcome"))
    return build.skip_already_migrated(drafts, t.id_map).drop("scope", "idempotency_key")


def live_items(t: Tables) -> DataFrame:
    """Destination items whose text carries a marker; every 30th marker is there twice."""
    k = F.col("o_orderkey")
    copies = F.when(k % 30 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.orders.where(k % 6 == 0).select(
        F.concat(F.lit("dest:list:"), "o_orderstatus").alias("target"), F.explode(copies).alias("copy"), "o_orderkey", "o_orderdate"
    ).select(
        "target", (F.col("copy") * 10_000_000 + k).alias("seq"), F.concat(F.lit("item-"), k, F.lit("-"), "copy").alias("item_id"),
        F.concat(F.lit(f"Moved.\n\n`{build.MARKER_PREFIX}"), key_of("order", k), F.lit("`")).alias("text"),
        F.concat(F.lit("ORDER "), k).alias("name"), "o_orderkey", "copy",
    )


@query(
    "adopt_existing",
    with_(ACTIONS) + """
SELECT id, CASE WHEN seq % 10 = 0 OR seq % 6 = 0 THEN 'skip' ELSE 'execute' END AS disposition, seq % 10 <> 0 AND seq % 6 = 0 AS adopted,
  CASE WHEN seq % 10 <> 0 AND seq % 6 = 0 THEN 'item-' || seq || '-0' END AS destination_id FROM actions""",
)
def adopt_existing(t: Tables) -> DataFrame:
    return build.adopt_existing(t.actions, live_items(t)).select("id", "disposition", "adopted", "destination_id")


@query(
    "name_collisions",
    with_(ACTIONS) + "SELECT scope, count(*)::BIGINT AS collisions FROM actions WHERE disposition = 'execute' AND seq % 6 = 0 GROUP BY scope",
)
def name_collisions(t: Tables) -> DataFrame:
    named = t.actions.withColumn("name", F.concat(F.lit("order - "), "seq"))
    return build.name_collisions(named, live_items(t))


@query(
    "route_findings",
    with_(FINDINGS) + f"""
, o AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0)
SELECT {SEQ.split(', l_quantity')[0]}, code, CASE WHEN o_orderkey IS NOT NULL THEN 'act_' || o_orderkey END AS owner
FROM findings LEFT JOIN o ON l_orderkey = o_orderkey
WHERE NOT (o_orderkey IS NOT NULL AND code = 'CODE_A' AND field IS NULL AND collection = 'tpch:supp:0' AND o_orderkey % 2 = 0)""",
)
def route_findings(t: Tables) -> DataFrame:
    k = F.col("seq")
    actions = t.actions.where(k % 3 != 0)
    attached = actions.where(k % 2 == 0).select(
        F.col("id").alias("action_id"), F.lit("CODE_A").alias("code"), F.col("source").alias("entity"),
        F.lit(None).cast("string").alias("field"), F.lit("tpch:supp:0").alias("collection"),
    )
    routed = fnd.route_findings(t.findings, actions, attached)
    return routed.select("seq.l_orderkey", "seq.l_linenumber", "seq.l_partkey", "seq.l_suppkey", "code", "owner")


@query(
    "merge_action_outcome",
    with_(FINDINGS, ACTIONS) + """
, r AS (SELECT entity, max(list_position(['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed'], outcome)) AS p FROM findings GROUP BY entity),
m AS (SELECT a.*, greatest(r.p, list_position(['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed'], a.outcome)) AS w
      FROM actions a LEFT JOIN r ON r.entity = a.source)
SELECT id, CASE WHEN disposition = 'skip' THEN outcome WHEN w = 5 THEN 'lossy'
  ELSE ['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed'][w] END AS outcome FROM m""",
)
def merge_action_outcome(t: Tables) -> DataFrame:
    return fnd.merge_action_outcome(t.actions, fnd.route_findings(t.findings, t.actions)).select("id", "outcome")


@query(
    "diff_expected_actual",
    with_(DESTINATION, ITEMS) + "SELECT action_id, destination_id, source, scope, status, failing FROM items",
)
def diff_expected_actual(t: Tables) -> DataFrame:
    names = F.array_join(F.transform(F.filter("checks", lambda c: c["status"] != "verified"), lambda c: c["field"]), ",")
    return items(t).select("action_id", "destination_id", "source", "scope", "status", names.alias("failing"))


@query(
    "never_created",
    with_(ACTIONS, CHECKPOINTS) + """
SELECT a.id AS action_id, 'missing' AS status, 'Not created (action status: ' || coalesce(c.status, 'unknown') || ').' AS note
FROM actions a LEFT JOIN checkpoints c ON c.action_id = a.id AND c.seq % 29 <> 0
WHERE disposition = 'execute' AND (c.status IS NULL OR c.status NOT IN ('succeeded', 'skipped'))""",
)
def never_created(t: Tables) -> DataFrame:
    held = checkpoints(t).where(F.col("seq") % 29 != 0)
    return vf.never_created(t.actions, held).select("action_id", "status", "note")


@query(
    "verify_links",
    with_(EDGES) + """
, p AS (SELECT DISTINCT from_id, to_id FROM edges)
SELECT from_id || '>' || to_id AS id, CASE WHEN from_id % 6 = 0 OR to_id % 6 = 0 THEN 'unverified' WHEN from_id % 7 = 0 THEN 'missing'
  WHEN (from_id + to_id) % 5 = 0 THEN 'mismatched' ELSE 'verified' END AS status FROM p""",
)
def verify_links(t: Tables) -> DataFrame:
    pairs = t.edges.distinct()
    links = pairs.select(
        F.concat("from_id", F.lit(">"), "to_id").alias("id"), F.col("from_id").alias("from_action"), F.col("to_id").alias("to_action")
    )
    known = t.part.where(F.col("p_partkey") % 6 != 0).select(
        F.col("p_partkey").alias("action_id"), F.concat(F.lit("d"), "p_partkey").alias("destination_id")
    )
    held = known.where(F.col("action_id") % 7 != 0).select("destination_id")
    name = lambda c: F.concat(F.lit("d"), c).alias(c)
    linked = pairs.where((F.col("from_id") + F.col("to_id")) % 5 != 0).select(name("from_id"), name("to_id"))
    return vf.verify_links(links, known, held, linked).select("id", "status")


@query(
    "verify_pages",
    with_(PAGE_TREE) + """
, p AS (SELECT *, pos % 11 = 0 AS gone, pos % 7 = 0 AS renamed, pos % 13 = 0 AS moved, pos % 5 = 0 AS blank, pos % 17 = 0 AS edited FROM page_tree)
SELECT 'act:' || key AS action_id, CASE WHEN gone THEN 'missing' WHEN renamed OR moved OR (edited AND NOT blank) THEN 'mismatched'
  WHEN blank THEN 'unverified' ELSE 'verified' END AS status FROM p""",
)
def verify_pages(t: Tables) -> DataFrame:
    pos = F.col("pos")
    act = lambda c: F.concat(F.lit("act:"), c)
    dst = lambda c: F.concat(F.lit("dst:"), c)
    planned_pages = t.page_tree.select(
        act("key").alias("action_id"), F.col("title").alias("name"), F.concat("title", F.lit(" \n\n\n\nbody")).alias("content"),
        act("parent").alias("parent_action"),
    )
    ids = t.page_tree.select(act("key").alias("action_id"), dst("key").alias("destination_id"))
    content = F.when(pos % 5 == 0, F.lit(None).cast("string")).when(pos % 17 == 0, F.concat("title", F.lit("\nbody"))).otherwise(
        F.concat("title", F.lit("\r\n\r\nbody  \n"))
    )
    actual = t.page_tree.where(pos % 11 != 0).select(
        dst("key").alias("page_id"), F.when(pos % 7 == 0, F.lit("other")).otherwise(F.col("title")).alias("name"), content.alias("content"),
        F.when(pos % 13 == 0, F.lit("dst:elsewhere")).otherwise(dst("parent")).alias("parent_id"),
    )
    return vf.verify_pages(planned_pages, actual, ids).select("action_id", "status")


@query(
    "reconcile_matches",
    """
WITH c AS (SELECT user_id AS target, event_type AS match_key, event_id AS item_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type <> 'view'),
a AS (SELECT event_id AS action_id, user_id AS target, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'click' END AS match_key,
             epoch_us(ts) // 1000 AS since FROM events WHERE event_type = 'view'),
j AS (SELECT a.action_id, count(c.item_id) AS n, min(c.item_id) AS item FROM a LEFT JOIN c ON a.target = c.target AND a.match_key = c.match_key
      AND c.ms >= a.since - 60000 GROUP BY a.action_id)
SELECT action_id, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'undecidable' END AS status, CASE WHEN n = 1 THEN item END AS destination_id,
  CASE WHEN n = 0 THEN true END AS confident FROM j""",
)
def reconcile_matches(t: Tables) -> DataFrame:
    ms = dates.epoch_ms(F.col("ts"))
    candidates = t.events.where(F.col("event_type") != "view").select(
        F.col("user_id").alias("target"), F.col("event_type").alias("match_key"), F.col("event_id").alias("item_id"), ms.alias("created_ms")
    )
    wanted = F.when(F.col("event_id") % 2 == 0, F.lit("error")).otherwise(F.lit("click"))
    attempts = t.events.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("target"), wanted.alias("match_key"), ms.alias("since_ms")
    )
    return vf.reconcile_matches(attempts, candidates)


@query(
    "dangling_parents",
    with_(PAGE_TREE) + "SELECT key, parent FROM page_tree WHERE pos % 5 <> 1 AND parent IN (SELECT key FROM page_tree WHERE pos % 5 = 1)",
)
def dangling_parents(t: Tables) -> DataFrame:
    return rel.dangling_parents(t.page_tree.where(F.col("pos") % 5 != 1)).select("key", "parent")


@query("record_bodies", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def record_bodies(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("key"))
    return rel.record_bodies(docs, t.labels.select("doc_id")).select(F.col("key").alias("doc_id"))


@query("standalone_docs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def standalone_docs(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("key"))
    return rel.standalone_docs(docs, t.labels.select("doc_id")).select(F.col("key").alias("doc_id"))


REPORT_ITEMS = """report_items AS (
  SELECT a.id AS action_id, a.seq, a.label, a.source, coalesce(c.status, CASE WHEN disposition = 'skip' THEN 'skipped' ELSE 'pending' END) AS status,
    CASE WHEN c.status IN ('failed', 'blocked') THEN 'failed' ELSE a.outcome END AS outcome,
    coalesce(c.destination_id, CASE WHEN disposition = 'skip' THEN 'dst-' || a.seq END) AS destination_id,
    c.last_error_code || ': ' || c.last_error_message AS error
  FROM actions a LEFT JOIN checkpoints c ON c.action_id = a.id AND c.seq % 29 <> 0)"""


def report_items_of(t: Tables) -> DataFrame:
    prior = F.when(F.col("disposition") == "skip", F.concat(F.lit("dst-"), "seq"))
    actions = t.actions.withColumn("existing_destination_id", prior)
    return report.report_items(actions, checkpoints(t).where(F.col("seq") % 29 != 0))


@query("report_items", with_(ACTIONS, CHECKPOINTS, REPORT_ITEMS) + "SELECT * FROM report_items")
def report_items(t: Tables) -> DataFrame:
    return report_items_of(t)


@query(
    "plan_mappings_only",
    with_(ID_MAP) + "SELECT source_key, scope, destination_id FROM id_map WHERE substr(source_key, 12)::BIGINT % 20 = 0",
)
def plan_mappings_only(t: Tables) -> DataFrame:
    return report.plan_mappings_only(t.id_map, t.actions.where(F.col("seq") % 4 == 0))


@query(
    "scope_target_name",
    with_(ACTIONS) + "SELECT id, CASE WHEN o_orderstatus <> 'P' THEN 'List ' || o_orderstatus END AS target FROM actions",
)
def scope_target_name(t: Tables) -> DataFrame:
    targets = t.orders.where(F.col("o_orderstatus") != "P").select("o_orderstatus").distinct().select(
        F.lit("list").alias("kind"), F.col("o_orderstatus").alias("id"), F.lit(0).alias("pos"),
        F.concat(F.lit("List "), "o_orderstatus").alias("name"),
    )
    return build.scope_target_name(t.actions, targets).select("id", "target")


@query("missing_targets", "SELECT 'list' AS kind, s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 3 = 0")
def missing_targets(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 2 == 0, F.lit("list")).otherwise(F.lit("folder"))
    wanted = t.supplier.select(kind.alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    present = t.supplier.where(F.col("s_nationkey") % 3 != 0).select(kind.alias("kind"), F.col("s_suppkey").alias("id"))
    return build.missing_targets(wanted, present)


@query(
    "task_preview",
    """
SELECT o_orderkey AS id, 'List ' || o_orderstatus AS list_name, CASE WHEN o_custkey % 3 <> 0 THEN c_name END AS assignee_name,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Field ' || o_orderpriority END AS custom_field_name,
  strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS due FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def task_preview(t: Tables) -> DataFrame:
    actions = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("list_id"), F.col("o_custkey").alias("assignee"),
        F.col("o_orderpriority").alias("custom_field"), dates.epoch_ms(F.col("o_orderdate")).alias("due_ms"),
    )
    lists = t.orders.select(F.col("o_orderstatus").alias("id"), F.concat(F.lit("List "), "o_orderstatus").alias("name")).distinct()
    people = t.customer.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    held = t.orders.where(F.col("o_orderpriority").rlike("^[12]")).select(
        F.col("o_orderpriority").alias("id"), F.concat(F.lit("Field "), "o_orderpriority").alias("name")
    ).distinct()
    return build.task_preview(actions, lists, people, held).select("id", "list_name", "assignee_name", "custom_field_name", "due")
