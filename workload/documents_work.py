"""Pages as tables: normalizing, limits, findings, Markdown, and the actions built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators import cells, documents as docs, graph
from waybill.plans import build
from workload.registry import query
from workload.tables import EDGES, FINDINGS, PAGE_TREE, PRICE_TEXT, RAW_BLOCKS, RECORDS, Tables, key_of, with_


def raw_pages(t: Tables) -> DataFrame:
    """Conversation turns as raw blocks with a JSON payload and a read status."""
    run = F.struct(
        F.lit("text").alias("type"), F.col("text").alias("plain_text"),
        F.struct(F.lit(False).alias("bold"), F.lit("default").alias("color")).alias("annotations"),
    )
    icon = F.when(F.col("type") == "callout", F.struct(F.lit("emoji").alias("type"), F.lit("💡").alias("emoji")))
    payload = F.to_json(
        F.struct(F.array(run).alias("rich_text"), (F.col("turn") % 8 == 2).alias("checked"), icon.alias("icon"))
    )
    status = vocab.lookup(
        (F.col("conv_id") * 7 + F.col("turn")) % 9, {0: "inaccessible", 1: "depth_limit", 2: "budget"}, F.lit("ok")
    )
    return t.raw_blocks.withColumn("payload", payload).withColumn("status", status)


def blocks_of(t: Tables) -> DataFrame:
    return docs.normalize_blocks(raw_pages(t), "tpch", "https://h.example/")


KIND = """CASE type WHEN 'heading_4' THEN 'heading' WHEN 'numbered_list_item' THEN 'numberedListItem' WHEN 'to_do' THEN 'toDo'
  WHEN 'meeting_notes' THEN 'unsupported' ELSE type END"""


@query(
    "normalize_blocks",
    with_(RAW_BLOCKS) + f"""
SELECT doc, block_id, parent_id, {KIND} AS kind, type AS source_type, CASE WHEN type = 'heading_4' THEN 4 END AS level,
  CASE WHEN type = 'to_do' THEN turn % 8 = 2 END AS checked, CASE WHEN type = 'callout' THEN '💡' END AS icon, md5(text) AS text_md5,
  CASE WHEN type = 'meeting_notes' THEN 'block type not supported' END AS reason FROM raw_blocks""",
)
def normalize_blocks(t: Tables) -> DataFrame:
    from waybill.functions.richtext import plain_text

    return blocks_of(t).select(
        "doc", "block_id", "parent_id", "kind", "source_type", "level", "checked", "icon",
        F.md5(plain_text(F.col("spans"))).alias("text_md5"), "reason",
    )


@query(
    "block_access_findings",
    with_(RAW_BLOCKS) + """
SELECT doc AS entity, block_id, ['BLOCK_CHILDREN_INACCESSIBLE', 'BLOCK_DEPTH_LIMIT', 'PAGE_BLOCK_BUDGET'][(conv_id * 7 + turn) % 9 + 1] AS code,
  CASE WHEN (conv_id * 7 + turn) % 9 = 0 THEN 'unsupported' ELSE 'lossy' END AS outcome, 'warning' AS severity, type AS field
FROM raw_blocks WHERE (conv_id * 7 + turn) % 9 < 3""",
)
def block_access_findings(t: Tables) -> DataFrame:
    return docs.block_access_findings(raw_pages(t))


@query("depth_limit", with_(RAW_BLOCKS) + "SELECT doc, block_id FROM raw_blocks WHERE depth <= 0")
def depth_limit(t: Tables) -> DataFrame:
    return docs.depth_limit(t.raw_blocks, 0).select("doc", "block_id")


@query(
    "block_budget",
    with_(RAW_BLOCKS) + """
SELECT doc, block_id, NULL AS code FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn) AS rn FROM raw_blocks) WHERE rn <= 3
UNION ALL SELECT doc, NULL, 'PAGE_BLOCK_BUDGET' FROM raw_blocks GROUP BY doc HAVING count(*) > 3""",
)
def block_budget(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    kept = docs.block_budget(t.raw_blocks, 3).select("doc", "block_id", none.alias("code"))
    return kept.unionByName(docs.over_budget(t.raw_blocks, 3).select("doc", none.alias("block_id"), "code"))


def child_blocks(t: Tables) -> DataFrame:
    """Each region and nation page mentions its children as child-page blocks."""
    return t.page_tree.where(F.col("parent").isNotNull()).select(
        F.col("parent").alias("doc"), F.lit("childPage").alias("kind"), F.col("key").alias("target"), "pos",
        F.array(F.col("pos").cast("int")).alias("path"),
    )


@query("child_pages", with_(PAGE_TREE) + "SELECT parent, key, pos FROM page_tree WHERE parent IS NOT NULL")
def child_pages(t: Tables) -> DataFrame:
    return docs.child_pages(child_blocks(t)).select("parent", "key", "pos")


@query("prune_migrated_children", with_(PAGE_TREE) + "SELECT parent AS doc, key AS target FROM page_tree WHERE parent IS NOT NULL AND pos % 3 <> 0")
def prune_migrated_children(t: Tables) -> DataFrame:
    moved = t.page_tree.where(F.col("pos") % 3 == 0)
    return docs.prune_migrated_children(child_blocks(t), moved).select("doc", "target")


@query(
    "flatten_pages",
    with_(PAGE_TREE) + """
SELECT key, parent, CASE WHEN key LIKE '%:region:%' THEN 0 WHEN key LIKE '%:nation:%' THEN 1 ELSE 2 END AS depth FROM page_tree""",
)
def flatten_pages(t: Tables) -> DataFrame:
    return graph.flatten_pages(t.page_tree).select("key", "parent", "depth")


@query(
    "block_findings",
    with_(RAW_BLOCKS) + """
, c AS (SELECT doc, type AS field, CASE type WHEN 'heading_4' THEN 'BLOCK_HEADING_LEVEL_FLATTENED' WHEN 'to_do' THEN 'BLOCK_TODO_AS_TEXT'
    WHEN 'callout' THEN 'BLOCK_CALLOUT_AS_QUOTE' WHEN 'meeting_notes' THEN 'BLOCK_UNSUPPORTED' END AS code FROM raw_blocks
  UNION ALL SELECT p.doc, p.type, 'BLOCK_NESTING_FLATTENED' FROM raw_blocks p WHERE p.type IN ('heading_4', 'paragraph')
    AND EXISTS (SELECT 1 FROM raw_blocks x WHERE x.doc = p.doc AND x.parent_id = p.block_id))
SELECT doc AS entity, code, CASE WHEN code = 'BLOCK_UNSUPPORTED' THEN 'unsupported' ELSE 'lossy' END AS outcome, 'warning' AS severity,
  CASE WHEN code = 'BLOCK_NESTING_FLATTENED' THEN 'formatting' ELSE 'block_type' END AS category, field, count(*)::BIGINT AS count
FROM c WHERE code IS NOT NULL GROUP BY doc, code, field""",
)
def block_findings(t: Tables) -> DataFrame:
    return docs.block_findings(blocks_of(t))


ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(core, '([\\`*_\[\]<>])', '\\\1', 'g'),
  '(?m)^(\s*)(#{1,6})(\s)', '\1\\\2\3', 'g'), '(?m)^(\s*)([-+])(\s)', '\1\\\2\3', 'g'), '(?m)^(\s*)(\d+)([.)])(\s)', '\1\2\\\3\4', 'g')"""
NL = "chr(10)"


@query(
    "render_documents",
    with_(RAW_BLOCKS) + rf"""
, a AS (SELECT *, regexp_extract(text, '^(\s*)', 1) AS lead, regexp_extract(text, '(\s*)$', 1) AS trail, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS core FROM raw_blocks),
b AS (SELECT *, replace(lead || {ESCAPED} || trail, {NL}, '  ' || {NL}) AS inl FROM a),
own AS (SELECT *, CASE type WHEN 'heading_4' THEN '### ' || regexp_replace(inl, '\s*\n\s*', ' ', 'g')
    WHEN 'numbered_list_item' THEN '1. ' || replace(inl, {NL}, {NL} || '    ')
    WHEN 'to_do' THEN CASE WHEN turn % 8 = 2 THEN '- [x] ' ELSE '- [ ] ' END || replace(inl, {NL}, {NL} || '    ')
    WHEN 'meeting_notes' THEN '*[Unsupported block: meeting_notes]*'
    WHEN 'callout' THEN '💡 ' || inl ELSE inl END AS md FROM b),
kid AS (SELECT doc, parent_id AS block_id, md AS kid_md FROM own WHERE parent_id IS NOT NULL),
top AS (SELECT o.doc, o.turn, CASE WHEN kid_md IS NULL THEN CASE WHEN o.type = 'callout' THEN array_to_string(list_transform(string_split(trim(o.md), {NL}), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), {NL}) ELSE o.md END
    WHEN o.type = 'numbered_list_item' THEN o.md || {NL} || array_to_string(list_transform(string_split(kid_md, {NL}), lambda l: CASE WHEN l = '' THEN '' ELSE '    ' || l END), {NL})
    WHEN o.type = 'meeting_notes' THEN o.md
    ELSE o.md || {NL} || {NL} || kid_md END AS md
  FROM own o LEFT JOIN kid k ON k.doc = o.doc AND k.block_id = o.block_id WHERE o.parent_id IS NULL)
SELECT doc, md5(trim(string_agg(md, {NL} || {NL} ORDER BY turn), {NL} || ' ')) AS markdown_md5 FROM top GROUP BY doc""",
)
def render_documents(t: Tables) -> DataFrame:
    return docs.render_documents(blocks_of(t)).select("doc", F.md5("markdown").alias("markdown_md5"))


@query(
    "task_body",
    with_(RECORDS) + rf"""
, d AS (SELECT doc_id, text FROM documents)
SELECT key, md5(coalesce(CASE WHEN trim(d.text) <> '' THEN d.text || '{{R}}' END, '') || '**Properties**{{N}}{{N}}| Property | Value |{{N}}| --- | --- |{{N}}| Status | ' || o_orderstatus || ' |{{N}}| Priority | ' || o_orderpriority ||
  ' |{{N}}| Ordered | ' || created_at || ' |{{N}}| Total \| price | ' || {PRICE_TEXT} || ' |{{R}}_Migrated, created ' || created_at || '._ [Original](https://o.example/' || o_orderkey || '%28x%29){{N}}{{N}}`waybill-key:' || key || '`') AS md5
FROM records LEFT JOIN d ON d.doc_id = o_orderkey""".replace("{R}", "' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '").replace("{N}", "' || chr(10) || '"),
)
def task_body(t: Tables) -> DataFrame:
    records = t.records.select("key", "created_at", F.concat(F.lit("https://o.example/"), "o_orderkey", F.lit("(x)")).alias("url"))
    pages = t.documents.select(key_of("order", "doc_id").alias("key"), F.col("text").alias("markdown"))
    names = {"status": "Status", "priority": "Priority", "ordered": "Ordered", "price": "Total | price"}
    rows = t.cells.select(
        "record", vocab.lookup(F.col("field_id"), {f: k for k, f in enumerate(names)}).alias("pos"),
        vocab.lookup(F.col("field_id"), names).alias("label"), F.col("text").alias("markdown"),
    )
    return build.task_body(records, pages, rows).select("key", F.md5("markdown").alias("md5"))


ACT = "'act_' || left(sha256('{kind}'::BLOB || '\\x00'::BLOB || ({key})::BLOB), 12)"


@query(
    "build_actions",
    with_(RECORDS, FINDINGS) + f"""
, f AS (SELECT entity, max(list_position(['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed'], outcome)) AS p FROM findings GROUP BY entity)
SELECT {ACT.format(kind='create_task', key='key')} AS id, key AS source, 'Create task "Order ' || o_orderkey || '" in list "L"' AS label,
  CASE WHEN o_orderkey % 10 = 0 THEN 'skip' ELSE 'execute' END AS disposition, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS estimated_requests,
  CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN greatest(coalesce(p, 1), CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 1 END) = 5 THEN 'lossy'
    ELSE ['supported', 'skipped', 'transformed', 'lossy', 'unsupported', 'failed'][greatest(coalesce(p, 1), CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 1 END)] END AS outcome
FROM records LEFT JOIN f ON f.entity = key""",
)
def build_actions(t: Tables) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Order\n"), "o_orderkey")).otherwise(F.col("title"))
    records = t.records.select(
        "key", title.alias("title"), F.concat(F.lit("dest:list:"), "o_orderstatus").alias("scope"), F.lit("L").alias("list_name")
    )
    return build.build_actions(records, t.findings, t.id_map).select(
        "id", "source", "label", "disposition", "estimated_requests", "outcome"
    )


@query(
    "build_links",
    with_(EDGES) + f"""
, p AS (SELECT DISTINCT least('p' || from_id, 'p' || to_id) AS a, greatest('p' || from_id, 'p' || to_id) AS b FROM edges WHERE from_id <> to_id)
SELECT {ACT.format(kind='link_tasks', key="'link:' || a || '|' || b")} AS id, 'link:' || a || '|' || b AS idempotency_key, 'act-' || a AS from_action, 'act-' || b AS to_action,
  'execute' AS disposition, 'transformed' AS outcome FROM p""",
)
def build_links(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("p"), c)
    edges = t.edges.select(name("from_id").alias("from_id"), name("to_id").alias("to_id"))
    planned = t.part.select(name("p_partkey").alias("key"), F.concat(F.lit("act-p"), "p_partkey").alias("id"))
    return build.build_links(edges, planned, t.id_map).select(
        "id", "idempotency_key", "from_action", "to_action", "disposition", "outcome"
    )


@query(
    "build_docs",
    with_(PAGE_TREE) + f"""
, r AS (SELECT p.*, CASE WHEN p.parent IS NULL THEN p.key WHEN q.parent IS NULL THEN q.key ELSE q.parent END AS root FROM page_tree p LEFT JOIN page_tree q ON p.parent = q.key)
SELECT {ACT.format(kind='create_doc', key="key || '#doc'")} AS id, 'create_doc' AS kind, key AS source, '' AS deps FROM r WHERE parent IS NULL
UNION ALL SELECT {ACT.format(kind='create_doc_page', key="key || '#page'")}, 'create_doc_page', key,
  {ACT.format(kind='create_doc', key="root || '#doc'")} || coalesce(',' || {ACT.format(kind='create_doc_page', key="parent || '#page'")}, '') FROM r""",
)
def build_docs(t: Tables) -> DataFrame:
    tree = graph.flatten_pages(t.page_tree)
    pages = tree.select("key", "title", F.col("parent").alias("parent_key"), F.col("root").alias("root_key"))
    return build.build_docs(pages, t.id_map, "dest:docs:w").select(
        "id", "kind", "source", F.array_join("depends_on", ",").alias("deps")
    )
