"""Dependency graphs, closures and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators import graph
from workload.registry import query
from workload.tables import PAGE_TREE, Tables, with_


def tree_actions(t: Tables) -> DataFrame:
    """Pages as actions: nations fail or succeed by their key, the rest is pending."""
    pos = F.col("pos")
    is_ = lambda kind: F.contains("key", F.lit(f":{kind}:"))
    status = (
        F.when(is_("region"), F.when(pos == 3, F.lit("failed")).otherwise(F.lit("succeeded")))
        .when(is_("nation"), F.when(pos % 7 == 0, F.lit("failed")).when(pos % 5 == 0, F.lit("skipped")).otherwise(F.lit("pending")))
        .otherwise(F.when(pos % 4 == 0, F.lit("succeeded")).otherwise(F.lit("pending")))
    )
    return t.page_tree.select(F.col("key").alias("id"), pos.alias("seq"), "parent", status.alias("status"))


TREE_ACTIONS = """tree_actions AS (
  SELECT key AS id, pos AS seq, parent, CASE WHEN key LIKE '%:region:%' THEN CASE WHEN pos = 3 THEN 'failed' ELSE 'succeeded' END
    WHEN key LIKE '%:nation:%' THEN CASE WHEN pos % 7 = 0 THEN 'failed' WHEN pos % 5 = 0 THEN 'skipped' ELSE 'pending' END
    WHEN pos % 4 = 0 THEN 'succeeded' ELSE 'pending' END AS status FROM page_tree)"""


def tree_deps(t: Tables) -> DataFrame:
    return t.page_tree.where(F.col("parent").isNotNull()).select(F.col("key").alias("action_id"), F.col("parent").alias("depends_on"))


@query(
    "duplicate_actions",
    "SELECT l_orderkey || '/' || l_linenumber AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicate_actions(t: Tables) -> DataFrame:
    return graph.duplicate_actions(t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id")))


@query(
    "missing_dependencies",
    """
WITH d AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
SELECT 'act_' || o_orderkey AS action_id, 'act_' || prev AS depends_on FROM d WHERE prev % 8 = 0""",
)
def missing_dependencies(t: Tables) -> DataFrame:
    # Orders of one customer are few next to the table; the demo needs the previous one.
    previous = F.lag("seq").over(Window.partitionBy("o_custkey").orderBy("seq"))
    deps = t.actions.select("id", previous.alias("prev")).where(F.col("prev").isNotNull()).select(
        F.col("id").alias("action_id"), F.concat(F.lit("act_"), "prev").alias("depends_on")
    )
    return graph.missing_dependencies(t.actions.where(F.col("seq") % 8 != 0), deps)


@query(
    "cycle_check",
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS d FROM lineitem),
core AS (SELECT a, d FROM e WHERE d IN (SELECT a FROM e)),
reach AS (SELECT a, d FROM core UNION SELECT r.a, c.d FROM reach r JOIN core c ON r.d = c.a),
cyc AS (SELECT DISTINCT a AS id FROM reach WHERE a = d),
pair AS (SELECT x.a AS id, x.d AS other FROM reach x JOIN reach y ON x.a = y.d AND x.d = y.a)
SELECT id, min(other) AS component, true AS in_cycle FROM pair GROUP BY id
UNION ALL SELECT DISTINCT r.a, r.a, false FROM reach r JOIN cyc ON cyc.id = r.d WHERE r.a NOT IN (SELECT id FROM cyc)""",
)
def cycle_check(t: Tables) -> DataFrame:
    """Suppliers depend on parts in one key space: those that can never start, and the cycles among them."""
    deps = t.edges.select(F.col("to_id").alias("action_id"), F.col("from_id").alias("depends_on"))
    nodes = t.edges.select(F.col("to_id").alias("id")).unionByName(t.edges.select(F.col("from_id").alias("id")))
    return graph.cycle_check(nodes, deps)


@query(
    "dependency_levels",
    with_(PAGE_TREE) + "SELECT key AS id, CASE WHEN key LIKE '%:region:%' THEN 0 WHEN key LIKE '%:nation:%' THEN 1 ELSE 2 END AS level FROM page_tree",
)
def dependency_levels(t: Tables) -> DataFrame:
    return graph.dependency_levels(t.page_tree.select(F.col("key").alias("id")), tree_deps(t))


@query(
    "ready_actions",
    with_(PAGE_TREE, TREE_ACTIONS) + """
SELECT a.id, a.seq FROM tree_actions a LEFT JOIN tree_actions p ON a.parent = p.id
WHERE a.status = 'pending' AND (a.parent IS NULL OR p.status IN ('succeeded', 'skipped'))""",
)
def ready_actions(t: Tables) -> DataFrame:
    return graph.ready_actions(tree_actions(t), tree_deps(t)).select("id", "seq")


@query(
    "blocked_closure",
    "WITH RECURSIVE " + PAGE_TREE + ", " + TREE_ACTIONS + """
, b AS (SELECT c.id FROM tree_actions c JOIN tree_actions p ON c.parent = p.id WHERE p.status = 'failed' AND c.status = 'pending'
  UNION SELECT c.id FROM b JOIN tree_actions c ON c.parent = b.id WHERE c.status = 'pending')
SELECT id FROM b""",
)
def blocked_closure(t: Tables) -> DataFrame:
    return graph.blocked_closure(tree_actions(t).select("id", "status"), tree_deps(t))


@query(
    "crawl_tree",
    with_(PAGE_TREE) + """
, o AS (SELECT p.key, CASE WHEN p.key LIKE '%:region:%' THEN 0 WHEN p.key LIKE '%:nation:%' THEN 1 ELSE 2 END AS depth,
    coalesce(g.pos, q.pos, p.pos) AS k1, CASE WHEN g.key IS NOT NULL THEN q.pos WHEN q.key IS NOT NULL THEN p.pos END AS k2, CASE WHEN g.key IS NOT NULL THEN p.pos END AS k3
  FROM page_tree p LEFT JOIN page_tree q ON p.parent = q.key LEFT JOIN page_tree g ON q.parent = g.key),
r AS (SELECT *, row_number() OVER (ORDER BY depth, k1, k2, k3) AS rn FROM o)
SELECT key, depth, rn <= 100 AS read FROM r""",
)
def crawl_tree(t: Tables) -> DataFrame:
    roots = t.page_tree.where(F.col("parent").isNull()).select("key", "pos")
    links = t.page_tree.where(F.col("parent").isNotNull()).select("parent", "key", "pos")
    read, unread = graph.crawl_tree(roots, links, max_pages=100)
    depth = F.size("path") - 1
    return read.select("key", "depth", F.lit(True).alias("read")).unionByName(
        unread.select("key", depth.alias("depth"), F.lit(False).alias("read"))
    )


@query(
    "tree_emit_order",
    with_(PAGE_TREE) + """
, o AS (SELECT p.key, coalesce(g.pos, q.pos, p.pos) AS k1, CASE WHEN g.key IS NOT NULL THEN q.pos WHEN q.key IS NOT NULL THEN p.pos END AS k2,
    CASE WHEN g.key IS NOT NULL THEN p.pos END AS k3
  FROM page_tree p LEFT JOIN page_tree q ON p.parent = q.key LEFT JOIN page_tree g ON q.parent = g.key)
SELECT key, row_number() OVER (ORDER BY k1, k2 NULLS FIRST, k3 NULLS FIRST)::BIGINT AS position FROM o""",
)
def tree_emit_order(t: Tables) -> DataFrame:
    return graph.tree_emit_order(t.page_tree).select("key", "position")
