"""Dependency graphs and trees.

Levels, closures, cycles and trees take a number of rounds that grows with the logarithm of their depth (``fixpoint`` and
``tours``). Loop state is written to the reliable checkpoint folder each round, so plans stay short and a lost executor
does not restart the loop.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.fixpoint import keep, solve
from waybill.operators.ordered import global_rank, group_apart
from waybill.operators.tours import preorder
from waybill.session import materialize
from waybill.sources.sinks import stored


def duplicate_actions(actions: DataFrame) -> DataFrame:
    return actions.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def missing_dependencies(actions: DataFrame, deps: DataFrame) -> DataFrame:
    """Dependencies (action_id, depends_on) on actions that are not in the plan."""
    return deps.join(actions.select(F.col("id").alias("depends_on")), "depends_on", "left_anti")


def _inside(nodes: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and their dependencies on each other.

    A dependency on something outside the plan blocks nothing here; ``missing_dependencies`` names it.
    """
    ids = materialize(nodes.select("id").distinct())
    edges = deps.select(F.col("action_id").alias("id"), F.col("depends_on").alias("dep")).distinct()
    edges = edges.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("dep")), "dep", "left_semi")
    return ids, materialize(edges.select("id", "dep"))


def dependency_levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Wave number of each node: one more than the latest wave it depends on.

    Members of a cycle and what waits behind one have no level and no row.
    """
    ids, edges = _inside(nodes, deps)
    levels, stuck = solve(ids.withColumn("value", F.lit(0).cast("long")), edges)
    return levels.join(stuck.select("id").distinct(), "id", "left_anti").select("id", F.col("value").cast("int").alias("level"))


def cycle_check(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Nodes that never become free: id, component, in_cycle.

    ``component`` is the smallest id of the nodes that wait for each other, ``in_cycle`` says whether the node waits for
    itself. Nodes behind a cycle are components of their own and not in one.
    """
    # Most dependencies are on what waits for nothing: they go before anything is joined or made distinct.
    edges = materialize(_leading(deps.select(F.col("action_id").alias("id"), F.col("depends_on").alias("dep"))).distinct())
    ids = materialize(nodes.select("id").join(_ends(edges), "id", "left_semi").distinct())
    edges = materialize(_among(edges, ids))
    _, left = solve(ids.withColumn("value", F.lit(0).cast("long")), edges)
    stuck = materialize(left.select("id").distinct())
    edges = materialize(_among(edges, stuck))
    # What no cycle waits for in its turn is only behind one.
    turned = materialize(_leading(_turned(edges)))
    _, left = solve(_ends(turned).withColumn("value", F.lit(0).cast("long")), turned)
    core = materialize(left.select("id").distinct())
    found = components(core, materialize(_among(edges, core)))
    return stuck.join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")
    )


def _leading(edges: DataFrame) -> DataFrame:
    """Edges (id, dep) to nodes that have an edge of their own; the others hold up nothing.

    The nodes are stored, so their size is known: if they are few, the edges are filtered where they are read.
    """
    return edges.join(stored(edges.select(F.col("id").alias("dep")).distinct(), "heads"), "dep", "left_semi").select("id", "dep")


def _ends(edges: DataFrame) -> DataFrame:
    return stored(edges.select("id").unionByName(edges.select(F.col("dep").alias("id"))).distinct(), "ends")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dep").alias("id"), F.col("id").alias("dep"))


def _among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (id, dep) with both ends in ``ids``."""
    ends = ids.select("id")
    return edges.join(ends, "id", "left_semi").join(ends.withColumnRenamed("id", "dep"), "dep", "left_semi").select("id", "dep")


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components (id, component, in_cycle) by forward-backward colouring.

    The largest id that reaches a node is its colour. Of the nodes of one colour, those that reach the node which gave
    it are a component. They leave, and what is left is coloured again.
    """
    done = None
    looped = edges.where(F.col("id") == F.col("dep")).select("id").distinct().withColumn("_loop", F.lit(True))
    while not ids.isEmpty():
        colours, _ = solve(ids.withColumn("value", F.col("id")), edges, keep, settles=False)
        mine = colours.select("id", F.col("value").alias("colour"))
        theirs = colours.select(F.col("id").alias("dep"), F.col("value").alias("_colour"))
        same = edges.join(mine, "id").join(theirs, "dep").where(F.col("colour") == F.col("_colour")).select("id", "dep")
        # Backwards from the node that gave the colour: who has a value reaches it.
        start = mine.select("id", F.when(F.col("id") == F.col("colour"), F.lit(True)).alias("value"))
        reached, _ = solve(start, _turned(same), keep, settles=False)
        members = mine.join(reached.where("value").select("id"), "id")
        names = group_apart(members, ["colour"], F.min("id").alias("component"), F.count("*").alias("_n"))
        part = members.join(names, "colour").join(looped, "id", "left").select(
            "id", "component", ((F.col("_n") > 1) | F.coalesce("_loop", F.lit(False))).alias("in_cycle")
        )
        part = materialize(part)
        done = part if done is None else done.unionByName(part)
        ids = materialize(ids.join(part.select("id"), "id", "left_anti"))
        edges = materialize(_among(edges, ids))
    return done if done is not None else ids.select("id", F.col("id").alias("component"), F.lit(False).alias("in_cycle"))


def ready_actions(actions: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending actions whose dependencies are all succeeded or skipped. actions: id, seq, status."""
    done = actions.select(
        F.col("id").alias("depends_on"), F.col("status").isin("succeeded", "skipped").alias("_done")
    )
    open_ = (
        deps.join(done, "depends_on", "left").where(~F.coalesce("_done", F.lit(False)))
        .select(F.col("action_id").alias("id")).distinct()
    )
    return actions.where(F.col("status") == "pending").join(open_, "id", "left_anti")


def blocked_closure(actions: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending actions downstream of a failed one. Only pending actions pass the block on."""
    state = actions.select("id", "status")
    pending = state.where(F.col("status") == "pending").select("id").distinct()
    edges = deps.select(F.col("action_id").alias("id"), F.col("depends_on").alias("dep")).distinct().join(pending, "id", "left_semi")
    failed = state.where(F.col("status") == "failed").select(F.col("id").alias("dep")).distinct()
    hit = edges.join(failed, "dep", "left_semi").select("id").distinct().withColumn("value", F.lit(True))
    found, _ = solve(pending.join(hit, "id", "left"), materialize(_among(edges, pending)), keep, settles=False, once=True)
    return found.where("value").select("id")


def flatten_pages(pages: DataFrame) -> DataFrame:
    """All pages with depth and root; those within or below a cycle of parents have neither.

    A page whose parent is not in the table is a root. Rounds grow with the logarithm of the depth.
    """
    keys = materialize(pages.select("key").distinct())
    edges = pages.select(F.col("key").alias("id"), F.col("parent").alias("dep")).where(F.col("dep").isNotNull()).distinct()
    edges = materialize(edges.join(keys.select(F.col("key").alias("dep")), "dep", "left_semi").select("id", "dep"))
    root = F.struct(F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    start = keys.withColumnRenamed("key", "id").join(edges.select("id").distinct().withColumn("_below", F.lit(True)), "id", "left")
    start = start.select("id", F.when(F.col("_below").isNull(), root).alias("value"))
    below = lambda value, length: F.when(value.isNotNull(), F.struct(value["root"].alias("root"), (value["depth"] + length).alias("depth")))
    found, _ = solve(start, edges, below)
    return pages.join(
        found.select(F.col("id").alias("key"), F.col("value.depth").cast("int").alias("depth"), F.col("value.root").alias("root")), "key", "left"
    ).select(*pages.columns, "depth", "root")


def tree_emit_order(pages: DataFrame) -> DataFrame:
    """1-based position of each page: parents before children, siblings in order, pages without a root last, by key."""
    flat = materialize(flatten_pages(pages))
    reached = flat.where(F.col("depth").isNotNull())
    keys = flat.select(F.col("key").alias("parent")).distinct().withColumn("_known", F.lit(True))
    # Siblings are ranked below the parent in the table; pages that name another parent are roots.
    placed = reached.join(keys, "parent", "left").withColumn("_up", F.when(F.col("_known"), F.col("parent")))
    order = preorder(placed.select("key", F.col("_up").alias("up"), "pos", "title"))
    first = flat.join(order, "key")
    left = global_rank(flat.where(F.col("depth").isNull()), [F.col("key")], "position")
    last = left.withColumn("position", F.col("position") + F.lit(reached.count()))
    return first.unionByName(last.select(*first.columns))


def sibling_order(children: DataFrame, mentions: DataFrame) -> DataFrame:
    """Children in the order their parent mentions them, unmentioned last, then by title.

    children: key, parent, title. mentions: parent, key, pos; the first mention counts. The ordinal
    is a global rank less the rank at which the parent starts, so no parent is gathered in one task.
    """
    first = mentions.groupBy("parent", "key").agg(F.min("pos").alias("_pos"))
    last = F.lit(2**62)
    joined = children.join(first, ["parent", "key"], "left").withColumn("_pos", F.coalesce("_pos", last))
    ranked = global_rank(joined, [F.col(c) for c in ("parent", "_pos", "title", "key")], "_rank")
    starts = group_apart(ranked, ["parent"], F.min("_rank").alias("_start"))
    return ranked.join(starts, "parent").withColumn(
        "ordinal", F.col("_rank") - F.col("_start") + 1
    ).drop("_rank", "_start", "_pos")


def crawl_tree(
    roots: DataFrame, links: DataFrame, max_pages: int
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first crawl: pages read with their depth, and the known pages left unread.

    roots: key, pos. links: parent, key, pos. A page met twice keeps its first place. The page
    limit is the feature: what it leaves unread is returned, never dropped.
    """
    links = materialize(links.select("parent", "key", "pos"))
    path0 = F.array(F.struct("pos", "key"))
    frontier = materialize(roots.select("key", path0.alias("path")))
    read: list[DataFrame] = []
    unread = frontier.limit(0)
    left = max_pages
    for depth in count():
        size = frontier.count()
        if size == 0:
            break
        taken = frontier
        if size > left:
            taken = materialize(frontier.orderBy("path").limit(left))
            unread = frontier.join(taken.select("key"), "key", "left_anti")
        read.append(taken.select("key", "path", F.lit(depth).alias("depth")))
        left -= min(size, left)
        seen = reduce(DataFrame.unionByName, [r.select("key") for r in read])
        below = (
            links.join(taken.select(F.col("key").alias("parent"), F.col("path").alias("_p")), "parent")
            .select("key", F.concat("_p", F.array(F.struct("pos", "key"))).alias("path"))
            .groupBy("key").agg(F.min("path").alias("path"))
            .join(seen, "key", "left_anti")
        )
        if left == 0:
            rest = below.join(unread.select("key"), "key", "left_anti")
            return reduce(DataFrame.unionByName, read), unread.unionByName(rest)
        frontier = materialize(below)
    empty = roots.select("key", path0.alias("path"), F.lit(0).alias("depth")).limit(0)
    return (reduce(DataFrame.unionByName, read) if read else empty), unread
