"""Least solutions of ``x(v) = max(base(v), x(u) + w over edges u -> v)`` in logarithmic rounds.

A round sends every value over one edge and then replaces edges by paths: an edge into ``v`` from ``u`` becomes one from
each node that ``u`` waits for. Lengths of paths double, so a chain of n nodes takes log2(n) rounds. Nodes that wait for
one other never add an edge this way, so chains and trees contract; nodes that wait for several are replaced as long as
the edges stay within a fixed multiple of what they were, else their edges stay and only values move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.session import materialize

# Edges that may stand for one edge of the input.
GROWTH = 4
LIMITS = [2**k for k in range(0, 24)]


def add(value: Column, length: Column) -> Column:
    return value + length


def keep(value: Column, length: Column) -> Column:
    return value


def _merged(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("id", "dep").agg(F.max("w").alias("w")))


def _replaced(edges: DataFrame, budget: int) -> DataFrame:
    """Edges with paths over their middle nodes in place of them; edges from nodes that wait for nothing are gone."""
    waits = edges.groupBy(F.col("id").alias("dep")).agg(F.count("*").alias("n"))
    counted = edges.join(waits, "dep")
    sizes = counted.agg(*[
        F.sum(F.when(F.col("n") <= limit, F.col("n")).otherwise(1)).alias(f"_{limit}") for limit in LIMITS
    ]).first()
    limit = max((k for k in LIMITS if (sizes[f"_{k}"] or 0) <= budget), default=1)
    ahead = edges.select(F.col("id").alias("dep"), F.col("dep").alias("_from"), F.col("w").alias("_w"))
    paths = counted.where(F.col("n") <= limit).join(ahead, "dep").select("id", F.col("_from").alias("dep"), (F.col("w") + F.col("_w")).alias("w"))
    return _merged(paths.unionByName(counted.where(F.col("n") > limit).select("id", "dep", "w")))


def solve(
    base: DataFrame, edges: DataFrame, step: Callable[[Column, Column], Column] = add, settles: bool = True, once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Solution (id, value) and the edges that are left over.

    ``base`` (id, value) has every node once, its value may be null; ``edges`` are (id, dep), of nodes in ``base``.
    ``step`` makes the value that arrives over a path from the value and the number of its edges. With ``settles``, rounds
    end when one frees no node: then all that are left wait for a cycle, and their values say nothing. Without it they end where no value changes, which suits steps that add nothing. With ``once`` the first
    value of a node is its last one (any value is as good as another).
    """
    base = materialize(base)
    edges = _merged(edges.select("id", "dep", F.lit(1).cast("long").alias("w")))
    budget = GROWTH * edges.count()
    waiting = None
    while not edges.isEmpty():
        if settles:
            # Of nodes behind no cycle some wait for nothing but what waits for nothing; a round frees these at least.
            before, waiting = waiting, edges.agg(F.count_distinct("id")).first()[0]
            if waiting == before:
                break
        values = base.where(F.col("value").isNotNull()).select(F.col("id").alias("dep"), "value")
        sent = edges.join(values, "dep").groupBy("id").agg(F.max(step(F.col("value"), F.col("w"))).alias("_sent"))
        after = materialize(base.join(sent, "id", "left").select(
            "id", F.greatest("value", "_sent").alias("value"), F.expr("_sent > value or (_sent is not null and value is null)").alias("_new")
        ))
        changed = settles or not after.where("_new").isEmpty()
        base = after.drop("_new")
        if not changed:
            break
        if once:
            edges = edges.join(base.where(F.col("value").isNotNull()).select("id"), "id", "left_anti")
            # Nodes with a value wait for nothing any more, but have yet to send it.
            told = edges.join(base.where(F.col("value").isNotNull()).select(F.col("id").alias("dep")), "dep", "left_semi")
            edges = _merged(_replaced(materialize(edges), budget).unionByName(told.select("id", "dep", "w")))
        else:
            edges = _replaced(edges, budget)
    return base, edges
