"""Positions in trees by an Euler tour, ranked by pointer jumping.

The tour enters and leaves every page that has children. Pages without children need no stop of their own: they follow
their last sibling before them that has some, or their parent, by a number of steps that is known from the sibling order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.ordered import global_rank, running_count, running_max
from waybill.session import materialize


def list_rank(stops: DataFrame) -> DataFrame:
    """(at, rest): the sum of ``w`` from each stop to the end of its list. stops: at, next (null at an end), w.

    Each round a stop adds what its next one has, and goes on to where that one points; rounds are the logarithm of the
    longest list. Stops that reached the end are not joined again.
    """
    done, live = None, materialize(stops.select("at", "next", F.col("w").cast("long").alias("rest")))
    while True:
        ended = live.where(F.col("next").isNull()).select("at", "rest")
        done = ended if done is None else materialize(done.unionByName(ended))
        going = live.where(F.col("next").isNotNull())
        if going.isEmpty():
            return done
        known = going.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("rest").alias("_rest")).unionByName(
            done.select(F.col("at").alias("next"), F.lit(None).cast("long").alias("_next"), F.col("rest").alias("_rest"))
        )
        live = materialize(going.join(known, "next").select("at", F.col("_next").alias("next"), (F.col("rest") + F.col("_rest")).alias("rest")))


def preorder(pages: DataFrame) -> DataFrame:
    """(key, position): 1-based, parents before children, siblings by pos, title, key. pages: key, up, pos, title.

    ``up`` is the key of the parent, null for roots; every page must lie below a root. The order of siblings is one
    range-partitioned sort, so neither a parent of very many pages nor a very deep page is a case of its own.
    """
    ranked = global_rank(pages.select("key", "up", "pos", "title"), [F.col(c) for c in ("up", "pos", "title", "key")], "r").select("key", "up", "r")
    parents = pages.where(F.col("up").isNotNull()).select(F.col("up").alias("key")).distinct().withColumn("inner", F.lit(True))
    ranked = ranked.join(parents, "key", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    counted = running_count(ranked, [], "r", F.col("inner"), "q")
    marked = materialize(running_max(counted, [], "r", F.when(F.col("inner"), F.col("r")), "last", 0))
    # Per parent (null: of the roots): its first page, its first page with children, and the pages before that one.
    groups = marked.groupBy("up").agg(
        F.min("r").alias("first"), F.max("r").alias("end"), F.min(F.when(F.col("inner"), F.col("r"))).alias("inner_r"),
        F.min(F.when(F.col("inner"), F.col("q"))).alias("inner_q"),
    ).withColumn("lead", F.coalesce("inner_r", F.col("end") + 1) - F.col("first"))
    groups = materialize(groups)
    below = groups.where(F.col("up").isNotNull()).select(F.col("up").alias("key"), "lead", "inner_q")
    inner = marked.where("inner").select("key", "up", "r", "q").join(below, "key")
    above = inner.select(F.col("key").alias("up"), F.col("q").alias("up_q"))
    after = inner.select((F.col("q") - 1).alias("q"), F.col("up").alias("next_up"), F.col("r").alias("next_r"))
    ends = groups.select(F.col("up").alias("_up"), F.col("end"))
    inner = inner.join(above, "up", "left").join(after, "q", "left").join(ends, F.col("up").eqNullSafe(F.col("_up"))).drop("_up")
    sibling = F.col("next_r").isNotNull() & F.col("up").eqNullSafe(F.col("next_up"))
    enter, leave = F.col("q") * 2, F.col("q") * 2 + 1
    stops = inner.select(
        enter.alias("at"), F.coalesce(F.col("inner_q") * 2, leave).alias("next"), (F.col("lead") + 1).alias("w")
    ).unionByName(inner.select(
        leave.alias("at"), F.when(sibling, F.col("q") * 2 + 2).otherwise(F.col("up_q") * 2 + 1).alias("next"),
        (F.when(sibling, F.col("next_r")).otherwise(F.col("end") + 1) - F.col("r") - 1).alias("w"),
    ))
    rest = materialize(list_rank(stops))
    # The roots before the first one with children come before the tour.
    begin = rest.select("at", (F.lit(marked.count()) - F.col("rest")).alias("begin"))
    here = marked.where("inner").select("key", (F.col("q") * 2).alias("at")).join(begin, "at").select("key", (F.col("begin") + 1).alias("position"))
    starts = groups.select(F.col("up").alias("_up"), "first")
    leaves = marked.where(~F.col("inner")).join(starts, F.col("up").eqNullSafe(F.col("_up"))).drop("_up")
    sibling_before = F.col("last") >= F.col("first")
    follow = leaves.where(sibling_before).select("key", (F.col("q") * 2 + 1).alias("at"), (F.col("r") - F.col("last")).alias("offset"))
    numbers = inner.select(F.col("key").alias("up"), (F.col("q") * 2).alias("at"))
    under = leaves.where(~sibling_before & F.col("up").isNotNull()).join(numbers, "up").select("key", "at", (F.col("r") - F.col("first") + 2).alias("offset"))
    free = leaves.where(~sibling_before & F.col("up").isNull()).select("key", (F.col("r") - F.col("first") + 1).alias("position"))
    placed = follow.unionByName(under).join(begin, "at").select("key", (F.col("begin") + F.col("offset")).alias("position"))
    return here.unionByName(placed).unionByName(free)
