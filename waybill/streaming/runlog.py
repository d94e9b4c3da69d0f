"""Structured Streaming operators over the run event log.

Every operator takes a streaming DataFrame with ``ts`` as TIMESTAMP and returns a streaming
DataFrame; rows later than the watermark are dropped, so the batch operators stay the authority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab

LATENESS = f"{vocab.CLOCK_SKEW_SECONDS} seconds"


def event_counts(events: DataFrame, size: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Events per type and tumbling window."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n")
    )


def request_rate(
    events: DataFrame, budget: int, size: str = "1 minute", slide: str = "10 seconds",
    lateness: str = LATENESS,
) -> DataFrame:
    """Requests per sliding window and whether they exceed the budget."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide))
        .agg(F.count("*").alias("requests"))
        .select(F.col("window.start").alias("start"), "requests", (F.col("requests") > budget).alias("over"))
    )


def activity_sessions(events: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Bursts of activity of a run, separated by idle gaps."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "run_id")
        .agg(F.count("*").alias("n"))
        .select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def activity_slices(events: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """First and last instant and number of a run's events by slices of time as wide as the idle gap. Output in update mode.

    Events of one slice are never further apart than the gap, so a slice lies within one burst whatever stands around
    it. The state is three values per (run, slice) and leaves with the watermark; a run with a third of all events is
    as many keys as it has slices, and its events are combined before they are shuffled.
    """
    return (
        events.withWatermark("ts", lateness).groupBy("run_id", F.window("ts", gap).alias("slice"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
        .select("run_id", F.col("slice.start").alias("slice"), "first", "last", "n")
    )


def bursts_of_slices(slices: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Closed bursts (run_id, start, end, n) from ``activity_slices``: those whose idle gap the watermark has passed.

    Neighbouring slices of a run join unless more than the gap lies between them. Only slices are ordered inside a
    run, never events. Rows without an instant take no part; a null run is a run of its own.
    """
    idle = F.expr(f"INTERVAL {gap}")
    order = Window.partitionBy("run_id").orderBy("slice")
    apart = F.col("first") > F.lag("last").over(order) + idle
    numbered = slices.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_burst", F.sum("_new").over(order))
    bursts = numbered.groupBy("run_id", "_burst").agg(
        F.min("first").alias("start"), (F.max("last") + idle).alias("end"), F.sum("n").alias("n")
    )
    mark = slices.agg((F.max("last") - F.expr(f"INTERVAL {lateness}")).alias("_mark"))
    return bursts.join(F.broadcast(mark), F.col("end") <= F.col("_mark")).select("run_id", "start", "end", "n")


def checkpoint_state(transitions: DataFrame) -> DataFrame:
    """Current state per action from a stream of transitions (run_id, action_id, seq, event). Output in update mode.

    Success is final whatever its order number and whenever it arrives; attempts are the writes started before it.
    The state (first success, last event, order numbers of started writes) is a streaming aggregate, so it does not
    depend on how the stream is cut into batches, and a transition that is delivered twice counts once.
    """
    event, seq = F.col("event"), F.col("seq")
    folded = transitions.groupBy("run_id", "action_id").agg(
        F.min(F.when(event == "succeeded", seq)).alias("_done"),
        F.max(F.struct("seq", "event")).alias("_last"),
        F.collect_set(F.when(event == "in_flight", seq)).alias("_started"),
    )
    before = F.filter("_started", lambda s: F.col("_done").isNull() | (s < F.col("_done")))
    return folded.select(
        "run_id", "action_id",
        F.when(F.col("_done").isNotNull(), F.lit("succeeded")).otherwise(F.col("_last.event")).alias("status"),
        F.size(before).cast("long").alias("attempts"),
        F.col("_last.seq").alias("seq"),
    )


# Order numbers that one row of the breaker's state covers; a run has one row for each such stretch that it has marks in.
BREAKER_WIDTH = 1024


def breaker_marks(events: DataFrame, width: int = BREAKER_WIDTH) -> DataFrame:
    """Successes and failures of each run by stretches of order numbers (run_id, stretch, marks). Output in update mode.

    A stretch holds ``width`` order numbers at most, so no row of the state grows without bound, and a run with a third
    of all events is many keys. Marks are a set: however the stream is cut into batches, in whatever order its rows
    come and however often, the last version of each row is the same.
    """
    marks = events.where(F.col("type").isin("action_succeeded", "action_failed"))
    stretch = F.floor(F.col("seq") / F.lit(width)).cast("long")
    return marks.groupBy("run_id", stretch.alias("stretch")).agg(
        F.array_sort(F.collect_set(F.struct("seq", (F.col("type") == "action_failed").alias("failed")))).alias("marks")
    )


def breaker_alarms(marks: DataFrame, limit: int = vocab.BREAKER_LIMIT) -> DataFrame:
    """A row (run_id, seq, failures) wherever a run reaches ``limit`` failures in a row, from ``breaker_marks``.

    Stretches are folded as runs of failures at their end (or throughout): one row per stretch is all that is ordered
    inside a run. What a stretch starts with is the failures so far less those up to the last success before it.
    """
    failed = F.filter("marks", lambda m: m["failed"])
    last = F.array_max(F.transform(F.filter("marks", lambda m: ~m["failed"]), lambda m: m["seq"]))
    folded = marks.select(
        "run_id", "stretch", "marks", F.size(failed).cast("long").alias("_n"), last.alias("_last"),
    ).withColumn("_back", F.size(F.filter("marks", lambda m: m["failed"] & (F.col("_last").isNull() | (m["seq"] > F.col("_last"))))).cast("long"))
    order = Window.partitionBy("run_id").orderBy("stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = folded.withColumn("_sum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reset = F.when(F.col("_last").isNotNull(), F.col("_sum") - F.col("_back"))
    zero = F.lit(0).cast("long")
    carried = sums.withColumn("_carry", F.coalesce(F.max("_sum").over(before), zero) - F.coalesce(F.max(reset).over(before), zero))
    start = F.struct(F.col("_carry").alias("n"), F.array().cast("array<bigint>").alias("hits"))

    def count(state: Column, mark: Column) -> Column:
        n = F.when(mark["failed"], state["n"] + 1).otherwise(zero)
        hits = F.when(n == limit, F.concat(state["hits"], F.array(mark["seq"].cast("long")))).otherwise(state["hits"])
        return F.struct(n.alias("n"), hits.alias("hits"))

    hits = F.aggregate("marks", start, count, lambda state: state["hits"])
    return carried.select("run_id", F.explode(hits).alias("seq"), F.lit(limit).cast("long").alias("failures"))


def first_mappings(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of mappings (source_key, scope, destination_id, ts) adds to an id map, and what it contradicts.

    The earliest mapping of a (key, scope) holds for good; another destination for it is a conflict.
    """
    keys = ["source_key", "scope"]
    first = batch.groupBy(*keys).agg(F.min(F.struct("ts", "destination_id"))["destination_id"].alias("destination_id"))
    new = first.join(held.select(*keys), keys, "left_anti")
    mapped = held.unionByName(new).select(*keys, F.col("destination_id").alias("mapped_to"))
    conflicts = batch.select(*keys, "destination_id").distinct().join(mapped, keys)
    return new, conflicts.where(F.col("destination_id") != F.col("mapped_to"))


def progress(events: DataFrame) -> DataFrame:
    """Running done and total per run (complete mode; one row per run)."""
    done = F.col("type").isin("action_succeeded", "action_skipped")
    return events.groupBy("run_id").agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def adoption(
    planned: DataFrame, seen: DataFrame, skew_seconds: int = vocab.CLOCK_SKEW_SECONDS, how: str = "inner",
) -> DataFrame:
    """Planned keys matched to markers seen at the destination within the clock allowance.

    planned: key, planned_at. seen: marker, item_id, seen_at. An interval join with watermarks on
    both sides, so the state of either side is bounded.
    """
    window = f"{skew_seconds} seconds"
    left = planned.withWatermark("planned_at", window)
    right = seen.withWatermark("seen_at", window)
    near = (
        (F.col("key") == F.col("marker"))
        & (F.col("seen_at") >= F.col("planned_at") - F.expr(f"INTERVAL {window}"))
        & (F.col("seen_at") <= F.col("planned_at") + F.expr(f"INTERVAL {window}"))
    )
    return left.join(right, near, how).drop("marker")


def adoption_verdicts(planned: DataFrame, seen: DataFrame, skew_seconds: int = vocab.CLOCK_SKEW_SECONDS) -> DataFrame:
    """One verdict (none, one, several) per planned write, given once the clock allowance around it has passed.

    planned: key, planned, planned_at. seen: marker, item_id, seen_at. ``item_id`` is the item to adopt, and null
    unless exactly one was seen; an item that is seen again still counts as one. A planned write that is delivered
    twice gives one row. The join's state leaves with the watermarks, and a verdict's state is the least and the
    greatest item, however many were seen.
    """
    matched = adoption(planned, seen, skew_seconds, "left_outer")
    folded = matched.groupBy("key", "planned", "planned_at").agg(
        F.min("item_id").alias("_least"), F.max("item_id").alias("_most")
    )
    one = F.col("_least") == F.col("_most")
    verdict = F.when(F.col("_least").isNull(), F.lit("none")).when(one, F.lit("one")).otherwise(F.lit("several"))
    return folded.select("key", "planned", "planned_at", verdict.alias("verdict"), F.when(one, F.col("_least")).alias("item_id"))
