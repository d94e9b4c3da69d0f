"""Run state: checkpoints folded from transitions, counts, phases and the id map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators.ordered import group_apart

FAILURES = ["failed", "ambiguous", "blocked"]


def new_run_rows(actions: DataFrame, run_id: str) -> DataFrame:
    """One checkpoint per action: pending, or skipped with the destination it already has."""
    skipped = F.col("disposition") == "skip"
    return actions.select(
        F.lit(run_id).alias("run_id"), F.col("id").alias("action_id"),
        F.when(skipped, F.lit("skipped")).otherwise(F.lit("pending")).alias("status"),
        F.lit(0).alias("attempts"), F.col("existing_destination_id").alias("destination_id"),
    )


def adopted_mappings(actions: DataFrame, id_map: DataFrame) -> DataFrame:
    """Id-map rows that skipped actions with a destination add: those not already mapped."""
    adopted = actions.where(
        (F.col("disposition") == "skip") & F.col("existing_destination_id").isNotNull()
    ).select(
        F.col("idempotency_key").alias("source_key"), "scope",
        F.col("existing_destination_id").alias("destination_id"),
    )
    return adopted.join(id_map, ["source_key", "scope"], "left_anti")


def fold_checkpoints(transitions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Current state per action from its transitions (seq, event, destination_id, error_code, ts).

    Events: in_flight, succeeded, failed, ambiguous, blocked, pending (a reset). Success is final:
    later transitions change nothing. Attempts count the writes started before success, the
    in-flight time is the first since the last reset, the error the last since the last reset.
    Two combinable aggregations with a join between them. Neither shares the join's partitioning
    (see ``group_apart``), so the adaptive skew join may split a hot action over many tasks, each
    of which sends on one partial row.
    """
    keys = keys or ["run_id", "action_id"]
    event, seq = F.col("event"), F.col("seq")
    when = lambda e: F.when(event == e, seq)
    marks = group_apart(
        transitions, keys,
        F.min(when("succeeded")).alias("_done"),
        F.max(when("pending")).alias("_reset"),
        F.max_by(event, seq).alias("_last"),
        F.max_by(F.when(event == "succeeded", F.col("destination_id")), when("succeeded")).alias("_dest"),
    )
    joined = transitions.join(marks, keys)
    before = F.col("_done").isNull() | (seq < F.col("_done"))
    fresh = F.col("_reset").isNull() | (seq > F.col("_reset"))
    started = (event == "in_flight") & before
    failed = event.isin(*FAILURES) & fresh & F.col("_done").isNull()
    folded = group_apart(
        joined, [*keys, "_done", "_last", "_dest"],
        F.count_if(started).alias("attempts"),
        F.min(F.when(started & fresh & F.col("_done").isNull(), F.col("ts"))).alias("in_flight_since"),
        F.max_by("error_code", F.when(failed, seq)).alias("last_error_code"),
    )
    return folded.select(
        *keys,
        F.when(F.col("_done").isNotNull(), F.lit("succeeded")).otherwise(F.col("_last")).alias("status"),
        "attempts", F.col("_dest").alias("destination_id"), "in_flight_since", "last_error_code",
    )


def resume_states(checkpoints: DataFrame) -> DataFrame:
    """A process that died: writes in flight are ambiguous, failed and blocked ones start over."""
    status = F.col("status")
    return checkpoints.withColumn(
        "status",
        F.when(status == "in_flight", F.lit("ambiguous"))
        .when(status.isin("failed", "blocked"), F.lit("pending")).otherwise(status),
    )


def assume_not_created(checkpoints: DataFrame, listed: DataFrame) -> DataFrame:
    """Ambiguous actions an operator lists go back to pending."""
    named = listed.select("action_id", F.lit(True).alias("_listed")).distinct()
    joined = checkpoints.join(named, "action_id", "left")
    again = (F.col("status") == "ambiguous") & F.col("_listed").isNotNull()
    return joined.withColumn(
        "status", F.when(again, F.lit("pending")).otherwise(F.col("status"))
    ).drop("_listed")


def id_map_conflicts(new: DataFrame, id_map: DataFrame) -> DataFrame:
    """New mappings whose (key, scope) already points somewhere else."""
    held = id_map.select("source_key", "scope", F.col("destination_id").alias("mapped_to"))
    return new.join(held, ["source_key", "scope"]).where(F.col("destination_id") != F.col("mapped_to"))


def id_map_upsert(new: DataFrame, id_map: DataFrame) -> DataFrame:
    """Each new mapping with what happens to it: insert, same, or conflict."""
    held = id_map.select("source_key", "scope", F.col("destination_id").alias("mapped_to"))
    verdict = (
        F.when(F.col("mapped_to").isNull(), F.lit("insert"))
        .when(F.col("mapped_to") == F.col("destination_id"), F.lit("same")).otherwise(F.lit("conflict"))
    )
    return new.join(held, ["source_key", "scope"], "left").withColumn("result", verdict)


def run_counts(checkpoints: DataFrame) -> DataFrame:
    """Actions per status for each run, zeros kept."""
    return checkpoints.groupBy("run_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in vocab.ACTION_STATUSES]
    )


def run_progress(counts: DataFrame) -> DataFrame:
    total = sum((F.col(s) for s in vocab.ACTION_STATUSES), F.lit(0))
    done = F.col("succeeded") + F.col("skipped")
    ratio = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(0.0))
    return counts.withColumn("done", done).withColumn("total", total.cast("bigint")).withColumn(
        "percent", F.floor(ratio * 100).cast("bigint")
    )


def run_outcome(counts: DataFrame) -> DataFrame:
    """Applied only when nothing is pending, in flight, failed, ambiguous or blocked."""
    open_ = sum(
        (F.col(s) for s in ("pending", "in_flight", "failed", "ambiguous", "blocked")), F.lit(0)
    )
    return counts.withColumn("outcome", F.when(open_ == 0, F.lit("applied")).otherwise(F.lit("failed")))


def report_state(run_status: Column, verification: Column) -> Column:
    """One of seven report states; a null run status means there is no run."""
    return (
        F.when(run_status.isNull(), F.lit("planned_only"))
        .when(run_status.isin("approved", "applying", "verifying"), F.lit("in_progress"))
        .when(run_status == "stopped", F.lit("partial"))
        .when(run_status == "failed", F.lit("failed"))
        .when(run_status == "applied", F.lit("applied_unverified"))
        .when(run_status == "verification_failed", F.lit("verification_failed"))
        .when(
            run_status == "verified",
            F.when(verification == "passed", F.lit("verified")).otherwise(F.lit("applied_unverified")),
        )
    )


def migration_phase(run_status: Column, blocking_errors: Column, verification: Column) -> Column:
    """One of eleven phases."""
    direct = ["approved", "applying", "stopped", "failed", "verifying", "verified", "verification_failed"]
    return (
        F.when(
            run_status.isNull(),
            F.when(blocking_errors > 0, F.lit("blocked")).otherwise(F.lit("planned")),
        )
        .when(run_status.isin(*direct), run_status)
        .when(verification == "incomplete", F.lit("verification_incomplete"))
        .otherwise(F.lit("applied"))
    )


def latest_run(runs: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Latest run by approval time, then insertion (seq)."""
    picked = runs.groupBy(*keys).agg(
        F.max_by(F.struct(*keep), F.struct("approved_at", "seq")).alias("_run")
    )
    return picked.select(*keys, "_run.*")
