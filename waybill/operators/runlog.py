"""The run log: labels, progress, milestones, failures in a row, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators import ordered

RATE_LIMIT_TYPES = ["rate_limit", "rate_limited", "rate_limit_wait", "waiting_for_rate_limit"]


def humanize(kind: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(kind, r"[_\-.]+", " "), r"\s+", " "))
    text = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))
    short = F.when(F.length(text) > 48, F.concat(F.substring(text, 1, 47), F.lit("…"))).otherwise(text)
    return F.when(spaced == "", F.lit("Event")).otherwise(short)


def event_label(kind: Column, message: Column) -> Column:
    """What an event is called, judged by its type and, for some types, by its message."""
    result = F.regexp_extract(message, r":\s*(found|not_found|undecidable)\s*$", 1)
    verdict = F.lower(F.regexp_extract(message, r"(?i)^Verification\s+(passed|failed|incomplete)\b", 1))
    simple = {
        "approved": "Plan approved",
        "action_failed": "Write failed",
        "assume_not_created": "Confirmed not created",
        "run_stopped": "Run stopped",
        "run_finished": "Run finished",
    }
    label = (
        F.when(
            kind == "run_started",
            F.when(message.rlike(r"(?i)^Resuming\b"), F.lit("Run resumed")).otherwise(F.lit("Run started")),
        )
        .when(
            kind == "action_succeeded",
            F.when(message.rlike(r"^Link\b"), F.lit("Linked"))
            .when(message.rlike(r"^Create\b"), F.lit("Created")).otherwise(F.lit("Written")),
        )
        .when(
            kind == "action_reconciled",
            vocab.lookup(
                result,
                {
                    "found": "Recovered after a lost reply",
                    "not_found": "Checked after a lost reply: not found",
                    "undecidable": "Could not confirm after a lost reply",
                },
                F.lit("Checked after a lost reply"),
            ),
        )
        .when(
            kind == "verification",
            F.concat(F.lit("Verification"), F.when(verdict != "", F.concat(F.lit(" "), verdict)).otherwise(F.lit(""))),
        )
    )
    for name, text in simple.items():
        label = label.when(kind == name, F.lit(text))
    label = label.when(kind.isin(*RATE_LIMIT_TYPES), F.lit("Waiting for rate limit"))
    return F.struct(
        F.coalesce(label, humanize(kind)).alias("label"), label.isNotNull().alias("known")
    )


def running_written(log: DataFrame, width: int = ordered.CHUNK) -> DataFrame:
    """Successes so far after each event of a run."""
    return ordered.running_count(
        log, ["run_id"], "id", F.col("type") == "action_succeeded", "written", width
    )


def last_milestone(log: DataFrame, width: int = ordered.CHUNK) -> DataFrame:
    """Id of the latest milestone event so far; -1 before the first."""
    is_milestone = F.col("type").isin(*vocab.MILESTONE_TYPES)
    return ordered.running_max(
        log, ["run_id"], "id", F.when(is_milestone, F.col("id")), "milestone_id", -1, width
    )


def consecutive_failures(log: DataFrame, width: int = ordered.CHUNK) -> DataFrame:
    """Failures since the last success at each event, and whether that trips the breaker."""
    counted = ordered.since_last(
        log, ["run_id"], "id", F.col("type") == "action_failed",
        F.col("type") == "action_succeeded", "failures", width,
    )
    tripped = (F.col("type") == "action_failed") & (F.col("failures") >= vocab.BREAKER_LIMIT)
    return counted.withColumn("tripped", tripped)


def events_after(log: DataFrame, run_id: str, after: int, limit: int = 500) -> DataFrame:
    return log.where((F.col("run_id") == run_id) & (F.col("id") > after)).orderBy("id").limit(limit)


def events_tail(log: DataFrame, n: int = 250) -> DataFrame:
    """Last ``n`` events of every run."""
    return ordered.last_n_per_key(log, ["run_id"], [F.col("id").desc()], n)


def read_write_summary(requests: DataFrame) -> DataFrame:
    """Reads, writes and blocked requests. A sent request of an unknown class counts as a write."""
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    read = F.col("class").eqNullSafe(F.lit("read"))
    return requests.agg(
        F.count_if(~blocked & read).alias("reads"),
        F.count_if(~blocked & ~read).alias("writes"),
        F.count_if(blocked).alias("blocked"),
    )
