"""One-row and few-row summaries of a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators.findings import distinct_warnings, occurrences, tally_columns

# Action kinds the report has words for: kind -> (one, many, experimental).
KIND_WORDS = {
    "create_task": ("task", "tasks", False),
    "link_tasks": ("task link", "task links", False),
    "create_doc": ("Doc", "Docs", True),
    "create_doc_page": ("Doc page", "Doc pages", True),
}


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row frames side by side, by union and one aggregate instead of a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def plan_summary(actions: DataFrame, mappings: DataFrame, findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Totals of a plan as one row. Each table is reduced to one row before they are put together."""
    by_action = actions.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("disposition") == "execute").alias("to_execute"),
        F.count_if(F.col("disposition") == "skip").alias("to_skip"),
        *[c.alias(f"items_{o}") for o, c in zip(vocab.OUTCOMES, tally_columns(F.col("outcome")))],
    )
    by_field = mappings.agg(
        *[c.alias(f"fields_{o}") for o, c in zip(vocab.OUTCOMES, tally_columns(F.col("outcome")))]
    )
    lost = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("count"))), F.lit(0).cast("bigint"))
    by_loss = inventory.agg(lost("unsupported").alias("unsupported"), lost("lossy").alias("lossy"))
    errors = findings.agg(F.count_if(F.col("severity") == "error").alias("blocking_errors"))
    return one_row(by_action, by_field, by_loss, errors, distinct_warnings(findings))


def actions_by_kind(actions: DataFrame) -> DataFrame:
    return actions.groupBy("kind").agg(F.count("*").alias("n"))


def estimate_requests(actions: DataFrame, per_minute: int) -> DataFrame:
    """Writes of executed actions and the minutes they take at the rate limit."""
    writes = F.coalesce(
        F.sum(F.when(F.col("disposition") == "execute", F.col("estimated_requests"))), F.lit(0)
    ).cast("bigint")
    minutes = F.floor(F.col("write_requests") / per_minute * 10 + 0.5) / 10
    return actions.agg(writes.alias("write_requests")).withColumn("minutes", minutes.cast("double"))


def approval_summary(actions: DataFrame) -> DataFrame:
    """Rows to create per kind and target, with the words for them. actions: kind, target, disposition."""
    rows = actions.where(F.col("disposition") == "execute").groupBy("kind", "target").agg(F.count("*").alias("n"))
    kind = F.col("kind")
    words = lambda i: vocab.lookup(kind, {k: w[i] for k, w in KIND_WORDS.items()})
    noun = F.when(F.col("n") == 1, words(0)).otherwise(words(1))
    return rows.select(
        "kind", "target", "n", F.coalesce(noun, kind).alias("noun"),
        F.coalesce(words(2), F.lit(False)).alias("experimental"), words(0).isNull().alias("unrecognised"),
    )


def approval_totals(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count_if(F.col("disposition") == "execute").alias("to_write"),
        F.count_if(F.col("disposition") != "execute").alias("to_skip"),
    )


def source_totals(collections: DataFrame) -> DataFrame:
    return collections.groupBy("system").agg(
        F.count("*").alias("collections"), F.sum("record_count").alias("rows")
    )


def plan_advisories(actions: DataFrame, standalone: DataFrame, docs_enabled: bool = False) -> DataFrame:
    """Plan-level warnings from totals. actions: marker, assignees, disposition. standalone: key."""
    written = actions.agg(
        F.count_if(F.col("marker").isNull()).alias("markerless"),
        F.coalesce(F.sum(F.when(F.col("disposition") != "skip", F.col("assignees"))), F.lit(0)).cast("bigint").alias("notify"),
    )
    totals = one_row(written, standalone.agg(F.count("*").alias("docs")))

    def row(code: str, n: Column, outcome: str, category: str) -> Column:
        return F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n"), F.lit(outcome).alias("outcome"), F.lit(category).alias("category"))

    docs = F.lit(0) if docs_enabled else F.col("docs")
    return totals.select(
        F.inline(
            F.array(
                row("PROVENANCE_DISABLED", F.col("markerless"), "supported", "destination"),
                row("ASSIGNEES_WILL_BE_NOTIFIED", F.col("notify"), "supported", "user_mapping"),
                row("DOCS_EXPERIMENTAL_DISABLED", docs, "skipped", "scope"),
            )
        )
    ).where(F.col("n") > 0)


__all__ = [
    "actions_by_kind", "approval_summary", "approval_totals", "estimate_requests", "occurrences",
    "plan_advisories", "plan_summary", "source_totals",
]
