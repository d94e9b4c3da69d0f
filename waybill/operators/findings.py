"""Algebra of findings: collapse, tally, aggregate, route, search and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions.text import matches_terms
from waybill.operators.ordered import first_by, group_apart, last_n_per_key

IDENTITY = ["code", "outcome", "severity", "collection", "field", "message"]
PRESERVED_NOT = ["lossy", "unsupported"]


def worst_rank(outcome: Column) -> Column:
    """Aggregate: rank of the worst outcome of a group; nothing counts as supported."""
    return F.coalesce(F.max(vocab.outcome_rank(outcome)), F.lit(0))


def for_item(rank: Column) -> Column:
    """An item with an unsupported part is still created, so it is lossy."""
    return F.when(rank == 4, F.lit("lossy")).otherwise(vocab.outcome_at(rank))


def worst_outcome(df: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    return df.groupBy(*keys).agg(vocab.outcome_at(worst_rank(F.col(outcome))).alias("outcome"))


def item_outcome(df: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    return df.groupBy(*keys).agg(for_item(worst_rank(F.col(outcome))).alias("outcome"))


def tally_columns(outcome: Column) -> list[Column]:
    return [F.count_if(outcome == o).alias(o) for o in vocab.OUTCOMES]


def tally_outcomes(df: DataFrame, keys: list[str] | None = None, outcome: str = "outcome") -> DataFrame:
    """Rows per outcome, one column each, zeros kept."""
    return df.groupBy(*(keys or [])).agg(*tally_columns(F.col(outcome)))


def occurrences() -> Column:
    return F.coalesce(F.col("count"), F.lit(1).cast("bigint"))


def aggregate_findings(findings: DataFrame, by_collection: bool = False) -> DataFrame:
    """Collapse repeated findings into counted ones, keeping the attributes of the first.

    Partial aggregation reduces each task's rows to one per group before the shuffle.
    """
    keys = ["code", "outcome", "field"] + (["collection"] if by_collection else [])
    kept = ["severity", "category", "message"] + ([] if by_collection else ["collection"])
    grouped = findings.groupBy(*keys).agg(
        F.sum(occurrences()).alias("count"),
        F.min_by(F.struct(*kept), F.col("seq")).alias("_first"),
    )
    return grouped.select(*keys, "count", "_first.*")


def inventory_order() -> list[Column]:
    """Worst first, then code, then field."""
    return [
        vocab.outcome_rank(F.col("outcome")).desc(),
        F.col("code").asc(),
        F.coalesce("field", F.lit("")).asc(),
    ]


def inventory(findings: DataFrame) -> DataFrame:
    """Everything that is not a clean arrival, aggregated."""
    return aggregate_findings(
        findings.where(F.col("outcome").isin("transformed", "lossy", "unsupported"))
    )


def failure_findings(items: DataFrame) -> DataFrame:
    """Failed and blocked actions (seq, status, source) as findings."""
    failed = F.col("status") == "failed"
    none = F.lit(None).cast("string")
    return items.where(F.col("status").isin("failed", "blocked")).select(
        "seq",
        F.when(failed, F.lit("ACTION_FAILED")).otherwise(F.lit("ACTION_BLOCKED")).alias("code"),
        F.lit("failed").alias("outcome"),
        F.lit("error").alias("severity"),
        F.lit("destination").alias("category"),
        F.when(failed, F.lit("Rejected by the destination; not created."))
        .otherwise(F.lit("Not attempted: a prerequisite failed.")).alias("message"),
        none.alias("collection"),
        none.alias("field"),
        F.lit(1).cast("bigint").alias("count"),
    )


def not_preserved(inventory_rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Lossy and unsupported inventory plus failed and blocked actions.

    Inventory rows are one per (code, outcome, field) already and failures have codes of their
    own, so each side is aggregated once and the results are simply appended.
    """
    lost = inventory_rows.where(F.col("outcome").isin(*PRESERVED_NOT))
    return lost.unionByName(aggregate_findings(failures))


def with_outcome_label(df: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return df.withColumn("label", vocab.lookup(outcome, vocab.OUTCOME_LABELS, outcome)).withColumn(
        "rank", vocab.outcome_rank(outcome)
    )


def outcome_words(outcome: Column) -> Column:
    """The stored outcome plus the words people see, so a search finds both."""
    return F.concat_ws(
        " ", outcome, vocab.lookup(outcome, vocab.OUTCOME_LABELS, outcome),
        vocab.lookup(outcome, vocab.OUTCOME_PLAIN, outcome),
    )


def _present(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def filter_findings(
    findings: DataFrame, collections: DataFrame, outcome: str = "all", query: str = ""
) -> DataFrame:
    """Findings of one outcome (or all) whose searchable text has every term of the query."""
    rows = findings if outcome == "all" else findings.where(F.col("outcome") == outcome)
    names = collections.select(F.col("key").alias("collection"), F.col("name").alias("_name"))
    text = F.concat_ws(
        " \n ", "code", outcome_words(F.col("outcome")), "severity", "category", "message",
        _present("field"), _present("_name"),
    )
    return rows.join(names, "collection", "left").where(matches_terms(text, query)).drop("_name")


def blocking_findings(plan_level: DataFrame, action_level: DataFrame) -> DataFrame:
    """Findings that stop the run: severity error, at plan or action level."""
    error = F.col("severity") == "error"
    return plan_level.where(error).unionByName(action_level.where(error), allowMissingColumns=True)


def issue_level(severity: Column) -> Column:
    return F.when(severity.isin("error", "warning"), severity).otherwise(F.lit("info"))


def plan_issues(findings: DataFrame) -> DataFrame:
    return findings.withColumn("issue", issue_level(F.col("severity")))


def needs_attention() -> Column:
    """Errors, advisory outcomes, and anything about destination, scope or permission."""
    return (F.col("severity") != "info") & (
        (F.col("severity") == "error")
        | F.col("outcome").isin("supported", "skipped")
        | F.col("category").isin("destination", "scope", "permission")
    )


def attention_filter(findings: DataFrame) -> DataFrame:
    return findings.where(needs_attention())


def distinct_warnings(findings: DataFrame) -> DataFrame:
    """Distinct kinds of warning: many identical warnings are one thing to read."""
    kinds = findings.where(F.col("severity") == "warning").select("code", _present("field")).distinct()
    return kinds.agg(F.count("*").alias("warnings"))


def findings_by_outcome(findings: DataFrame) -> DataFrame:
    """Kinds (rows) and occurrences (summed counts) per outcome, with the display position."""
    grouped = findings.groupBy("outcome").agg(
        F.count("*").alias("kinds"), F.sum(occurrences()).alias("occurrences")
    )
    position = vocab.rank_in(F.col("outcome"), vocab.FINDING_GROUP_ORDER)
    return grouped.withColumn("position", F.coalesce(position, F.lit(len(vocab.OUTCOMES))))


def percent_text(part: Column, total: Column) -> Column:
    """`<0.1%`, one decimal below ten per cent, else a whole number."""
    value = part / total * 100
    return (
        F.when(~(total > 0), F.lit("–"))
        .when(value == 0, F.lit("0%"))
        .when(value < 0.1, F.lit("<0.1%"))
        .when(value < 10, F.concat(F.format_number(value, 1), F.lit("%")))
        .otherwise(F.concat(F.floor(value + 0.5).cast("bigint").cast("string"), F.lit("%")))
    )


def outcome_shares(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    counted = df.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    # At most one row per outcome reaches this window.
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share", percent_text(F.col("n"), total))


def limit_per_group(findings: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """First ``n`` findings of each outcome (largest count, then code) and how many are hidden."""
    by = order or [F.coalesce("count", F.lit(1)).desc(), F.col("code"), _present("field")]
    totals = findings.groupBy("outcome").agg(F.count("*").alias("_total"))
    shown = last_n_per_key(findings, ["outcome"], by, n)
    hidden = F.greatest(F.col("_total") - n, F.lit(0))
    return shown.join(totals, "outcome").withColumn("hidden", hidden).drop("_total")


def merge_findings(*lists: DataFrame) -> DataFrame:
    """Union of lists keeping the first of each identity, lists in the order given."""
    tagged = [
        df.withColumn("_rank", F.struct(F.lit(i).alias("list"), F.col("seq")))
        for i, df in enumerate(lists)
    ]
    together = reduce(DataFrame.unionByName, tagged)
    keep = [c for c in lists[0].columns if c not in IDENTITY]
    return first_by(together, IDENTITY, F.col("_rank"), keep)


def union_distinct_findings(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(*IDENTITY) for df in lists]).distinct()


def plan_level_findings(*lists: DataFrame) -> DataFrame:
    """UNION ALL of unrouted source, inspection, planning and validation findings."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def first_owner(actions: DataFrame) -> DataFrame:
    """First action of each source entity, in plan order."""
    owned = actions.where(F.col("source").isNotNull()).select(F.col("source").alias("entity"), "id", "seq")
    return group_apart(owned, ["entity"], F.min_by("id", "seq").alias("owner"))


def route_findings(
    findings: DataFrame, actions: DataFrame, attached: DataFrame | None = None
) -> DataFrame:
    """Give each source finding the first action of its entity as owner; null stays plan-level.

    ``attached`` (action_id, code, entity, field, collection) are findings actions already carry:
    an owned finding identical to one of them is left out. They are gathered per entity (distinct ones of its
    actions, bounded by the codes and fields) beside its owner, so the findings themselves are shuffled once.
    """
    if attached is None:
        return findings.join(first_owner(actions), "entity", "left")
    same = F.struct("code", "field", "collection")
    owned = actions.where(F.col("source").isNotNull()).select(F.col("source").alias("entity"), "id", "seq")
    carried = attached.where(F.col("entity").isNotNull() & F.col("action_id").isNotNull() & F.col("code").isNotNull())
    both = owned.unionByName(carried.select("entity", F.struct("action_id", same.alias("same")).alias("_one")), allowMissingColumns=True)
    owners = group_apart(both, ["entity"], F.min_by("id", "seq").alias("owner"), F.collect_set("_one").alias("_all"))
    own = F.transform(F.filter("_all", lambda one: one["action_id"] == F.col("owner")), lambda one: one["same"])
    routed = findings.join(owners.select("entity", "owner", own.alias("_carried")), "entity", "left")
    return routed.where(~F.coalesce(F.array_contains("_carried", same), F.lit(False))).drop("_carried")


def merge_action_outcome(actions: DataFrame, routed: DataFrame) -> DataFrame:
    """Outcome of each action after its findings were attached; skipped actions keep theirs."""
    worst = (
        routed.where(F.col("owner").isNotNull())
        .groupBy(F.col("owner").alias("id")).agg(worst_rank(F.col("outcome")).alias("_rank"))
    )
    own = vocab.outcome_rank(F.col("outcome"))
    joined = actions.join(worst, "id", "left")
    merged = for_item(F.greatest(own, F.col("_rank")))
    changed = F.col("_rank").isNotNull() & (F.col("disposition") != "skip")
    return joined.withColumn(
        "outcome", F.when(changed, merged).otherwise(F.col("outcome"))
    ).drop("_rank")


def task_summary(
    actions: DataFrame, findings: DataFrame, mappings: DataFrame, collections: DataFrame
) -> DataFrame:
    """Per action: fields of its collections that move as-is, and finding occurrences by outcome.

    actions: id, list_id. findings: action_id, outcome, count, collection. collections: key, list_id.
    """
    of = lambda o: F.sum(F.when(F.col("outcome") == o, occurrences()).otherwise(0))
    counted = findings.groupBy("action_id").agg(
        *[of(o).alias(o) for o in ("transformed", "lossy", "unsupported")]
    )
    by_list = actions.join(collections.select("list_id", F.col("key").alias("collection")), "list_id")
    belongs = (
        by_list.select(F.col("id").alias("action_id"), "collection")
        .unionByName(findings.where(F.col("collection").isNotNull()).select("action_id", "collection"))
        .distinct()
    )
    kept = mappings.groupBy("collection").agg(
        F.count_if(F.col("outcome") == "supported").alias("_kept")
    )
    preserved = belongs.join(kept, "collection", "left").groupBy("action_id").agg(
        F.count("*").alias("collections"), F.sum(F.coalesce("_kept", F.lit(0))).alias("preserved")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return (
        actions.select(F.col("id").alias("action_id"))
        .join(counted, "action_id", "left").join(preserved, "action_id", "left")
        .select("action_id", zero("collections"), "preserved", zero("transformed"), zero("lossy"),
                zero("unsupported"))
    )
