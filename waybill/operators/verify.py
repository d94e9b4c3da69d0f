"""Does the destination hold what was planned? Joins, typed comparison and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions.dates import epoch_to_iso, epoch_to_zoned_date
from waybill.functions.text import (
    canon, clip, normal_form, normalize_markdown, number_text, wide_trim, with_first_difference,
)
from waybill.functions.values import priority_from
from waybill.operators.ordered import group_apart

SNIPPET = 120
CHECK = "struct<field:string,status:string,expected:string,actual:string,note:string>"


@dataclass(frozen=True)
class Rule:
    """How one planned column is compared with one actual column.

    kind: name, status, priority, number, checkbox, instant, day, custom_date, option, labels,
    id_set, tags, markdown or text. ``if_absent`` is the status when the destination returned
    nothing; ``options`` names the option list of an ``option`` rule.
    """

    field: str
    kind: str
    planned: str
    actual: str
    if_absent: str = "mismatched"
    zone: str = "UTC"
    tolerance: float = 0.0
    options: str | None = None
    normalize: bool = True


def _sorted_text(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def same_set(a: Column, b: Column) -> Column:
    """Equal regardless of order; repeats count."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def canon_subset(wanted: Column, held: Column) -> Column:
    """Every wanted name is held, compared by canonical form."""
    key = lambda x: canon(x)
    return F.size(F.array_except(F.transform(wanted, key), F.transform(held, key))) == 0


def field_status(rule: Rule, planned: Column, actual: Column, options: Column | None = None) -> Column:
    """Status of one check; null when nothing was planned for the field."""
    kind = rule.kind
    if kind == "name":
        left, right = planned, actual
        if rule.normalize:
            left, right = normal_form(planned, "NFC"), normal_form(actual, "NFC")
        equal = wide_trim(left) == wide_trim(right)
    elif kind == "status":
        equal = canon(planned, rule.normalize) == canon(actual, rule.normalize)
    elif kind == "priority":
        equal = priority_from(actual.cast("string")) == planned.cast("int")
    elif kind == "number":
        left, right = planned.cast("double"), actual.cast("double")
        equal = F.abs(left - right) <= rule.tolerance if rule.tolerance else left == right
    elif kind in ("checkbox", "instant", "custom_date", "text"):
        equal = planned == actual
    elif kind == "day":
        equal = epoch_to_zoned_date(planned, rule.zone) == epoch_to_zoned_date(actual, rule.zone)
    elif kind in ("labels", "id_set"):
        equal = same_set(planned, actual)
    elif kind == "tags":
        equal = canon_subset(planned, actual)
    elif kind == "markdown":
        # Both sides are normalized already: see ``stage_markdown``.
        equal = planned == actual
    elif kind == "option":
        wanted = F.get(F.filter(options, lambda o: o["id"] == planned), F.lit(0))
        by_index = wanted["orderindex"].cast("double") == actual.try_cast("double")
        equal = F.coalesce(by_index, F.lit(False)) | (actual == planned)
    else:
        raise ValueError(f"unknown rule kind {kind}")
    otherwise = "unverified" if kind == "custom_date" else "mismatched"
    status = F.when(F.coalesce(equal, F.lit(False)), F.lit("verified")).otherwise(F.lit(otherwise))
    if kind == "option":
        listed = F.coalesce(F.exists(options, lambda o: o["id"] == planned), F.lit(False))
        status = F.when(~listed, F.lit("unverified")).otherwise(status)
    if kind == "checkbox":
        return F.when(planned.isNotNull() & actual.isNull(), F.lit(rule.if_absent)).when(
            planned.isNotNull(), status
        )
    return F.when(planned.isNull(), F.lit(None).cast("string")).when(
        actual.isNull(), F.lit(rule.if_absent)
    ).otherwise(status)


def _shown(rule: Rule, value: Column) -> Column:
    if rule.kind in ("labels", "id_set"):
        return _sorted_text(value)
    if rule.kind == "tags":
        return F.array_join(value, ", ")
    if rule.kind in ("instant", "day"):
        return epoch_to_iso(value)
    if rule.kind == "number":
        return number_text(value.cast("double"))
    return value.cast("string")


def field_check(rule: Rule) -> Column:
    """One check struct, null when nothing was planned for the field."""
    planned, actual = F.col(rule.planned), F.col(rule.actual)
    if rule.kind == "markdown":
        planned, actual = F.col(f"_{rule.field}_want"), F.col(f"_{rule.field}_have")
    status = field_status(rule, planned, actual, F.col(rule.options) if rule.options else None)
    differs = status == "mismatched"
    expected, found = _shown(rule, planned), _shown(rule, actual)
    if rule.kind == "markdown":
        where = F.col(f"_{rule.field}_where")
        line = F.concat(F.lit("from line "), where["line"].cast("string"), F.lit(": "))
        expected, found = F.concat(line, where["expected"]), F.concat(line, where["actual"])
    note = F.when((status == "unverified") & actual.isNull(), F.lit("Not returned."))
    if rule.kind == "day":
        note = F.when(differs, F.lit(f"Compared as calendar days in {rule.zone}."))
    check = F.struct(
        F.lit(rule.field).alias("field"),
        status.alias("status"),
        F.when(differs, clip(expected, SNIPPET)).alias("expected"),
        F.when(differs, F.coalesce(clip(found, SNIPPET), F.lit("none"))).alias("actual"),
        note.alias("note"),
    )
    return F.when(status.isNotNull(), check)


def stage_markdown(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Normalized texts of Markdown rules, and where they differ, as columns of their own."""
    for rule in rules:
        if rule.kind != "markdown":
            continue
        want, have = f"_{rule.field}_want", f"_{rule.field}_have"
        held = F.when(F.col(rule.actual).isNotNull(), normalize_markdown(F.col(rule.actual), rule.normalize))
        df = df.withColumns(
            {want: normalize_markdown(F.col(rule.planned), rule.normalize), have: held}
        )
        differs = F.col(want) != F.col(have)
        df = with_first_difference(
            df, F.when(differs, F.col(want)), F.when(differs, F.col(have)), f"_{rule.field}_where"
        )
    return df


def worst_of(checks: Column) -> Column:
    """Worst status in an array of checks; no checks means verified."""
    worst = F.array_max(F.transform(checks, lambda c: vocab.check_rank(c["status"])))
    return vocab.check_status_at(F.coalesce(worst, F.lit(0)))


def diff_expected_actual(
    planned: DataFrame, actual: DataFrame, rules: list[Rule], on: str = "destination_id"
) -> DataFrame:
    """Planned rows joined to what exists: one row per planned item with its checks and verdict.

    One shuffle on the destination id, which is unique on both sides.
    """
    held = actual.withColumn("_held", F.lit(True))
    joined = stage_markdown(planned.join(held, on, "left"), rules)
    found = F.col("_held").isNotNull()
    absent = F.struct(
        F.lit("existence").alias("field"),
        F.lit("missing").alias("status"),
        F.lit(None).cast("string").alias("expected"),
        F.lit(None).cast("string").alias("actual"),
        F.lit("No item with this id exists.").alias("note"),
    )
    checks = F.when(found, F.array_compact(F.array(*[field_check(r) for r in rules]))).otherwise(
        F.array(absent)
    )
    return joined.withColumn("checks", checks.cast(f"array<{CHECK}>")).withColumn(
        "status", worst_of(F.col("checks"))
    ).drop("_held", *[f"_{r.field}_{n}" for r in rules for n in ("want", "have", "where")])


def checks_long(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.select(*keys, F.inline("checks"))


def item_status_from_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    worst = F.max(vocab.check_rank(F.col("status")))
    return checks.groupBy(*keys).agg(vocab.check_status_at(worst).alias("status"))


def verification_counts(items: DataFrame, *by: str) -> DataFrame:
    """Items per status and what that makes of the whole: passed, failed or incomplete."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = items.groupBy(*by).agg(
        *[n(s).alias(s) for s in ("verified", "mismatched", "missing", "unverified")]
    )
    wrong = (F.col("mismatched") > 0) | (F.col("missing") > 0)
    return counted.withColumn(
        "result",
        F.when(wrong, F.lit("failed"))
        .when(F.col("unverified") > 0, F.lit("incomplete"))
        .otherwise(F.lit("passed")),
    )


def targets_expected_found(items: DataFrame, target: str) -> DataFrame:
    return items.groupBy(F.col(target).alias("target")).agg(
        F.count("*").alias("expected"),
        F.count_if(F.col("status") != "missing").alias("found"),
    )


def never_created(actions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Executable actions without a usable checkpoint: missing, with the status they have."""
    held = checkpoints.select(
        F.col("action_id"), F.col("status").alias("_status"), "destination_id"
    )
    usable = F.col("destination_id").isNotNull() & F.col("_status").isin("succeeded", "skipped")
    joined = actions.join(held, F.col("id") == F.col("action_id"), "left")
    return joined.where(
        (F.col("disposition") == "execute") & ~F.coalesce(usable, F.lit(False))
    ).select(
        F.col("id").alias("action_id"),
        "source",
        F.lit("missing").alias("status"),
        F.concat(
            F.lit("Not created (action status: "),
            F.coalesce("_status", F.lit("unknown")),
            F.lit(")."),
        ).alias("note"),
    )


def verify_links(
    links: DataFrame, id_of: DataFrame, items: DataFrame, linked: DataFrame
) -> DataFrame:
    """Planned links (id, from_action, to_action) against the destination's own link table.

    ``id_of`` maps action_id to destination_id, ``items`` lists existing destination ids and
    ``linked`` (from_id, to_id) the links that exist. Links are joined as pairs, never gathered
    per item, so an item with very many links costs no more than any other.
    """
    first = id_of.select(F.col("action_id").alias("from_action"), F.col("destination_id").alias("from_id"))
    second = id_of.select(F.col("action_id").alias("to_action"), F.col("destination_id").alias("to_id"))
    exists = items.select(F.col("destination_id").alias("from_id"), F.lit(True).alias("_exists"))
    pairs = linked.select("from_id", "to_id").distinct().withColumn("_linked", F.lit(True))
    joined = (
        links.join(first, "from_action", "left")
        .join(second, "to_action", "left")
        .join(exists, "from_id", "left")
        .join(pairs, ["from_id", "to_id"], "left")
    )
    status = (
        F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), F.lit("unverified"))
        .when(F.col("_exists").isNull(), F.lit("missing"))
        .when(F.col("_linked").isNotNull(), F.lit("verified"))
        .otherwise(F.lit("mismatched"))
    )
    return joined.select("id", "from_id", "to_id", status.alias("status"))


def verify_pages(
    planned: DataFrame, actual: DataFrame, id_of: DataFrame, normalize: bool = True
) -> DataFrame:
    """Planned pages (action_id, name, content, parent_action) against the flattened page table
    (page_id, name, content, parent_id). Pages of a missing document come out as missing."""
    own = id_of.select("action_id", F.col("destination_id").alias("page_id"))
    parent = id_of.select(
        F.col("action_id").alias("parent_action"),
        F.col("destination_id").alias("expected_parent"),
    )
    held = actual.select(
        "page_id",
        F.col("name").alias("actual_name"),
        F.col("content").alias("actual_content"),
        F.col("parent_id").alias("actual_parent"),
        F.lit(True).alias("_held"),
    )
    joined = (
        planned.join(own, "action_id").join(parent, "parent_action", "left")
        .join(held, "page_id", "left")
    )
    ok = lambda test: F.when(test, F.lit("verified")).otherwise(F.lit("mismatched"))
    found = F.col("_held").isNotNull()
    content = F.when(F.col("actual_content").isNull(), F.lit("unverified")).otherwise(
        ok(
            normalize_markdown(F.col("content"), normalize)
            == normalize_markdown(F.col("actual_content"), normalize)
        )
    )
    checked = joined.select(
        "action_id",
        "page_id",
        F.when(found, ok(F.col("name") == F.col("actual_name"))).alias("name_status"),
        F.when(found, ok(F.col("expected_parent").eqNullSafe(F.col("actual_parent")))).alias(
            "parent_status"
        ),
        F.when(found, content).alias("content_status"),
        found.alias("_found"),
    )
    worst = F.greatest(
        *[vocab.check_rank(F.col(f"{n}_status")) for n in ("name", "parent", "content")]
    )
    status = F.when(~F.col("_found"), F.lit("missing")).otherwise(vocab.check_status_at(worst))
    return checked.withColumn("status", status).drop("_found")


def reconcile_matches(attempts: DataFrame, candidates: DataFrame, complete: bool = True) -> DataFrame:
    """After writes with an unknown result: which candidate did each attempt create?

    attempts: action_id, target, match_key, since_ms. candidates: target, match_key, item_id,
    created_ms. A candidate counts when it was created no earlier than the attempt less the clock
    allowance. Whether there are none, one or several is decided by the two latest candidates of
    a key, so a key shared by very many items is reduced before the join and no pairs are formed.
    """
    latest = Window.partitionBy("target", "match_key").orderBy(
        F.col("created_ms").desc(), F.col("item_id")
    )
    top = group_apart(
        candidates.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= 2),
        ["target", "match_key"],
        F.max(F.when(F.col("_n") == 1, F.col("created_ms"))).alias("_first_ms"),
        F.max(F.when(F.col("_n") == 1, F.col("item_id"))).alias("_first_id"),
        F.max(F.when(F.col("_n") == 2, F.col("created_ms"))).alias("_second_ms"),
    )
    floor = F.col("since_ms") - vocab.CLOCK_SKEW_SECONDS * 1000
    in_time = lambda c: F.coalesce(F.col(c) >= floor, F.lit(False))
    verdict = (
        F.when(in_time("_second_ms"), F.lit("undecidable"))
        .when(in_time("_first_ms"), F.lit("found"))
        .otherwise(F.lit("not_found"))
    )
    return attempts.join(top, ["target", "match_key"], "left").select(
        "action_id",
        verdict.alias("status"),
        F.when(verdict == "found", F.col("_first_id")).alias("destination_id"),
        F.when(verdict == "not_found", F.lit(complete)).alias("confident"),
    )


def non_verified_items(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items that are not verified, with only the failing checks and the action's label."""
    labels = actions.select(F.col("id").alias("action_id"), "label")
    failing = F.filter("checks", lambda c: c["status"] != "verified")
    return (
        items.where(F.col("status") != "verified")
        .join(labels, "action_id", "left")
        .select(
            "action_id",
            F.coalesce("label", "action_id").alias("label"),
            "status",
            failing.alias("failing"),
        )
    )


def problem_detail(checks: Column) -> Column:
    """One line that says what is wrong with an item."""

    def one(c: Column) -> Column:
        quoted = lambda word, v: F.coalesce(
            F.concat(F.lit(f' {word} "'), v, F.lit('"')), F.lit("")
        )
        note = F.when(
            c["note"].isNotNull() & c["expected"].isNull(),
            F.concat(F.lit(" ("), c["note"], F.lit(")")),
        )
        return F.concat(
            c["field"], quoted("expected", c["expected"]), quoted("got", c["actual"]),
            F.coalesce(note, F.lit("")),
        )

    failing = F.filter(checks, lambda c: c["status"] != "verified")
    return F.array_join(F.transform(failing, one), "; ")


def top_problems(items: DataFrame, order: list, n: int = 15) -> DataFrame:
    """First ``n`` items that are not verified, in plan order, with a detail line."""
    return (
        items.where(F.col("status") != "verified")
        .orderBy(*order)
        .limit(n)
        .withColumn("detail", problem_detail(F.col("checks")))
    )
