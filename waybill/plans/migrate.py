"""The whole plan and the whole verification, put together from the operators.

``plan_migration`` takes snapshot tables, destination facts and configuration tables (schemas in
``waybill.schemas``) and returns the plan's tables as lazy DataFrames; ``verify_migration`` compares
such a plan with what the destination holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions.dates import with_converted_date
from waybill.functions.ids import stable_id
from waybill.functions.text import canon, clean_name, name_changed
from waybill.functions.values import priority_from, value_to_markdown
from waybill.operators import findings as fnd
from waybill.operators import mapping as mp
from waybill.operators import relations as rel
from waybill.operators import verify as vf
from waybill.plans import build
from waybill.sources.sinks import stored


@dataclass(frozen=True)
class Options:
    timezone: str = "UTC"
    provenance: bool = True
    keep_unmapped: bool = True
    marker_prefix: str = build.MARKER_PREFIX


# Code -> (outcome, severity, category) of the findings planning makes per cell.
CELL_CODES = {
    "FIELD_EXPLICITLY_SKIPPED": ("skipped", "info", "field_type"),
    "FIELD_DROPPED": ("unsupported", "warning", "field_type"),
    "STATUS_VALUE_UNMAPPED": ("lossy", "warning", "field_type"),
    "PRIORITY_VALUE_UNMAPPED": ("lossy", "warning", "field_type"),
    "DATE_UNPARSEABLE": ("unsupported", "warning", "data"),
    "DATE_TIMEZONE_NAME_NOT_PRESERVED": ("transformed", "info", "data"),
    "DATE_ASSUMED_TIMEZONE": ("transformed", "info", "data"),
    "FIELD_SNAPSHOT_ONLY": ("lossy", "warning", "field_type"),
    "METADATA_AS_TEXT": ("lossy", "warning", "field_type"),
    "FIELD_PRESERVED_AS_TEXT": ("transformed", "info", "field_type"),
    "DATE_RANGE_START_LOST": ("lossy", "warning", "data"),
    "DATE_RANGE_END_LOST": ("lossy", "warning", "data"),
    "NAME_NORMALIZED": ("transformed", "info", "data"),
}


def plan_rules(matched: DataFrame, fields: DataFrame, field_map: DataFrame, options: Options) -> DataFrame:
    """One rule per field of every mapped collection. field_map: collection, name, to."""
    lists = matched.where(F.col("list_id").isNotNull()).select(F.col("key").alias("collection"), "list_id")
    stated = field_map.select("collection", "name", F.col("to").alias("explicit_to"))
    declared = fields.join(lists, "collection").join(stated, ["collection", "name"], "left")
    kind, to = F.col("kind"), F.col("explicit_to")
    rest = "description_table" if options.keep_unmapped else "dropped"
    target = (
        F.when(kind == "title", F.lit("name"))
        .when(to == "skip", F.lit("dropped"))
        .when(kind == "relation", F.lit("link"))
        .when(kind == "unsupported", F.lit("dropped"))
        .when(F.col("target").isNotNull() & ~F.col("conflict"), F.col("target"))
        .when(to == "description", F.lit("description_table"))
        .otherwise(F.lit(rest))
    )
    claimed = mp.claim_targets(declared)
    return claimed.select(
        "collection", "list_id", "field_id", F.col("name").alias("field_name"), "kind", "pos",
        target.alias("target_kind"), to.isNotNull().alias("explicit"), (to == "skip").alias("skip"), "conflict",
    )


def _option_lookup(rules: DataFrame, statuses: DataFrame, value_map: DataFrame) -> DataFrame:
    """Destination name per (list, field, canonical text): explicit entries before equal names.

    statuses: list_id, name, pos. value_map: collection, field_name, from, to, pos. All of it is
    bounded by the destination's lists and the configuration.
    """
    of_status = rules.where(F.col("target_kind") == "status")
    names = statuses.groupBy("list_id", canon(F.col("name")).alias("_t")).agg(F.max_by("name", "pos").alias("_real"))
    equal = of_status.select("collection", "field_id", "list_id").join(names, "list_id").select(
        "collection", "field_id", F.col("_t").alias("_canon"), "_real", F.lit(0).alias("_rank"), F.lit(0).alias("pos")
    )
    stated = of_status.join(value_map, ["collection", "field_name"]).withColumn("_t", canon(F.col("to")))
    explicit = stated.drop("pos").join(value_map.select("collection", "field_name", "from", "pos"), ["collection", "field_name", "from"]).join(
        names, ["list_id", "_t"]
    ).select("collection", "field_id", canon(F.col("from")).alias("_canon"), "_real", F.lit(1).alias("_rank"), "pos")
    return equal.unionByName(explicit).groupBy("collection", "field_id", "_canon").agg(
        F.max_by("_real", F.struct("_rank", "pos")).alias("status")
    )


def _priority_lookup(rules: DataFrame, value_map: DataFrame) -> DataFrame:
    wanted = rules.where(F.col("target_kind") == "priority").drop("pos")
    stated = wanted.join(value_map, ["collection", "field_name"])
    return stated.withColumn("priority", priority_from(F.col("to"))).where(F.col("priority").isNotNull()).groupBy(
        "collection", "field_id", canon(F.col("from")).alias("_canon")
    ).agg(F.max_by("priority", "pos").alias("_mapped"))


# Targets that need facts about the destination's people and tags, which the plan does not take: kept as text.
TEXT_TARGETS = ("description_table", "assignees", "tags")


def draft_relations(cells: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """Relation cells as text rows with the titles of their targets, in the form of ``draft_cells``."""
    linked = rules.where(F.col("target_kind") == "link").select("collection", "field_id", "field_name", "pos")
    own = cells.where(F.size("targets") > 0).join(linked, ["collection", "field_id"])
    text = rel.relation_as_text(own, records)
    none = F.lit(None)
    return own.select("record", "field_id", "collection", "field_name", "pos").join(text, ["record", "field_id"]).select(
        "record", "collection", "field_name", "pos", F.lit("link").alias("target"), none.cast("string").alias("status"),
        none.cast("int").alias("priority"), none.cast("bigint").alias("start_ms"), none.cast("bigint").alias("end_ms"),
        build.table_row(F.col("pos"), F.col("field_name"), F.col("text")).alias("row"),
        F.array(F.lit("FIELD_PRESERVED_AS_TEXT")).alias("codes"), _code_rank(F.lit("FIELD_PRESERVED_AS_TEXT")).alias("rank"), F.lit("row").alias("kept_as"),
    )


def draft_cells(
    cells: DataFrame, rules: DataFrame, statuses: DataFrame, value_map: DataFrame, options: Options
) -> DataFrame:
    """Every cell but relations with what it becomes: a status, a priority, instants or a text row, and a code.

    ``kept_as`` says where its value went: value, row, finding (only a code tells of it) or null (it had none). One
    pass over the cells; rules and lookups are configuration-sized.
    """
    ruled = cells.join(
        rules.where(F.col("target_kind") != "link").select("collection", "field_id", "field_name", "pos", "target_kind", "skip"),
        ["collection", "field_id"],
    )
    texts = ruled.where(F.col("target_kind").isin("status", "priority")).select("collection", "field_id", "name").where(
        F.col("name").isNotNull()
    ).distinct().withColumn("_canon", canon(F.col("name")))
    by_text = stored(
        texts.join(_option_lookup(rules, statuses, value_map), ["collection", "field_id", "_canon"], "left")
        .join(_priority_lookup(rules, value_map), ["collection", "field_id", "_canon"], "left")
        .select("collection", "field_id", "name", "status", F.coalesce("_mapped", priority_from(F.col("name"))).alias("priority")),
        "options",
    )
    target, kind = F.col("target_kind"), F.col("kind")
    is_date = F.coalesce(target.isin("due_date", "start_date"), F.lit(False))
    none = F.lit(None)
    base = ["record", "collection", "field_name", "pos", target.alias("target")]
    row = build.table_row(F.col("pos"), F.col("field_name"), F.coalesce("_md", F.lit("")))
    has = F.col("_md").isNotNull()
    # Only cells that become instants pass the reading of dates, a long chain of expressions.
    dated = with_converted_date(
        ruled.where(is_date), F.col("date.start"), F.col("date.end"), F.col("date.time_zone"), options.timezone, "_d"
    ).withColumn("_md", value_to_markdown())
    bad, codes = F.col("_d.invalid"), F.when(has, F.col("_d.codes")).otherwise(F.array())
    dates = dated.select(
        *base, none.cast("string").alias("status"), none.cast("int").alias("priority"),
        F.col("_d.start_ms").alias("start_ms"), F.col("_d.end_ms").alias("end_ms"), F.when(has & bad, row).alias("row"),
        codes.alias("codes"), F.when(F.size(codes) > 0, _worst_code(codes)).otherwise(F.lit(0)).alias("rank"),
        F.when(has, F.when(bad, F.lit("row")).otherwise(F.lit("value"))).alias("kept_as"),
    )
    others = ruled.where(~is_date).join(by_text, ["collection", "field_id", "name"], "left").withColumn("_md", value_to_markdown())
    lost = (
        F.when((target == "status") & F.col("name").isNotNull() & F.col("status").isNull(), F.lit("STATUS_VALUE_UNMAPPED"))
        .when((target == "priority") & F.col("name").isNotNull() & F.col("priority").isNull(), F.lit("PRIORITY_VALUE_UNMAPPED"))
    )
    as_text = (
        F.when(kind == "computed", F.lit("FIELD_SNAPSHOT_ONLY")).when(kind.isin("timestamp", "userStamp"), F.lit("METADATA_AS_TEXT"))
        .otherwise(F.lit("FIELD_PRESERVED_AS_TEXT"))
    )
    dropped = F.when(F.col("skip"), F.lit("FIELD_EXPLICITLY_SKIPPED")).otherwise(F.lit("FIELD_DROPPED"))
    one = (
        F.when((target == "dropped") & has & (kind != "unsupported"), dropped)
        .when(target.isin(*TEXT_TARGETS) & has, as_text)
        .otherwise(lost)
    )
    keep_row = (target.isin(*TEXT_TARGETS) & has) | lost.isNotNull()
    placed = (
        (target == "name") | ((target == "status") & F.col("status").isNotNull())
        | ((target == "priority") & F.col("priority").isNotNull())
    )
    code = F.col("_code")
    kept_as = F.when(
        has, F.when(placed, F.lit("value")).when(keep_row, F.lit("row")).when(code.isNotNull(), F.lit("finding")).otherwise(F.lit("lost"))
    )
    return others.withColumn("_code", one).select(
        *base, F.when(target == "status", F.col("status")).alias("status"), F.when(target == "priority", F.col("priority")).alias("priority"),
        none.cast("bigint").alias("start_ms"), none.cast("bigint").alias("end_ms"), F.when(keep_row, row).alias("row"),
        F.when(code.isNotNull(), F.array(code)).otherwise(F.array()).alias("codes"), _code_rank(code).alias("rank"), kept_as.alias("kept_as"),
    ).unionByName(dates)


def accounting(drafts: DataFrame) -> DataFrame:
    """Per collection and field: cells with a value, and where the values went. ``lost`` must be 0 everywhere."""
    count = lambda what: F.count_if(F.col("kept_as") == what)
    return drafts.where(F.col("kept_as").isNotNull()).groupBy("collection", "field_name").agg(
        F.count("*").alias("cells"), count("value").alias("placed"), count("row").alias("text_rows"),
        count("finding").alias("findings_only"), count("lost").alias("lost"),
    )


def cell_findings(drafts: DataFrame) -> DataFrame:
    """The drafts' codes as findings; their attributes follow from the code."""
    code = F.col("code")
    part = lambda i: vocab.lookup(code, {c: v[i] for c, v in CELL_CODES.items()})
    return drafts.select(F.col("record").alias("entity"), "collection", F.col("field_name").alias("field"), F.explode("codes").alias("code")).select(
        "code", part(0).alias("outcome"), part(1).alias("severity"), part(2).alias("category"), "entity", "collection", "field"
    )


def _code_rank(code: Column) -> Column:
    return F.coalesce(vocab.lookup(code, {k: vocab.OUTCOMES_BY_RANK.index(v[0]) for k, v in CELL_CODES.items()}), F.lit(0))


def _worst_code(codes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(codes, _code_rank)), F.lit(0))


def plan_migration(
    snapshot: dict[str, DataFrame], statuses: DataFrame, lists: DataFrame, field_map: DataFrame, value_map: DataFrame,
    id_map: DataFrame, options: Options = Options(),
) -> dict[str, DataFrame]:
    """The plan's tables: rules, actions (with payload), findings, and the collections left out.

    snapshot: collections, fields, records, cells, and optionally documents (key, markdown). lists:
    pos, source, list_id, name. What follows from the configuration (matched collections, rules,
    option texts) is worked out once and stored; everything keyed by record stays lazy. A record's
    cells are brought together in one aggregation whose lists are bounded by the declared fields.
    """
    matched = stored(
        mp.match_collections(snapshot["collections"], lists.select("pos", "source", "list_id")), "matched"
    )
    rules = stored(plan_rules(matched, snapshot["fields"], field_map, options), "rules")
    drafts = draft_cells(snapshot["cells"], rules, statuses, value_map, options).unionByName(
        draft_relations(snapshot["cells"], rules, snapshot["records"])
    )
    of = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{t}_{c}")
    per_record = drafts.groupBy(F.col("record").alias("key")).agg(
        F.max("status").alias("status"), F.max("priority").alias("priority"),
        *[of(t, c) for t in ("due_date", "start_date") for c in ("start_ms", "end_ms", "field_name")],
        build.gathered_lines("row").alias("_lines"), F.max("rank").alias("_rank"),
    )
    targets = matched.where(F.col("list_id").isNotNull()).select(F.col("key").alias("collection"), "list_id").join(
        lists.select("list_id", F.col("name").alias("list_name")), "list_id"
    )
    records = snapshot["records"].join(targets, "collection").join(per_record, "key", "left")
    if "documents" in snapshot:
        records = records.join(snapshot["documents"].select("key", F.col("markdown").alias("_body")), "key", "left")
    else:
        records = records.withColumn("_body", F.lit(None).cast("string"))
    footer = build.provenance_footer(F.col("key"), F.col("url"), F.col("created_at"), options.marker_prefix)
    records = records.withColumns(
        {"_table": build.properties_table(F.col("_lines")), "_footer": footer if options.provenance else F.lit("")}
    )
    marker = F.concat(F.lit(options.marker_prefix), "key")
    name = clean_name(F.col("title"))
    # A date range whose other half is taken by the field of that half loses it.
    start_lost = F.col("due_date_end_ms").isNotNull() & F.col("due_date_start_ms").isNotNull() & F.col("start_date_start_ms").isNotNull()
    end_lost = F.col("start_date_end_ms").isNotNull() & F.coalesce("due_date_end_ms", "due_date_start_ms").isNotNull()
    lossy = vocab.OUTCOMES_BY_RANK.index("lossy")
    rank = F.greatest(
        F.coalesce("_rank", F.lit(0)), F.when(name_changed(F.col("title")), F.lit(2)).otherwise(F.lit(0)),
        F.when(start_lost | end_lost, F.lit(lossy)).otherwise(F.lit(0)),
    )
    body = F.struct(
        name.alias("name"),
        build.compose(F.col("_body"), F.col("_table"), F.col("_footer")).alias("markdown_content"),
        "status", "priority",
        F.coalesce("due_date_end_ms", "due_date_start_ms", "start_date_end_ms").alias("due_date"),
        F.coalesce("start_date_start_ms", F.when(F.col("due_date_end_ms").isNotNull(), F.col("due_date_start_ms"))).alias("start_date"),
        F.lit(False).alias("notify_all"),
    )
    payload = F.to_json(F.struct("list_id", (marker if options.provenance else F.lit(None).cast("string")).alias("marker"), body.alias("body")))
    created = records.select(
        stable_id("act", "create_task", F.col("key")).alias("id"), F.lit("create_task").alias("kind"),
        F.concat(F.lit('Create task "'), name, F.lit('" in list "'), "list_name", F.lit('"')).alias("label"),
        F.col("key").alias("source"), F.col("key").alias("idempotency_key"), F.concat(F.lit("dest:list:"), "list_id").alias("scope"),
        fnd.for_item(rank).alias("outcome"), payload.alias("payload"),
    )
    renamed = snapshot["records"].where(name_changed(F.col("title"))).join(targets.select("collection"), "collection", "left_semi").select(
        F.lit("NAME_NORMALIZED").alias("code"), F.lit("transformed").alias("outcome"), F.lit("info").alias("severity"),
        F.lit("data").alias("category"), F.col("key").alias("entity"), "collection", F.lit(None).cast("string").alias("field"),
    )
    half = F.array_compact(F.array(
        F.when(start_lost, F.struct(F.lit("DATE_RANGE_START_LOST").alias("code"), F.col("due_date_field_name").alias("field"))),
        F.when(end_lost, F.struct(F.lit("DATE_RANGE_END_LOST").alias("code"), F.col("start_date_field_name").alias("field"))),
    ))
    halves = records.where(start_lost | end_lost).select("key", "collection", F.inline(half)).select(
        "code", F.lit("lossy").alias("outcome"), F.lit("warning").alias("severity"), F.lit("data").alias("category"),
        F.col("key").alias("entity"), "collection", "field",
    )
    return {
        "rules": rules,
        "actions": build.skip_already_migrated(created, id_map),
        "findings": cell_findings(drafts).unionByName(renamed).unionByName(halves),
        "accounting": accounting(drafts),
        "unmapped": mp.unmapped_collections(matched),
    }


PAYLOAD_VIEW = (
    "list_id string, marker string, body struct<name:string,markdown_content:string,status:string,priority:int,"
    "due_date:bigint,start_date:bigint>"
)


def verify_migration(actions: DataFrame, id_map: DataFrame, held: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Each executed or skipped action with a destination against what the destination holds.

    held: destination_id, name, status, priority, due_date, start_date, markdown. Actions without a
    destination are missing (see ``verify.never_created`` for why).
    """
    ids_ = id_map.select("scope", F.col("source_key").alias("idempotency_key"), "destination_id")
    planned = actions.join(ids_, ["scope", "idempotency_key"], "left").withColumn("_p", F.from_json("payload", PAYLOAD_VIEW))
    plan = planned.select(
        F.col("id").alias("action_id"), "source", "scope", "destination_id", F.col("_p.body.name").alias("p_name"),
        F.col("_p.body.status").alias("p_status"), F.col("_p.body.priority").alias("p_priority"),
        F.col("_p.body.due_date").alias("p_due"), F.col("_p.body.start_date").alias("p_start"),
        F.col("_p.body.markdown_content").alias("p_markdown"),
    )
    rules = [
        vf.Rule("name", "name", "p_name", "name"), vf.Rule("status", "status", "p_status", "status_text"),
        vf.Rule("priority", "priority", "p_priority", "priority"),
        vf.Rule("due_date", "day", "p_due", "due_date", zone=timezone), vf.Rule("start_date", "day", "p_start", "start_date", zone=timezone),
        vf.Rule("description", "markdown", "p_markdown", "markdown", if_absent="unverified"),
    ]
    return vf.diff_expected_actual(plan, held.withColumnRenamed("status", "status_text"), rules).select(
        "action_id", "source", "scope", "destination_id", "status", "checks"
    )
