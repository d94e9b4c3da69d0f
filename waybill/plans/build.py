"""From records and rules to planned writes: bodies, actions, links, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import urls
from waybill.functions.ids import stable_id
from waybill.functions.text import WIDE_SIGNS, canon, clean_name, name_changed, wide_trim
from waybill.operators.findings import for_item, worst_rank
from waybill.operators.mapping import markers_in
from waybill.operators.relations import link_pairs

MARKER_PREFIX = "waybill-key:"
BODY_RULE = "\n\n---\n\n"
LINK_SCOPE = "dest:links"


# -- text of a planned item ------------------------------------------------------------------------------
def table_cell(markdown: Column) -> Column:
    flat = F.when(F.contains(markdown, F.lit("\n")), F.regexp_replace(markdown, r"\r?\n+", " ")).otherwise(markdown)
    made = wide_trim(F.replace(flat, F.lit("|"), F.lit("\\|")))
    # Most texts begin and end with a plain sign and hold nothing to change.
    plain = F.substring(markdown, 1, 1).between("!", "~") & F.substring(markdown, -1, 1).between("!", "~")
    same = plain & ~F.contains(markdown, F.lit("|")) & ~F.contains(markdown, F.lit("\n"))
    return F.when(same, markdown).otherwise(made)


def table_row(pos: Column, label: Column, markdown: Column) -> Column:
    """A row as it is gathered: in the order of its fields, with its line of the table. Lines are written row by row, in
    generated code; over a gathered array they would be interpreted."""
    line = F.concat(F.lit("| "), table_cell(label), F.lit(" | "), table_cell(markdown), F.lit(" |"))
    return F.struct(pos.alias("pos"), label.alias("label"), markdown.alias("markdown"), line.alias("line"))


def gathered_lines(row: str) -> Column:
    """Aggregate: the lines of all rows (``table_row``) in order; null ones are left out."""
    return F.sort_array(F.collect_list(row))["line"]


def properties_table(lines: Column, heading: str = "**Properties**") -> Column:
    """Lines as a Markdown table; empty when there are none."""
    head = F.lit(f"{heading}\n\n| Property | Value |\n| --- | --- |\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(head, F.array_join(lines, "\n"))).otherwise(F.lit(""))


def provenance_footer(key: Column, url: Column, created: Column, prefix: str = MARKER_PREFIX) -> Column:
    """Visible origin note with the marker a later run looks for."""
    safe = F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    link = F.when(urls.allowed_link(url), F.concat(F.lit(" [Original]("), safe, F.lit(")"))).otherwise(F.lit(""))
    when = F.coalesce(F.concat(F.lit(", created "), created), F.lit(""))
    return F.concat(F.lit("_Migrated"), when, F.lit("._"), link, F.lit(f"\n\n`{prefix}"), key, F.lit("`"))


def compose(*parts: Column) -> Column:
    """Parts that are not blank, with a rule between them. Each part is read twice: pass columns, not what makes them."""
    # Read from the left only, up to the first sign that is not white space; null is left out as well.
    return F.concat_ws(BODY_RULE, *[F.when(F.ltrim(p, F.lit(WIDE_SIGNS)) != "", p) for p in parts])


def task_body(records: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Body, property table and footer of each record, blank parts left out.

    documents: key, markdown. rows: record, pos, label, markdown (bounded by the declared fields).
    """
    written = rows.select("record", table_row(F.col("pos"), F.col("label"), F.col("markdown")).alias("row"))
    tables = written.groupBy(F.col("record").alias("key")).agg(gathered_lines("row").alias("_lines"))
    bodies = documents.select("key", F.col("markdown").alias("_body"))
    joined = records.join(bodies, "key", "left").join(tables, "key", "left").withColumns(
        {
            "_table": properties_table(F.col("_lines")),
            "_footer": provenance_footer(F.col("key"), F.col("url"), F.col("created_at")),
        }
    )
    return joined.withColumn("markdown", compose(F.col("_body"), F.col("_table"), F.col("_footer"))).drop(
        "_body", "_lines", "_table", "_footer"
    )


# -- actions ------------------------------------------------------------------------------------------------
def skip_already_migrated(drafts: DataFrame, id_map: DataFrame) -> DataFrame:
    """Skip drafts whose (scope, key) is in the id map."""
    prior = id_map.select(
        "scope", F.col("source_key").alias("idempotency_key"), F.col("destination_id").alias("existing_destination_id")
    )
    joined = drafts.join(prior, ["scope", "idempotency_key"], "left")
    had = F.col("existing_destination_id").isNotNull()
    return joined.withColumns(
        {
            "disposition": F.when(had, F.lit("skip")).otherwise(F.lit("execute")),
            "skip_reason": F.when(had, F.lit("already_migrated")),
            "outcome": F.when(had, F.lit("skipped")).otherwise(F.col("outcome")),
            "estimated_requests": F.when(had, F.lit(0)).otherwise(F.lit(1)),
        }
    )


def build_actions(
    records: DataFrame, findings: DataFrame, id_map: DataFrame, kind: str = "create_task"
) -> DataFrame:
    """One create action per record with a stable id, its outcome and its cost.

    records: key, title, scope, list_name. findings: entity, outcome. Everything joins on the
    record key, so the planner reuses one partitioning.
    """
    worst = findings.groupBy(F.col("entity").alias("key")).agg(worst_rank(F.col("outcome")).alias("_rank"))
    changed = F.when(name_changed(F.col("title")), F.lit(2)).otherwise(F.lit(0))
    rank = F.greatest(F.coalesce("_rank", F.lit(0)), changed)
    name = clean_name(F.col("title"))
    drafts = records.join(worst, "key", "left").select(
        stable_id("act", kind, F.col("key")).alias("id"),
        F.lit(kind).alias("kind"),
        F.concat(F.lit('Create task "'), name, F.lit('" in list "'), "list_name", F.lit('"')).alias("label"),
        F.col("key").alias("source"), F.col("key").alias("idempotency_key"), "scope",
        name.alias("name"), for_item(rank).alias("outcome"),
    )
    return skip_already_migrated(drafts, id_map)


def build_links(edges: DataFrame, planned: DataFrame, id_map: DataFrame) -> DataFrame:
    """Link actions for related planned records. edges: from_id, to_id (keys). planned: key, id."""
    pairs = link_pairs(edges, planned.select("key"))
    ends = lambda side, out: planned.select(F.col("key").alias(side), F.col("id").alias(out))
    key = F.concat(F.lit("link:"), "a", F.lit("|"), "b")
    drafts = (
        pairs.join(ends("a", "from_action"), "a").join(ends("b", "to_action"), "b")
        .select(
            stable_id("act", "link_tasks", key).alias("id"), F.lit("link_tasks").alias("kind"),
            key.alias("idempotency_key"), F.lit(LINK_SCOPE).alias("scope"), "from_action", "to_action",
            F.lit("transformed").alias("outcome"),
        )
    )
    return skip_already_migrated(drafts, id_map)


def build_docs(pages: DataFrame, id_map: DataFrame, scope: str) -> DataFrame:
    """Document and page actions with their dependencies.

    pages: key, title, parent_key, root_key. A root gets a document action and a page action; each
    page depends on its document and, below the root, on its parent page.
    """
    doc_key = F.concat("root_key", F.lit("#doc"))
    page_key = F.concat("key", F.lit("#page"))
    parent_key = F.concat("parent_key", F.lit("#page"))
    doc_id = stable_id("act", "create_doc", doc_key)
    docs = pages.where(F.col("key") == F.col("root_key")).select(
        doc_id.alias("id"), F.lit("create_doc").alias("kind"), F.col("key").alias("source"),
        doc_key.alias("idempotency_key"), F.lit(scope).alias("scope"), F.col("title").alias("name"),
        F.array().cast("array<string>").alias("depends_on"), F.lit("supported").alias("outcome"),
    )
    title = F.when(F.col("title") == "", F.lit("Untitled")).otherwise(F.col("title"))
    below = F.when(F.col("parent_key").isNotNull(), stable_id("act", "create_doc_page", parent_key))
    own = pages.select(
        stable_id("act", "create_doc_page", page_key).alias("id"), F.lit("create_doc_page").alias("kind"),
        F.col("key").alias("source"), page_key.alias("idempotency_key"), F.lit(scope).alias("scope"),
        title.alias("name"), F.array_compact(F.array(doc_id, below)).alias("depends_on"),
        F.lit("supported").alias("outcome"),
    )
    return skip_already_migrated(docs.unionByName(own), id_map)


# -- against the live destination -----------------------------------------------------------------------------
def marked_items(items: DataFrame, prefix: str = MARKER_PREFIX) -> DataFrame:
    """The first item per (target, marker). items: target, seq, item_id, text."""
    marked = items.select("target", "seq", "item_id", F.explode(markers_in(F.col("text"), prefix)).alias("idempotency_key"))
    return marked.groupBy("target", "idempotency_key").agg(F.min_by("item_id", "seq").alias("item_id"))


def adopt_existing(actions: DataFrame, items: DataFrame, prefix: str = MARKER_PREFIX) -> DataFrame:
    """Skip executable actions whose marker is already on an item of their target."""
    hits = marked_items(items, prefix).select(F.col("target").alias("scope"), "idempotency_key", F.col("item_id").alias("_hit"))
    joined = actions.join(hits, ["scope", "idempotency_key"], "left")
    adopted = F.col("_hit").isNotNull() & (F.col("disposition") == "execute")
    return joined.withColumns(
        {
            "adopted": adopted,
            "destination_id": F.when(adopted, F.col("_hit")),
            "outcome": F.when(adopted, F.lit("skipped")).otherwise(F.col("outcome")),
            "estimated_requests": F.when(adopted, F.lit(0)).otherwise(F.col("estimated_requests")),
            "disposition": F.when(adopted, F.lit("skip")).otherwise(F.col("disposition")),
        }
    ).drop("_hit")


def name_collisions(actions: DataFrame, items: DataFrame, normalize: bool = True) -> DataFrame:
    """Per target: executable, not adopted actions named like an existing item.

    actions: scope, name, disposition. items: target, name. Names are reduced to distinct ones first.
    """
    names = items.select(F.col("target").alias("scope"), canon(F.col("name"), normalize).alias("_canon")).distinct()
    planned = actions.where(F.col("disposition") == "execute").withColumn("_canon", canon(F.col("name"), normalize))
    return planned.join(names, ["scope", "_canon"], "left_semi").groupBy("scope").agg(F.count("*").alias("collisions"))


def missing_targets(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Planned list targets (kind, id, name) that are no longer there."""
    return planned.where(F.col("kind") == "list").join(present.select("kind", "id"), ["kind", "id"], "left_anti")


def scope_target_name(actions: DataFrame, targets: DataFrame) -> DataFrame:
    """Target name of each action: its scope equals or ends with `:<kind>:<id>`. The last two parts
    of the scope are compared as one key, so this is an equi-join. The first target wins."""
    first = targets.groupBy(F.concat_ws(":", "kind", "id").alias("_suffix")).agg(F.min_by("name", "pos").alias("target"))
    suffix = F.regexp_extract("scope", r"([^:]+:[^:]+)$", 1)
    return actions.withColumn("_suffix", suffix).join(first, "_suffix", "left").drop("_suffix")


def task_preview(actions: DataFrame, lists: DataFrame, people: DataFrame, fields: DataFrame) -> DataFrame:
    """Planned payload with list, assignee and custom-field names resolved.

    actions: id, name, list_id, assignee, custom_field, due_ms.
    """
    from waybill.functions.dates import epoch_to_iso

    return (
        actions.join(lists.select(F.col("id").alias("list_id"), F.col("name").alias("list_name")), "list_id", "left")
        .join(people.select(F.col("id").alias("assignee"), F.col("name").alias("assignee_name")), "assignee", "left")
        .join(fields.select(F.col("id").alias("custom_field"), F.col("name").alias("custom_field_name")), "custom_field", "left")
        .withColumn("due", epoch_to_iso(F.col("due_ms")))
    )


def default_task(previews: DataFrame) -> DataFrame:
    """The richest preview; ties keep plan order. One row, found by a combinable top-1."""
    score = (
        F.least(F.length("markdown"), F.lit(3000)) / 100 + F.col("assignees") * 5 + F.col("tags") * 5
        + F.col("custom_fields") * 5 + F.when(F.col("due_ms").isNotNull(), 3).otherwise(0)
        + F.when(F.col("start_ms").isNotNull(), 3).otherwise(0)
    )
    return previews.withColumn("score", score).orderBy(F.col("score").desc(), "seq").limit(1)
