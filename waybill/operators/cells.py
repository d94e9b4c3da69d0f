"""Records, fields and cells: filtering, unpivoting, completing and checking rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import ids, urls, values
from waybill.functions.text import wide_trim
from waybill.operators.ordered import first_by


def live_rows(df: DataFrame, *flags: str) -> DataFrame:
    """Drop rows trashed under any of several nullable flags."""
    trashed = F.lit(False)
    for flag in flags:
        trashed = trashed | F.coalesce(F.col(flag), F.lit(False))
    return df.where(~trashed)


def field_order() -> list[Column]:
    """Title first, then name regardless of case, then id."""
    return [(F.col("kind") != "title").asc(), F.lower("name").asc(), F.col("field_id").asc()]


def join_field_defs(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Attach the field definition to each cell; cells of undeclared fields fall away.

    Definitions are bounded by the schemas, so the optimizer broadcasts them when they are small
    enough and shuffles otherwise.
    """
    defs = fields.select(
        "collection", "field_id", F.col("name").alias("field_name"), "kind", "source_type", "pos"
    )
    return cells.drop("kind").join(defs, ["collection", "field_id"])


def cells_long(records: DataFrame, fields: DataFrame, values_map: str = "values") -> DataFrame:
    """One row per (record, declared field) from a map of field id to text."""
    exploded = records.select(
        F.col("key").alias("record"), "collection", F.explode(values_map).alias("field_id", "text")
    )
    return join_field_defs(exploded.withColumn("kind", F.lit(None).cast("string")), fields)


def record_projection(
    records: DataFrame, title: Column, url: Column, url_prefix: str, identifier: Column
) -> DataFrame:
    """Trimmed title or `Untitled`, address or its default, and the record's times."""
    trimmed = wide_trim(title)
    return records.withColumn(
        "title", F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("Untitled")).otherwise(trimmed)
    ).withColumn("url", F.coalesce(url, F.concat(F.lit(url_prefix), ids.strip_id(identifier))))


def status_groups(options: DataFrame, groups: DataFrame) -> DataFrame:
    """Each option with its status group. groups: field_id, group, option_ids; a later group wins."""
    members = groups.select(
        "field_id", "group", F.col("pos").alias("_pos"), F.explode("option_ids").alias("option_id")
    )
    last = members.groupBy("field_id", "option_id").agg(F.max_by("group", "_pos").alias("group"))
    return options.join(last, ["field_id", "option_id"], "left")


def needs_full_read(source_type: Column, items: Column, has_more: Column) -> Column:
    """Cells whose array was cut short by the page object."""
    long = F.size(items) >= vocab.PROPERTY_ITEM_CAP
    listed = source_type.isin("relation", "people", "title", "rich_text")
    return (listed & long) | ((source_type == "relation") & F.coalesce(has_more, F.lit(False)))


def truncated_values(cells: DataFrame) -> DataFrame:
    return cells.where(needs_full_read(F.col("source_type"), F.col("items"), F.col("has_more")))


def overlay_full_items(partial: DataFrame, full: DataFrame) -> DataFrame:
    """Replace cut arrays by the fully read ones; a relation with none and more to come is
    marked truncated."""
    complete = full.select("record", "field_id", F.col("items").alias("_full"))
    joined = partial.join(complete, ["record", "field_id"], "left")
    missing = F.col("_full").isNull() & F.coalesce(F.col("has_more"), F.lit(False))
    return joined.select(
        "record", "field_id", "source_type",
        F.coalesce("_full", "items").alias("items"),
        ((F.col("source_type") == "relation") & missing).alias("truncated"),
    )


def failing_paths(rules: dict[str, Column]) -> Column:
    """Paths whose rule does not hold; a rule that is null does not apply. Values never appear."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(path)) for path, ok in rules.items()])
    )


def validate_payloads(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the failing paths and whether the row is valid."""
    return df.withColumn("failing", failing_paths(rules)).withColumn("valid", F.size("failing") == 0)


def task_payload_rules() -> dict[str, Column]:
    """Strict limits on a planned create payload with columns of these names."""
    safe = lambda c: ids.safe_path_segment(F.col(c))
    size = lambda c, low, high: F.length(c).between(low, high)
    return {
        "list_id": F.coalesce(safe("list_id"), F.lit(False)),
        "marker": size("marker", 0, 300),
        "body.name": F.coalesce(size("name", 1, 5000), F.lit(False)),
        "body.markdown_content": size("markdown", 0, 2_000_000),
        "body.status": size("status", 0, 200),
        "body.priority": F.col("priority").between(1, 4),
        "body.assignees": (F.size("assignees") <= 50) & F.forall("assignees", lambda a: a > 0),
        "body.tags": (F.size("tags") <= 100) & F.forall("tags", lambda t: F.length(t) <= 200),
    }


PAYLOAD = (
    "list_id string, marker string, body struct<name:string,markdown_content:string,status:string,"
    "priority:double,due_date:double,due_date_time:boolean,start_date:double,"
    "start_date_time:boolean,assignees:array<double>,tags:array<string>,notify_all:boolean,"
    "custom_fields:array<struct<id:string>>>"
)
PAYLOAD_KEYS = ["list_id", "marker", "body"]
BODY_KEYS = [
    "name", "markdown_content", "status", "priority", "due_date", "due_date_time", "start_date",
    "start_date_time", "assignees", "tags", "custom_fields", "notify_all",
]


def validate_payload_json(df: DataFrame, column: str) -> DataFrame:
    """Strict check of a create payload as JSON text: shape, limits, and no member that is not
    known, so an edited plan cannot smuggle further request fields."""
    parsed = df.withColumns(
        {
            "_p": F.from_json(column, PAYLOAD),
            "_extra": F.array_except(F.json_object_keys(F.col(column)), F.array(*[F.lit(k) for k in PAYLOAD_KEYS])),
            "_body_extra": F.array_except(
                F.json_object_keys(F.get_json_object(column, "$.body")), F.array(*[F.lit(k) for k in BODY_KEYS])
            ),
        }
    )
    body = lambda n: F.col(f"_p.body.{n}")
    whole = lambda c: c == F.floor(c)
    required = lambda ok: F.coalesce(ok, F.lit(False))
    rules = {
        "(root)": required(F.col("_p").isNotNull() & (F.size("_extra") == 0)),
        "list_id": required(ids.safe_path_segment(F.col("_p.list_id"))),
        "marker": F.length("_p.marker") <= 300,
        "body": required(F.size("_body_extra") == 0),
        "body.name": required(F.length(body("name")).between(1, 5000)),
        "body.markdown_content": required(F.length(body("markdown_content")) <= 2_000_000),
        "body.status": F.length(body("status")) <= 200,
        "body.priority": whole(body("priority")) & body("priority").between(1, 4),
        "body.due_date": whole(body("due_date")),
        "body.start_date": whole(body("start_date")),
        "body.assignees": (F.size(body("assignees")) <= 50)
        & F.forall(body("assignees"), lambda a: (a > 0) & whole(a)),
        "body.tags": (F.size(body("tags")) <= 100) & F.forall(body("tags"), lambda x: F.length(x) <= 200),
        "body.custom_fields": (F.size(body("custom_fields")) <= 100)
        & F.forall(body("custom_fields"), lambda c: F.length(c["id"]) <= 100),
        "body.notify_all": required(~body("notify_all")),
    }
    return validate_payloads(parsed, rules).drop("_p", "_extra", "_body_extra")


def dedupe_users(sightings: DataFrame) -> DataFrame:
    """First sighting of each user, a named one before a nameless one. sightings: id, name, seq."""
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    keep = [c for c in sightings.columns if c != "id"]
    return first_by(sightings, ["id"], F.struct(nameless, F.col("seq")), keep)


def enrich_users(embedded: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory entries win over embedded ones; name and e-mail fall back to the embedded."""
    known = directory.select(
        "id", F.col("name").alias("_name"), F.col("email").alias("_email"), F.col("type").alias("_type")
    )
    joined = embedded.join(known, "id", "left")
    pick = lambda a, b: F.nullif(F.coalesce(F.col(a), F.col(b)), F.lit(""))
    return joined.select(
        "id", pick("_name", "name").alias("name"), pick("_email", "email").alias("email"),
        F.coalesce("_type", "type", F.lit("unknown")).alias("type"),
    )


def attachment_refs(rows: DataFrame, system: str) -> DataFrame:
    """Files of a cell as references with a key that does not depend on the signed address.

    rows: owner, field, files array<struct<name,type,url>>.
    """
    others = [c for c in rows.columns if c != "files"]
    files = rows.select(*others, F.posexplode("files").alias("idx", "file"))
    trimmed = wide_trim(F.coalesce(F.col("file.name"), F.lit("")))
    name = F.when(trimmed == "", F.concat(F.lit("file-"), F.col("idx") + 1)).otherwise(trimmed)
    external = F.col("file.type") == "external"
    key = ids.attachment_key(F.col("owner"), F.col("field"), F.col("idx"), name)
    return files.select(
        *others, "idx",
        F.concat(F.lit(f"{system}:file:"), key).alias("key"),
        name.alias("name"),
        F.when(external, F.lit("external")).when(F.col("file.type") == "file_upload", F.lit("upload"))
        .otherwise(F.lit("internal")).alias("hosting"),
        F.when(external, urls.external_url(F.col("file.url"))).alias("url"),
    )


# -- findings made from cells -------------------------------------------------------------------------
def finding(code: str, outcome: str, severity: str, category: str, message: str,
            **columns: Column) -> Callable[[DataFrame], DataFrame]:
    """A projection of rows to findings with fixed attributes and the given key columns."""
    none = F.lit(None).cast("string")
    return lambda df: df.select(
        F.lit(code).alias("code"), F.lit(outcome).alias("outcome"), F.lit(severity).alias("severity"),
        F.lit(category).alias("category"), F.lit(message).alias("message"),
        columns.get("entity", none).alias("entity"),
        columns.get("collection", none).alias("collection"),
        columns.get("field", none).alias("field"),
    )


def source_feature_findings(documents: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """What could not be read: bodies, icons, covers, field types, malformed values.

    documents: key, collection, body_status, has_icon, has_cover. cells: record, collection,
    field_name, malformed.
    """
    doc = dict(entity=F.col("key"), collection=F.col("collection"))
    parts = [
        finding("PAGE_BODY_INACCESSIBLE", "unsupported", "warning", "permission",
                "The page content could not be read.", **doc)(
            documents.where(F.col("body_status") == "inaccessible")),
        finding("PAGE_ICON_NOT_MIGRATED", "unsupported", "info", "source_feature",
                "Icons are not migrated.", entity=F.col("key"))(documents.where("has_icon")),
        finding("PAGE_COVER_NOT_MIGRATED", "unsupported", "info", "source_feature",
                "Covers are not migrated.", entity=F.col("key"))(documents.where("has_cover")),
        finding("SOURCE_FIELD_UNREADABLE", "unsupported", "warning", "field_type",
                "This property type has no portable form.", collection=F.col("collection"),
                field=F.col("name"))(fields.where(F.col("kind") == "unsupported")),
        finding("PROPERTY_VALUE_MALFORMED", "unsupported", "warning", "data",
                "The value had an unexpected shape and was not read.", entity=F.col("record"),
                collection=F.col("collection"), field=F.col("field_name"))(cells.where("malformed")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def skipped_value_findings(cells: DataFrame, rules: DataFrame, present: Column) -> DataFrame:
    """One finding per record whose skipped or dropped field holds a value.

    rules: collection, field_id, field_name, target_kind, outcome, explicit.
    """
    dropped = rules.where(F.col("target_kind") == "dropped").select(
        "collection", "field_id", F.col("field_name").alias("field"), "explicit"
    )
    hit = cells.where(present).join(dropped, ["collection", "field_id"])
    explicit = F.col("explicit")
    return hit.select(
        F.when(explicit, F.lit("FIELD_EXPLICITLY_SKIPPED")).otherwise(F.lit("FIELD_DROPPED")).alias("code"),
        F.when(explicit, F.lit("skipped")).otherwise(F.lit("unsupported")).alias("outcome"),
        F.when(explicit, F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
        F.col("record").alias("entity"), "collection", "field",
    )


def text_code(kind: Column) -> Column:
    return (
        F.when(kind == "computed", F.lit("FIELD_SNAPSHOT_ONLY"))
        .when(kind.isin("timestamp", "userStamp"), F.lit("METADATA_AS_TEXT"))
        .otherwise(F.lit("FIELD_PRESERVED_AS_TEXT"))
    )


def text_fallback_rows(cells: DataFrame, rules: DataFrame, markdown: Column) -> DataFrame:
    """Values without a first-class target as (label, text) rows of their record, with a code.

    rules: collection, field_id, field_name, pos, target_kind; those of kind description_table
    apply.
    """
    kept = rules.where(F.col("target_kind") == "description_table").select(
        "collection", "field_id", F.col("field_name").alias("label"), "pos"
    )
    kind = F.col("kind")
    lossy = kind.isin("computed", "timestamp", "userStamp")
    return (
        cells.withColumn("markdown", markdown).where(F.col("markdown").isNotNull())
        .join(kept, ["collection", "field_id"])
        .select(
            "record", "collection", "field_id", "label", "pos", "markdown",
            text_code(kind).alias("code"),
            F.when(lossy, F.lit("lossy")).otherwise(F.lit("transformed")).alias("outcome"),
        )
    )


def custom_field_values(cells: DataFrame, targets: DataFrame, zone: str) -> DataFrame:
    """Typed destination value per (record, target field), or the code of the text fallback.

    targets: collection, field_id, target_id, target_type, options array<struct<id,canon>>. Options
    are bounded by the target's definition and are searched inside the row. ``plain`` is the text
    form of the cell, ``start`` its date text.
    """
    from waybill.functions.dates import with_converted_date
    from waybill.functions.text import canon

    kind, target, plain = F.col("kind"), F.col("target_type"), F.col("plain")
    none, date = F.lit(None).cast("string"), F.col("_date")
    joined = with_converted_date(
        cells.join(targets, ["collection", "field_id"]),
        F.when((target == "date") & (kind == "date"), plain), none, none, zone, "_date",
    )
    option_of = lambda name: F.get(
        F.filter("options", lambda o: o["canon"] == canon(name)), F.lit(0)
    )["id"]
    chosen = option_of(plain)
    valid = (
        F.when(target == "url", urls.valid_url(plain)).when(target == "email", urls.valid_email(plain))
        .when(target == "phone", urls.valid_phone(plain))
    )
    present = plain.isNotNull() & (plain != "")
    value = (
        F.when(target.isin("number", "currency"), F.when(kind == "number", plain))
        .when(target == "checkbox", F.when(kind == "checkbox", plain))
        .when(target == "date", F.when(kind == "date", date["start_ms"].cast("string")))
        .when(target.isin("url", "email", "phone"), F.when(valid, plain))
        .when(target == "drop_down", chosen)
        .otherwise(plain)
    )
    code = (
        F.when((target == "date") & (kind == "date") & date["invalid"], F.lit("DATE_UNPARSEABLE"))
        .when(target.isin("url", "email", "phone") & ~valid, F.lit("CUSTOM_FIELD_VALUE_INVALID"))
        .when((target == "drop_down") & chosen.isNull(), F.lit("OPTION_VALUE_UNMAPPED"))
    )
    return joined.where(present).select(
        "record", "field_id", "target_id", "target_type", value.alias("value"),
        code.alias("code"), F.when(code.isNotNull(), plain).alias("fallback"),
    )


def row_cap(
    df: DataFrame, bucket: Column, order: list[str], limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows in order, and a one-row report of whether more were left unread.

    The cap is the feature: it reports itself as incomplete and names the reason. ``bucket`` is a
    coarse, monotone form of the order (such as the day of the creation time): rows are counted
    per bucket first, so only the buckets the cap reaches into are sorted. Without a limit all rows
    are read.
    """
    if limit is None:
        whole = df.agg(F.count("*").alias("rows"), F.lit(False).alias("incomplete"), F.lit(None).cast("string").alias("reason"))
        return df, whole
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    # One row per bucket.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = reached.where(F.col("_before") < limit).select("_bucket")
    near = df.withColumn("_bucket", bucket).join(wanted, "_bucket", "left_semi").drop("_bucket")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    report = total.select(
        F.least("_n", F.lit(limit)).cast("bigint").alias("rows"),
        (F.col("_n") > limit).alias("incomplete"),
        F.when(F.col("_n") > limit, F.lit("max_records")).alias("reason"),
    )
    return near.orderBy(*order).limit(limit), report


def inspect_collections(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Live row count of each collection and how portable each of its fields is."""
    counted = records.groupBy("collection").agg(F.count("*").alias("record_count"))
    return fields.join(counted, "collection", "left").select(
        "collection", "field_id", "name", "kind",
        F.coalesce("record_count", F.lit(0).cast("bigint")).alias("record_count"),
        values.portability(F.col("kind")).alias("support"),
        values.portability_note(F.col("kind")).alias("note"),
    )
