"""Typed values: reading raw payloads, and their plain-text and Markdown forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import jsontext, urls
from waybill.functions.dates import format_date_range
from waybill.functions.ids import unique_id_display
from waybill.functions.text import canon, number_text, wide_trim

Get = Callable[[str], Column]


def field_kind(source_type: Column) -> Column:
    return vocab.lookup(source_type, vocab.FIELD_KINDS, F.lit("unsupported"))


def read_only(source_type: Column) -> Column:
    return source_type.isin(vocab.READ_ONLY_TYPES)


def portability(kind: Column) -> Column:
    """How a kind of field fares at any destination."""
    return (
        F.when(kind.isin("relation", "files", "uniqueId"), F.lit("transformed"))
        .when(kind.isin("computed", "timestamp", "userStamp"), F.lit("lossy"))
        .when(kind == "unsupported", F.lit("unsupported"))
        .otherwise(F.lit("supported"))
    )


def portability_note(kind: Column) -> Column:
    return vocab.lookup(
        kind,
        {
            "relation": "Needs links at the destination; targets outside the selection are lost.",
            "files": "Carried as references only; the bytes stay where they are.",
            "computed": "Only the last computed value is carried, not the logic.",
            "timestamp": "Creation and edit metadata can rarely be set.",
            "userStamp": "Creation and edit metadata can rarely be set.",
            "uniqueId": "Kept as text; numbering does not continue.",
            "unsupported": "No portable representation.",
        },
    )


def value_to_plain(get: Get = F.col) -> Column:
    """Text form of any typed cell; null when it holds nothing."""
    kind, text, users = get("kind"), get("text"), get("users")
    names, targets, date = get("names"), get("targets"), get("date")
    people = F.transform(users, lambda u: F.coalesce(u["name"], u["email"], u["id"]))
    stamp = F.get(users, F.lit(0))
    return (
        F.when(kind.isin("title", "text", "url", "email", "phone"), text)
        .when(kind.isin("computed", "timestamp", "uniqueId"), text)
        .when(kind == "number", number_text(get("number")))
        .when(kind.isin("select", "status"), get("name"))
        .when(
            kind.isin("multiSelect", "files"),
            F.when(F.size(names) > 0, F.array_join(names, ", ")),
        )
        .when(
            kind == "date",
            format_date_range(date["start"], date["end"], date["time_zone"]),
        )
        .when(kind == "checkbox", F.when(get("flag"), F.lit("Yes")).otherwise(F.lit("No")))
        .when(kind == "person", F.when(F.size(users) > 0, F.array_join(people, ", ")))
        .when(
            kind == "relation",
            F.when(
                F.size(targets) > 0,
                F.concat(F.size(targets).cast("string"), F.lit(" linked item(s)")),
            ),
        )
        .when(kind == "userStamp", F.coalesce(stamp["name"], stamp["id"]))
    )


def value_presence(get: Get = F.col) -> Column:
    return value_to_plain(get).isNotNull()


def file_markdown(name: Column, hosting: Column, url: Column) -> Column:
    """One file inside a property table: a link when it is external, else only its name."""
    linked = F.concat(F.lit("["), name, F.lit("]("), url, F.lit(")"))
    external = (hosting == "external") & urls.allowed_link(url)
    return F.when(external, linked).otherwise(F.concat(name, F.lit(" (file not migrated)")))


def value_to_markdown(
    get: Get = F.col, rich: Column | None = None, files: Column | None = None,
    related: Column | None = None,
) -> Column:
    """Markdown form of a cell; null when there is nothing to write.

    ``rich`` is the rendered rich text, ``files`` the cell's attachments as an array of structs
    (name, hosting, url) and ``related`` the joined titles of a relation, where those exist.
    """
    kind, text = get("kind"), get("text")
    plain = value_to_plain(get)
    link = F.when(
        urls.allowed_link(text), F.concat(F.lit("["), text, F.lit("]("), text, F.lit(")"))
    ).otherwise(text)
    body = F.when(kind == "url", link)
    if rich is not None:
        body = body.when(kind.isin("title", "text"), F.coalesce(rich, text))
    if files is not None:
        parts = F.transform(files, lambda f: file_markdown(f["name"], f["hosting"], f["url"]))
        body = body.when(kind == "files", F.array_join(parts, ", "))
    if related is not None:
        body = body.when(kind == "relation", related)
    return F.nullif(body.otherwise(plain), F.lit(""))


def priority_from(value: Column) -> Column:
    """1 to 4 from a number, numeric text or a name; null for anything else."""
    number = wide_trim(value).try_cast("double")
    whole = number == F.floor(number)
    named = vocab.lookup(canon(value), vocab.PRIORITY_NAMES)
    in_range = F.when(number.isin(1.0, 2.0, 3.0, 4.0), number.cast("int"))
    return F.when(whole, in_range).otherwise(named)


def _scalar(value: Column) -> Column:
    """Text of a scalar variant; null for anything else."""
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(shape.isin("STRING", "BOOLEAN"), text).when(
        shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number_text(text.try_cast("double"))
    )


SCALAR_MEMBERS = ["number", "string", "boolean", "select", "url"]


def _member(payload: Column, kind: Column) -> Column:
    """The member of a payload named by its own type."""
    case = F.when(kind == SCALAR_MEMBERS[0], F.try_variant_get(payload, f"$.{SCALAR_MEMBERS[0]}", "variant"))
    for name in SCALAR_MEMBERS[1:]:
        case = case.when(kind == name, F.try_variant_get(payload, f"$.{name}", "variant"))
    return case


def _item_text(item: Column) -> Column:
    kind = F.try_variant_get(item, "$.type", "string")
    rich = F.coalesce(
        F.try_variant_get(item, "$.title", "array<variant>"),
        F.try_variant_get(item, "$.rich_text", "array<variant>"),
    )
    joined = F.array_join(F.transform(rich, lambda s: F.try_variant_get(s, "$.plain_text", "string")), "")
    return F.coalesce(
        F.when(kind.isin("title", "rich_text"), joined)
        .when(kind == "date", F.try_variant_get(item, "$.date.start", "string"))
        .otherwise(_scalar(_member(item, kind))),
        F.lit(""),
    )


def with_computed_display(df: DataFrame, computed_type: str, payload: str, out: str) -> DataFrame:
    """Add display text and completeness of a formula or rollup payload (a variant column)."""
    p = F.col(payload)
    kind = F.col("_kind")
    typed = df.withColumn("_kind", F.try_variant_get(p, "$.type", "string")).withColumn(
        "_member", _member(p, F.col("_kind"))
    )
    single = F.when(kind == "date", F.try_variant_get(p, "$.date.start", "string")).otherwise(
        _scalar(F.col("_member"))
    )
    if computed_type == "formula":
        display, complete = single, kind.isNotNull()
    else:
        items = F.try_variant_get(p, "$.array", "array<variant>")
        parts = F.filter(F.transform(items, _item_text), lambda t: t != "")
        broken = kind.isNull() | kind.isin("incomplete", "unsupported")
        listed = F.coalesce(F.array_join(parts, ", "), F.lit(""))
        display = F.when(~broken, F.when(kind == "array", listed).otherwise(single))
        complete = ~broken
    shown = F.struct(display.alias("display"), complete.alias("complete"))
    return typed.withColumn(out, shown).drop("_kind", "_member")


def with_typed_value(df: DataFrame, kind: str, payload: str, out: str) -> DataFrame:
    """Add a raw payload (a variant column) as a typed cell, by the field kind in ``kind``.

    A value of the wrong shape is flagged ``malformed`` and read as unsupported; it never stops the
    job. Stacked projections keep each look into the payload to one evaluation.
    """
    k, p, shape = F.col(kind), F.col(payload), F.col("_shape")
    text_of = lambda path: F.try_variant_get(p, path, "string")
    # A rollup is read as a formula where it holds a single value; only rollups hold arrays.
    staged = with_computed_display(df, "rollup", payload, "_computed").withColumns(
        {"_schema": F.schema_of_variant(p), "_items": F.try_variant_get(p, "$", "array<variant>"),
         "_text": text_of("$"), "_name": text_of("$.name")}
    )
    inner = lambda path: F.transform(
        "_items", lambda i: F.try_variant_get(i, path, "string")
    )
    staged = staged.withColumns(
        {"_shape": jsontext.kind_of_schema(F.col("_schema")), "_rich": inner("$.plain_text"),
         "_names": inner("$.name"), "_ids": inner("$.id")}
    )
    whole = lambda c: F.coalesce(F.forall(c, lambda v: v.isNotNull()), F.lit(False))
    empty = shape.isin("null", "missing")
    listed = shape == "array"
    good = (
        F.when(k.isin("title", "text"), listed & whole("_rich"))
        .when(k == "number", empty | (shape == "number"))
        .when(k.isin("select", "status"), empty | ((shape == "object") & F.col("_name").isNotNull()))
        .when(k == "multiSelect", listed & whole("_names"))
        .when(k == "checkbox", shape == "boolean")
        .when(k.isin("url", "email", "phone"), empty | (shape == "string"))
        .when(k.isin("person", "relation"), listed & whole("_ids"))
        .when(k == "files", listed)
        .otherwise(F.lit(True))
    )
    staged = staged.withColumn("_good", good)
    serial = F.try_variant_get(p, "$.number", "bigint")
    text = (
        F.when(k.isin("title", "text"), F.array_join("_rich", ""))
        .when(k.isin("url", "email", "phone", "timestamp"), F.when(shape == "string", F.col("_text")))
        .when(k == "uniqueId", unique_id_display(text_of("$.prefix"), serial))
        .when(k == "computed", F.col("_computed.display"))
    )
    date = F.struct(
        text_of("$.start").alias("start"), text_of("$.end").alias("end"),
        text_of("$.time_zone").alias("time_zone"),
    )
    use = lambda test, value: F.when(F.col("_good") & test, value)
    cell = F.struct(
        F.when(F.col("_good"), k).otherwise(F.lit("unsupported")).alias("kind"),
        F.when(F.col("_good"), text).alias("text"),
        use((k == "number") & (shape == "number"), F.try_variant_get(p, "$", "double")).alias("number"),
        use(k.isin("select", "status"), F.col("_name")).alias("name"),
        use(k.isin("multiSelect", "files"), F.col("_names")).alias("names"),
        use(k == "checkbox", F.try_variant_get(p, "$", "boolean")).alias("flag"),
        use((k == "date") & text_of("$.start").isNotNull(), date).alias("date"),
        use(k.isin("person", "relation"), F.col("_ids")).alias("targets"),
        (~F.col("_good")).alias("malformed"),
    )
    return staged.withColumn(out, cell).drop(
        "_computed", "_schema", "_items", "_text", "_name", "_shape", "_rich", "_names", "_ids", "_good"
    )
