"""Pages as flat block tables: normalizing, limits, findings and Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import richtext, urls
from waybill.functions.ids import strip_id
from waybill.functions.text import wide_trim
from waybill.schemas import SPAN
from waybill.sources.sinks import shared_folder

MAX_BLOCK_DEPTH = 8

# Raw block type -> kind; anything else is `unsupported`.
BLOCK_KINDS = {
    "paragraph": "paragraph",
    "heading_1": "heading",
    "heading_2": "heading",
    "heading_3": "heading",
    "heading_4": "heading",
    "bulleted_list_item": "bulletedListItem",
    "numbered_list_item": "numberedListItem",
    "to_do": "toDo",
    "toggle": "toggle",
    "quote": "quote",
    "callout": "callout",
    "code": "code",
    "divider": "divider",
    "table": "table",
    "table_row": "tableRow",
    "image": "image",
    "file": "file",
    "pdf": "file",
    "video": "file",
    "audio": "file",
    "bookmark": "bookmark",
    "embed": "embed",
    "link_preview": "bookmark",
    "equation": "equation",
    "child_page": "childPage",
    "child_database": "childDatabase",
    "column_list": "columnList",
    "column": "column",
    "synced_block": "syncedBlock",
    "link_to_page": "linkToPage",
    "table_of_contents": "tableOfContents",
    "breadcrumb": "breadcrumb",
}
LIST_KINDS = ["bulletedListItem", "numberedListItem", "toDo"]
FILE_TYPES = ["image", "file", "pdf", "video", "audio"]

# Finding code -> (outcome, category).
BLOCK_CODES = {
    "BLOCK_HEADING_LEVEL_FLATTENED": ("lossy", "block_type"),
    "BLOCK_TODO_AS_TEXT": ("lossy", "block_type"),
    "BLOCK_TOGGLE_FLATTENED": ("lossy", "block_type"),
    "BLOCK_CALLOUT_AS_QUOTE": ("lossy", "block_type"),
    "BLOCK_CODE_FORMATTING": ("transformed", "block_type"),
    "BLOCK_EMBED_NO_URL": ("unsupported", "block_type"),
    "BLOCK_EMBED_AS_LINK": ("transformed", "block_type"),
    "BLOCK_EQUATION_AS_CODE": ("lossy", "block_type"),
    "BLOCK_CHILD_PAGE_AS_LINK": ("transformed", "block_type"),
    "BLOCK_CHILD_DATABASE_NOT_INLINED": ("unsupported", "scope"),
    "BLOCK_COLUMNS_FLATTENED": ("lossy", "block_type"),
    "BLOCK_SYNCED_UNAVAILABLE": ("unsupported", "permission"),
    "BLOCK_SYNCED_COPIED": ("lossy", "block_type"),
    "BLOCK_AUTO_GENERATED_OMITTED": ("lossy", "block_type"),
    "BLOCK_UNSUPPORTED": ("unsupported", "block_type"),
    "BLOCK_NESTING_FLATTENED": ("lossy", "formatting"),
    "BLOCK_TABLE_FORMATTING": ("transformed", "block_type"),
    "ATTACHMENT_HOSTED_NOT_MIGRATED": ("unsupported", "attachment"),
    "ATTACHMENT_URL_REJECTED": ("unsupported", "attachment"),
    "ATTACHMENT_EXTERNAL_AS_LINK": ("transformed", "attachment"),
    "INLINE_EQUATION_AS_CODE": ("lossy", "formatting"),
    "FORMAT_UNDERLINE_DROPPED": ("lossy", "formatting"),
    "FORMAT_COLOR_DROPPED": ("lossy", "formatting"),
    "MENTION_USER_AS_TEXT": ("transformed", "user_mapping"),
}


@dataclass(frozen=True)
class Policy:
    """What the destination's Markdown can express."""

    max_heading_level: int = 3
    supports_underline: bool = False
    supports_color: bool = False
    task_lists: bool = True
    task_lists_lossy: bool = True
    tables_lossy: bool = True
    code_blocks_lossy: bool = True
    child_pages: str = "link"
    placeholders: bool = True


def _last_segment(url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    name = F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))
    return F.try_url_decode(name)


def normalize_blocks(raw: DataFrame, key_prefix: str, page_url_prefix: str) -> DataFrame:
    """Raw blocks (doc, block_id, parent_id, pos, path, depth, type, payload JSON, status) to
    normalized ones. One projection, no shuffle; types not known here become `unsupported`."""
    p = F.col("_p")
    text = lambda path: F.try_variant_get(p, path, "string")
    flag = lambda path: F.coalesce(F.try_variant_get(p, path, "boolean"), F.lit(False))
    rich = lambda path: richtext.normalize_spans(
        F.to_json(F.try_variant_get(p, path, "variant")), page_url_prefix, key_prefix
    )
    parsed = raw.withColumn("_p", F.try_parse_json(F.coalesce("payload", F.lit("{}")))).withColumns(
        {"_caption": rich("$.caption"), "_rich": rich("$.rich_text")}
    )
    kind_of = F.col("type")
    kind = vocab.lookup(kind_of, BLOCK_KINDS, F.lit("unsupported"))
    is_file = kind_of.isin(*FILE_TYPES)
    is_link = kind_of.isin("bookmark", "embed", "link_preview")
    address = F.when(is_file, F.when(text("$.type") == "external", text("$.external.url"))).when(
        is_link, text("$.url")
    )
    url = urls.external_url(address)
    bare = strip_id(F.col("block_id"))
    linked = F.when(text("$.type") == "page_id", strip_id(text("$.page_id")))
    page = F.when(kind_of == "child_page", bare).when(kind_of == "link_to_page", linked)
    caption = richtext.plain_text(F.col("_caption"))
    spans = F.when(is_file | is_link, F.col("_caption")).otherwise(F.col("_rich"))
    title = (
        F.when(kind_of == "code", F.nullif(caption, F.lit("")))
        .when(is_link, url)
        .when(kind_of.isin("child_page", "child_database"), F.coalesce(text("$.title"), F.lit("Untitled")))
        .when(
            kind_of == "link_to_page",
            F.when(page.isNotNull(), F.lit("Linked page"))
            .when(text("$.type") == "database_id", F.lit("Linked database")).otherwise(F.lit("Link")),
        )
    )
    file_name = F.coalesce(
        F.nullif(wide_trim(text("$.name")), F.lit("")), F.nullif(wide_trim(caption), F.lit("")),
        _last_segment(url), kind_of,
    )
    unavailable = (F.col("status") == "inaccessible") & text("$.synced_from.block_id").isNotNull()
    cells = F.transform(
        F.try_variant_get(p, "$.cells", "array<variant>"),
        lambda c: richtext.spans_markdown(
            richtext.normalize_spans(F.to_json(c), page_url_prefix, key_prefix), in_table=True
        ),
    )
    return parsed.select(
        "doc", "block_id", "parent_id", "pos", "path", "depth",
        kind.alias("kind"),
        F.when(kind_of == "unsupported", F.coalesce(text("$.block_type"), F.lit("unsupported")))
        .otherwise(kind_of).alias("source_type"),
        F.when(kind == "heading", F.substring(kind_of, -1, 1).try_cast("int")).alias("level"),
        F.when(kind == "toDo", flag("$.checked")).alias("checked"),
        F.when(kind == "code", F.coalesce(text("$.language"), F.lit("plain text"))).alias("language"),
        F.when((kind == "callout") & (text("$.icon.type") == "emoji"), text("$.icon.emoji")).alias("icon"),
        F.coalesce(url, F.when(page.isNotNull(), F.concat(F.lit(page_url_prefix), page))).alias("url"),
        F.when(is_file, F.when(text("$.type") == "external", F.lit("external")).otherwise(F.lit("internal"))).alias("hosting"),
        F.when(is_file, kind_of).alias("file_kind"),
        F.when(is_file, file_name).alias("file_name"),
        F.when(page.isNotNull(), F.concat(F.lit(f"{key_prefix}:page:"), page)).alias("target"),
        title.alias("title"),
        F.when(kind == "equation", F.coalesce(text("$.expression"), F.lit(""))).alias("expression"),
        F.when(kind == "table", flag("$.has_column_header")).alias("column_header"),
        F.when(kind == "table", flag("$.has_row_header")).alias("row_header"),
        F.when((kind == "syncedBlock") & unavailable, F.lit("original not shared"))
        .when(kind == "unsupported", F.lit("block type not supported")).alias("reason"),
        F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).alias("spans"),
        F.coalesce(cells, F.array().cast("array<string>")).alias("cells"),
    )


def block_access_findings(raw: DataFrame) -> DataFrame:
    """Blocks whose children could not be read, and why. raw: doc, block_id, type, status."""
    code = vocab.lookup(
        F.col("status"),
        {
            "inaccessible": "BLOCK_CHILDREN_INACCESSIBLE",
            "depth_limit": "BLOCK_DEPTH_LIMIT",
            "budget": "PAGE_BLOCK_BUDGET",
        },
    )
    hidden = F.col("status") == "inaccessible"
    return raw.withColumn("code", code).where(F.col("code").isNotNull()).select(
        F.col("doc").alias("entity"), F.col("block_id"), "code",
        F.when(hidden, F.lit("unsupported")).otherwise(F.lit("lossy")).alias("outcome"),
        F.lit("warning").alias("severity"), F.col("type").alias("field"),
    )


def depth_limit(blocks: DataFrame, max_depth: int = MAX_BLOCK_DEPTH) -> DataFrame:
    """Blocks down to a depth, when a page is read; ``over_depth`` names the pages that have more."""
    return blocks.where(F.col("depth") <= max_depth)


def over_depth(blocks: DataFrame, max_depth: int = MAX_BLOCK_DEPTH) -> DataFrame:
    deep = blocks.where(F.col("depth") > max_depth).groupBy("doc").agg(F.count("*").alias("blocks"))
    return deep.withColumn("code", F.lit("BLOCK_DEPTH_LIMIT"))


def block_budget(blocks: DataFrame, max_blocks: int) -> DataFrame:
    """The first blocks of each page, in page order. The budget is the feature; pages over it are
    named by ``over_budget``. Up to a budget of ``spark.sql.optimizer.windowGroupLimitThreshold``
    (1 000) the rank filter runs before the shuffle too, so a page that holds a third of all blocks
    sends at most the budget from each task; above it, the blocks of a page meet in one task."""
    order = Window.partitionBy("doc").orderBy("path")
    return blocks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_blocks).drop("_n")


def over_budget(blocks: DataFrame, max_blocks: int) -> DataFrame:
    counted = blocks.groupBy("doc").agg(F.count("*").alias("blocks"))
    return counted.where(F.col("blocks") > max_blocks).withColumn("code", F.lit("PAGE_BLOCK_BUDGET"))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc", "kind").agg(F.count("*").alias("blocks"))


def child_pages(blocks: DataFrame) -> DataFrame:
    """Pages mentioned by blocks, with their place on the page."""
    return blocks.where((F.col("kind") == "childPage") & F.col("target").isNotNull()).select(
        F.col("doc").alias("parent"), F.col("target").alias("key"), "path", "pos"
    )


def prune_migrated_children(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop child-page blocks whose page moves by itself."""
    moved = pages.select(F.col("key").alias("target"), F.lit("childPage").alias("kind"))
    return blocks.join(moved, ["target", "kind"], "left_anti")


# -- findings --------------------------------------------------------------------------------------------
def _block_codes(policy: Policy) -> Column:
    kind, link = F.col("kind"), urls.allowed_link(F.col("url"))
    is_media = kind.isin("image", "file")
    is_embed = kind.isin("bookmark", "embed")
    say = lambda test, code: F.when(test, F.lit(code))
    own = F.array(
        say((kind == "heading") & (F.coalesce("level", F.lit(1)) > policy.max_heading_level), "BLOCK_HEADING_LEVEL_FLATTENED"),
        say((kind == "toDo") & F.lit(policy.task_lists_lossy), "BLOCK_TODO_AS_TEXT"),
        say(kind == "toggle", "BLOCK_TOGGLE_FLATTENED"),
        say(kind == "callout", "BLOCK_CALLOUT_AS_QUOTE"),
        say((kind == "code") & F.lit(policy.code_blocks_lossy), "BLOCK_CODE_FORMATTING"),
        say(is_embed & ~link, "BLOCK_EMBED_NO_URL"),
        say(is_embed & link, "BLOCK_EMBED_AS_LINK"),
        say(kind == "equation", "BLOCK_EQUATION_AS_CODE"),
        say((kind == "childPage") & F.lit(policy.child_pages != "omit"), "BLOCK_CHILD_PAGE_AS_LINK"),
        say(kind == "childDatabase", "BLOCK_CHILD_DATABASE_NOT_INLINED"),
        say(kind == "columnList", "BLOCK_COLUMNS_FLATTENED"),
        say((kind == "syncedBlock") & F.col("reason").isNotNull(), "BLOCK_SYNCED_UNAVAILABLE"),
        say((kind == "syncedBlock") & F.col("reason").isNull(), "BLOCK_SYNCED_COPIED"),
        say(kind.isin("tableOfContents", "breadcrumb"), "BLOCK_AUTO_GENERATED_OMITTED"),
        say(kind == "unsupported", "BLOCK_UNSUPPORTED"),
        say(kind.isin("paragraph", "heading") & F.col("has_children"), "BLOCK_NESTING_FLATTENED"),
        say((kind == "table") & F.lit(policy.tables_lossy), "BLOCK_TABLE_FORMATTING"),
        say(is_media & (F.col("hosting") == "internal"), "ATTACHMENT_HOSTED_NOT_MIGRATED"),
        say(is_media & (F.col("hosting") != "internal") & ~link, "ATTACHMENT_URL_REJECTED"),
        say(is_media & (F.col("hosting") != "internal") & link, "ATTACHMENT_EXTERNAL_AS_LINK"),
    )
    written = kind.isin(
        "paragraph", "heading", "bulletedListItem", "numberedListItem", "toDo", "toggle", "quote",
        "callout",
    ) | ((is_embed | (is_media & (F.col("hosting") != "internal"))) & link)
    span = F.flatten(
        F.transform(
            richtext.merge_spans(F.col("spans")),
            lambda s: richtext.span_codes(s, policy.supports_underline, policy.supports_color),
        )
    )
    block_level = F.transform(
        F.array_compact(own), lambda c: F.struct(c.alias("code"), F.col("source_type").alias("field"))
    )
    span_level = F.transform(
        F.when(written, span).otherwise(F.array().cast("array<string>")),
        lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("field")),
    )
    return F.concat(block_level, span_level)


def with_children_flag(blocks: DataFrame) -> DataFrame:
    parents = blocks.where(F.col("parent_id").isNotNull()).select(
        "doc", F.col("parent_id").alias("block_id"), F.lit(True).alias("_p")
    ).distinct()
    return blocks.join(parents, ["doc", "block_id"], "left").withColumn(
        "has_children", F.col("_p").isNotNull()
    ).drop("_p")


def block_findings(blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What each page loses in writing: one counted row per (document, code, field)."""
    coded = with_children_flag(blocks).select("doc", F.inline(_block_codes(policy)))
    counted = coded.groupBy("doc", "code", "field").agg(F.count("*").alias("count"))
    outcome = vocab.lookup(F.col("code"), {c: o for c, (o, _) in BLOCK_CODES.items()})
    category = vocab.lookup(F.col("code"), {c: k for c, (_, k) in BLOCK_CODES.items()})
    return counted.select(
        F.col("doc").alias("entity"), "code", outcome.alias("outcome"),
        F.when(outcome == "transformed", F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
        category.alias("category"), "field", "count",
    )


# -- Markdown ----------------------------------------------------------------------------------------------
def _join(*parts: Column, sep: str = "\n\n") -> Column:
    """The non-empty parts, separated."""
    return F.array_join(F.filter(F.array(*parts), lambda s: s != ""), sep)


def _quote(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(body, r"(?m)^(?=.)", "> "), r"(?m)^$", ">")


def _table(policy: Policy) -> Column:
    rows = F.transform(
        F.filter("child_parts", lambda c: c["kind"] == "tableRow"), lambda c: c["cells"]
    )
    width = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    at = F.sequence(F.lit(0), width - 1)

    def line(cells: Column) -> Column:
        def cell(i: Column) -> Column:
            text = wide_trim(F.coalesce(F.get(cells, i), F.lit("")))
            bold = F.coalesce(F.col("row_header"), F.lit(False)) & (i == 0) & (text != "")
            return F.when(bold, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)

        return F.concat(F.lit("| "), F.array_join(F.transform(at, cell), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(at, lambda i: F.lit("---")), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.transform(at, lambda i: F.lit("")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    headed = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    bare = F.concat(F.array(blank, rule), lines)
    body = F.when(F.coalesce(F.col("column_header"), F.lit(False)), headed).otherwise(bare)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(body, "\n")).otherwise(F.lit(""))


def _block_text(policy: Policy) -> Column:
    """Markdown of a block from its own text and its children's."""
    kind, inline, kids = F.col("kind"), F.col("_inline"), F.col("children_md")
    url, title = F.col("url"), wide_trim(F.coalesce("title", F.lit("")))
    link_ok = urls.allowed_link(url)
    name = F.coalesce("file_name", "title", F.lit("file"))
    escape = richtext.escape_markdown

    def note(*parts: Column) -> Column:
        body = F.concat(F.lit("*["), *parts, F.lit("]*"))
        return body if policy.placeholders else F.lit("")

    def linked(label: Column) -> Column:
        return F.concat(F.lit("["), escape(label), F.lit("]("), urls.link_target(url), F.lit(")"))

    level = F.least(F.coalesce("level", F.lit(1)), F.lit(policy.max_heading_level))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(inline, r"\s*\n\s*", " "))
    indented = F.regexp_replace(kids, r"(?m)^(?=.)", "    ")
    item_text = F.replace(inline, F.lit("\n"), F.lit("\n    "))

    def item(marker: Column) -> Column:
        head = F.concat(marker, item_text)
        return F.when(kids == "", head).otherwise(F.concat(head, F.lit("\n"), indented))

    checked = F.when(F.coalesce(F.col("checked"), F.lit(False)), F.lit("- [x] ")).otherwise(F.lit("- [ ] "))
    toggle = F.when(wide_trim(inline) == "", F.lit("")).otherwise(
        F.concat(F.lit("**"), wide_trim(inline), F.lit("**"))
    )
    icon = F.coalesce(F.concat(F.col("icon"), F.lit(" ")), F.lit(""))
    code = F.coalesce("_code", F.lit(""))
    fence = richtext.fence_for(code, 3)
    raw_lang = F.lower(wide_trim(F.coalesce("language", F.lit(""))))
    lang = F.when(raw_lang == "plain text", F.lit("")).otherwise(F.regexp_replace(raw_lang, "[^a-z0-9_+#.-]", ""))
    code_caption = F.when(F.coalesce("title", F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("\n\n*"), escape(F.col("title")), F.lit("*"))
    )
    caption = F.when(wide_trim(inline) == "", F.lit("")).otherwise(
        F.concat(F.lit("\n\n*"), wide_trim(inline), F.lit("*"))
    )
    image = F.when(F.col("file_kind") == "image", F.lit("!")).otherwise(F.lit(""))
    word = F.when(F.col("file_kind") == "image", F.lit("Image")).otherwise(F.lit("File"))
    media = (
        F.when(F.col("hosting") == "internal", note(word, F.lit(' not migrated: "'), name, F.lit('" (hosted by the source)')))
        .when(url.isNull(), note(F.lit('File not migrated: "'), name, F.lit('" (URL unavailable)')))
        .when(~link_ok, note(F.lit('File not migrated: "'), name, F.lit('" (URL not allowed)')))
        .otherwise(F.concat(image, linked(name), caption))
    )
    label = F.when(title == "", url).otherwise(title)
    embed = F.when(link_ok, F.concat(linked(label), caption)).otherwise(
        note(F.lit("Unsupported block: "), F.col("source_type"))
    )

    def page(default: str) -> Column:
        shown = F.when(title == "", F.lit(default)).otherwise(title)
        return F.when(link_ok, linked(shown)).otherwise(escape(shown))

    child = F.lit("") if policy.child_pages == "omit" else page("Untitled")
    synced = F.when(F.col("reason").isNotNull(), note(F.lit("Synced block content not accessible"))).otherwise(kids)
    text = (
        F.when(kind == "paragraph", _join(inline, kids))
        .when(kind == "heading", _join(heading, kids))
        .when(kind == "bulletedListItem", item(F.lit("- ")))
        .when(kind == "numberedListItem", item(F.concat(F.col("_ordinal").cast("string"), F.lit(". "))))
        .when(kind == "toDo", item(checked if policy.task_lists else F.lit("- ")))
        .when(kind == "toggle", _join(toggle, kids))
        .when(kind == "quote", _quote(_join(inline, kids)))
        .when(kind == "callout", _quote(_join(wide_trim(F.concat(icon, inline)), kids)))
        .when(kind == "code", F.concat(fence, lang, F.lit("\n"), code, F.lit("\n"), fence, code_caption))
        .when(kind == "divider", F.lit("---"))
        .when(kind == "table", _table(policy))
        .when(kind.isin("image", "file"), media)
        .when(kind.isin("bookmark", "embed"), embed)
        .when(kind == "equation", F.concat(F.lit("```latex\n"), F.coalesce("expression", F.lit("")), F.lit("\n```")))
        .when(kind == "childPage", child)
        .when(kind == "childDatabase", note(F.lit('Inline database "'), F.coalesce("title", F.lit("Untitled")), F.lit('" not migrated')))
        .when(kind == "linkToPage", page("Linked page"))
        .when(kind.isin("columnList", "column"), kids)
        .when(kind == "syncedBlock", synced)
        .when(kind.isin("tableOfContents", "breadcrumb", "tableRow"), F.lit(""))
        .otherwise(note(F.lit("Unsupported block: "), F.col("source_type")))
    )
    return F.coalesce(text, F.lit(""))


def _siblings(parts: Column) -> Column:
    """Join sibling texts in order: items of one list stay tight, all else is set apart."""
    shown = F.filter(parts, lambda p: p["text"] != "")

    def piece(part: Column, i: Column) -> Column:
        before = F.get(shown, i - 1)
        tight = part["kind"].isin(*LIST_KINDS) & (part["kind"] == before["kind"])
        sep = F.when(i == 0, F.lit("")).when(F.coalesce(tight, F.lit(False)), F.lit("\n")).otherwise(F.lit("\n\n"))
        return F.concat(sep, part["text"])

    return F.array_join(F.transform(shown, piece), "")


PARTS = "array<struct<pos:int,kind:string,text:string,cells:array<string>>>"


def render_documents(
    blocks: DataFrame, policy: Policy = Policy()
) -> DataFrame:
    """Page to Markdown: one row per document.

    Works from the deepest level up: each level is written with column expressions and gathered to
    its parents. The prepared blocks are first written to the shared folder by depth, so each level
    reads only its own rows and no plan grows with the depth. Rendering leaves no block out: limits
    belong to reading (``depth_limit``, ``block_budget``), where what they leave out is named.
    """
    spark = blocks.sparkSession
    place = Window.partitionBy("doc", "parent_id").orderBy("pos")
    same = Window.partitionBy("doc", "parent_id", F.col("kind") == "numberedListItem").orderBy("pos")
    run = F.row_number().over(place) - F.row_number().over(same)
    numbered = Window.partitionBy("doc", "parent_id", F.col("kind") == "numberedListItem", "_run").orderBy("pos")
    prepared = (
        blocks.withColumn("_run", run).withColumn("_ordinal", F.row_number().over(numbered))
        .withColumn("_inline", richtext.spans_markdown(F.col("spans")))
        .withColumn("_code", F.when(F.col("kind") == "code", richtext.plain_text(F.col("spans"))))
        .drop("spans", "path", "_run")
    )
    home = shared_folder(spark, "blocks")
    prepared.write.partitionBy("depth").parquet(home)
    base = spark.read.parquet(home)
    deepest = base.agg(F.max("depth")).first()[0] or 0
    empty = F.array().cast(PARTS)
    text = _block_text(policy)
    below: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        level = base.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("child_parts", empty)
        else:
            level = level.join(below, ["doc", "block_id"], "left").withColumn(
                "child_parts", F.coalesce("child_parts", empty)
            )
        texts = level.withColumn("children_md", _siblings(F.col("child_parts"))).select(
            "doc", "parent_id", F.struct("pos", "kind", text.alias("text"), "cells").alias("_part")
        )
        gathered = F.array_sort(F.collect_list("_part")).cast(PARTS).alias("child_parts")
        if depth > 0:
            below = texts.groupBy("doc", F.col("parent_id").alias("block_id")).agg(gathered)
    pages = texts.groupBy("doc").agg(gathered)
    return pages.select("doc", wide_trim(_siblings(F.col("child_parts"))).alias("markdown"))
