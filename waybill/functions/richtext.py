"""Styled text runs and their Markdown, as array expressions over span structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions import urls
from waybill.functions.text import wide_trim
from waybill.schemas import SPAN

STYLE = ["bold", "italic", "strikethrough", "underline", "code"]
RAW_SPANS = (
    "array<struct<type:string,plain_text:string,href:string,"
    "text:struct<link:struct<url:string>>,"
    "annotations:struct<bold:boolean,italic:boolean,strikethrough:boolean,underline:boolean,"
    "code:boolean,color:string>,"
    "mention:struct<type:string,user:struct<id:string>,page:struct<id:string>,"
    "link_preview:struct<url:string>>,"
    "equation:struct<expression:string>>>"
)


def plain_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def normalize_spans(raw_json: Column, page_url_prefix: str, key_prefix: str) -> Column:
    """Raw rich-text JSON to spans that keep every annotation, so loss can be reported later."""
    items = F.from_json(raw_json, RAW_SPANS)

    def strip(identifier: Column) -> Column:
        return F.lower(F.replace(identifier, F.lit("-"), F.lit("")))

    def span(item: Column) -> Column:
        notes, mention = item["annotations"], item["mention"]
        is_mention = (item["type"] == "mention") & mention.isNotNull()
        page, user = mention["page"]["id"], mention["user"]["id"]
        mention_kind = F.when(
            is_mention,
            F.when((mention["type"] == "user") & user.isNotNull(), F.lit("user"))
            .when((mention["type"] == "page") & page.isNotNull(), F.lit("page"))
            .when(mention["type"] == "database", F.lit("database"))
            .when(mention["type"] == "date", F.lit("date"))
            .when(mention["type"] == "link_preview", F.lit("link_preview"))
            .when(mention["type"] == "template_mention", F.lit("template"))
            .otherwise(F.lit("other")),
        )
        target = F.when(
            mention_kind == "user", F.concat(F.lit(f"{key_prefix}:user:"), strip(user))
        ).when(mention_kind == "page", F.concat(F.lit(f"{key_prefix}:page:"), strip(page)))
        link = F.coalesce(item["href"], item["text"]["link"]["url"])
        plain_link = F.when(link.rlike("(?i)^mailto:"), link).otherwise(urls.external_url(link))
        href = F.coalesce(
            F.when(
                mention_kind == "page",
                F.coalesce(
                    urls.external_url(item["href"]), F.concat(F.lit(page_url_prefix), strip(page))
                ),
            ),
            F.when(
                mention_kind == "link_preview", urls.external_url(mention["link_preview"]["url"])
            ),
            plain_link,
        )
        flags = [F.coalesce(notes[s], F.lit(False)).alias(s) for s in STYLE]
        return F.struct(
            F.coalesce(item["plain_text"], F.lit("")).alias("text"),
            *flags,
            F.when(notes["color"] != "default", notes["color"]).alias("color"),
            href.alias("href"),
            mention_kind.alias("mention_kind"),
            target.alias("mention_target"),
            F.when(item["type"] == "equation", item["equation"]["expression"]).alias("equation"),
        )

    return F.transform(items, span)


def _same_style(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for name in STYLE:
        same = same & (F.coalesce(a[name], F.lit(False)) == F.coalesce(b[name], F.lit(False)))
    same = same & a["href"].eqNullSafe(b["href"]) & a["color"].eqNullSafe(b["color"])
    for name in ("equation", "mention_kind"):
        same = same & a[name].isNull() & b[name].isNull()
    return same


def merge_spans(spans: Column) -> Column:
    """Join neighbouring runs of equal style."""

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & F.coalesce(_same_style(last, span), F.lit(False))
        longer = last.withField("text", F.concat(last["text"], span["text"]))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    empty = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(spans, empty, step)


def escape_markdown(text: Column) -> Column:
    signs = F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")
    heads = F.regexp_replace(signs, r"(?m)^(\s*)(#{1,6})(\s)", r"$1\\$2$3")
    bullets = F.regexp_replace(heads, r"(?m)^(\s*)([-+])(\s)", r"$1\\$2$3")
    return F.regexp_replace(bullets, r"(?m)^(\s*)(\d+)([.)])(\s)", r"$1$2\\$3$4")


def fence_for(text: Column, least: int) -> Column:
    """A run of back-ticks longer than any inside the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(least)))


def inline_code(text: Column) -> Column:
    fence = fence_for(text, 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, text, pad, fence)


def span_markdown(span: Column, in_table: bool = False) -> Column:
    text = span["text"]
    if in_table:
        text = F.regexp_replace(text, r"\r?\n", " ")
    lead = F.regexp_extract(text, r"^(\s*)", 1)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    trail = F.regexp_extract(rest, r"(\s*)$", 1)
    core = F.substring(rest, F.lit(1), F.length(rest) - F.length(trail))
    wrapped = escape_markdown(core)
    for flag, sign in (("bold", "**"), ("italic", "*"), ("strikethrough", "~~")):
        marked = F.concat(F.lit(sign), wrapped, F.lit(sign))
        wrapped = F.when(F.coalesce(span[flag], F.lit(False)) & (core != ""), marked).otherwise(
            wrapped
        )
    body = F.when(F.coalesce(span["code"], F.lit(False)), inline_code(text)).otherwise(
        F.concat(lead, wrapped, trail)
    )
    body = F.regexp_replace(body, r"\r?\n", "  \n")
    if in_table:
        body = F.replace(body, F.lit("|"), F.lit("\\|"))
    linked = F.concat(
        F.lit("["), wide_trim(body), F.lit("]("), urls.link_target(span["href"]), F.lit(")")
    )
    has_link = urls.allowed_link(span["href"]) & (wide_trim(body) != "")
    return F.when(span["equation"].isNotNull(), inline_code(span["equation"])).otherwise(
        F.when(has_link, linked).otherwise(body)
    )


def spans_markdown(spans: Column, in_table: bool = False) -> Column:
    parts = F.transform(merge_spans(spans), lambda s: span_markdown(s, in_table))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def text_span(text: Column) -> Column:
    """One unstyled span."""
    off = [F.lit(False).alias(s) for s in STYLE]
    none = F.lit(None).cast("string")
    rest = [none.alias(n) for n in ("color", "href", "mention_kind", "mention_target", "equation")]
    return F.struct(text.alias("text"), *off, *rest)


# Span-level findings: code -> (outcome, category, test).
def span_codes(span: Column, supports_underline: bool, supports_color: bool) -> Column:
    """Codes of what one (merged) span loses."""
    formula = span["equation"].isNotNull()
    return F.array_compact(
        F.array(
            F.when(formula, F.lit("INLINE_EQUATION_AS_CODE")),
            F.when(
                ~formula & F.coalesce(span["underline"], F.lit(False))
                & F.lit(not supports_underline),
                F.lit("FORMAT_UNDERLINE_DROPPED"),
            ),
            F.when(
                ~formula & span["color"].isNotNull() & F.lit(not supports_color),
                F.lit("FORMAT_COLOR_DROPPED"),
            ),
            F.when(~formula & (span["mention_kind"] == "user"), F.lit("MENTION_USER_AS_TEXT")),
        )
    )
