"""Address checks and the strict link allow-list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import WIDE_SIGNS, wide_trim

# Code points that browsers strip or reinterpret inside an address, or that hide intent.
FORBIDDEN = (
    r"[\x{0}-\x{20}\x{7f}-\x{a0}\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}"
    r"\x{205f}-\x{206f}\x{3000}\x{feff}\x{fff9}-\x{fffb}]"
)


# http(s) address with a host and without credentials, as a browser's address parser accepts it.
WEB_URL = (
    r"(?is)^[\x00-\x20]*https?://(?:\[[0-9a-f:.]+\]|[^/?#@\\\s<>\[\]^|%:]+)(?::\d{1,5})?"
    r"(?:[/?#].*)?$"
)


def valid_email(value: Column) -> Column:
    return value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(value) <= 254)


def valid_phone(value: Column) -> Column:
    """A country code is required."""
    return wide_trim(value).rlike(r"^\+\d[\d\s().-]{5,}$")


def valid_url(value: Column) -> Column:
    return F.coalesce(value.rlike(WEB_URL), F.lit(False))


def normalized(url: Column) -> Column:
    """Address in written form: lower-case scheme and host, a path, no default port, no raw blanks."""
    head = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)), r"^(http:.*):80$|^(https:.*):443$", "$1$2")
    rest = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/?#]*", ""), r"^(?=[?#]|$)", "/")
    blanks = F.replace(F.replace(F.replace(rest, F.lit(" "), F.lit("%20")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.concat(head, F.replace(blanks, F.lit('"'), F.lit("%22")))


def external_url(value: Column, limit: int = 2000) -> Column:
    """A plain http(s) address without credentials in written form, or null."""
    trimmed = wide_trim(value)
    return F.when(valid_url(trimmed) & (F.length(trimmed) <= limit), normalized(trimmed))


def allowed_link(url: Column) -> Column:
    # Only the beginning is looked at, so white space at the end is left where it is.
    return F.coalesce(F.ltrim(url, F.lit(WIDE_SIGNS)).rlike(r"(?i)^(https?://|mailto:)"), F.lit(False))


def safe_url(value: Column, limit: int = 2048) -> Column:
    """The address when it may become a clickable link, else null. Nothing is repaired."""
    plain = (
        (F.length(value) > 0)
        & (F.length(value) <= limit)
        & ~value.rlike(FORBIDDEN)
        & ~F.contains(value, F.lit("\\"))
    )
    mail = value.rlike(r"(?i)^mailto:[^?#]*@")
    return F.when(plain & valid_url(value), normalized(value)).when(plain & mail, value)


def link_target(url: Column) -> Column:
    """Address written inside a Markdown link."""
    spaces = F.replace(url, F.lit(" "), F.lit("%20"))
    return F.replace(F.replace(spaces, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
