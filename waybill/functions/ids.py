"""Identifiers, keys and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import wide_trim

KEY_SHAPE = r"^[a-z][a-z0-9-]*:[a-z_]+:[^\s]+$"
NUL = "\u0000"


def strip_id(identifier: Column) -> Column:
    return F.lower(F.replace(identifier, F.lit("-"), F.lit("")))


def dashed_uuid(identifier: Column) -> Column:
    bare = strip_id(identifier)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4)]
    head = [F.substring(bare, start, size) for start, size in cuts]
    return F.concat_ws("-", *head, F.substring(bare, 21, 1 << 30))


def parse_id(text: Column, hosts: list[str]) -> Column:
    """Id from bare hex, a dashed UUID or a URL on one of ``hosts``; null when it is none of them.

    ``hosts`` are domain names; their subdomains count too.
    """
    trimmed = wide_trim(text)
    domains = "|".join(host.replace(".", r"\.") for host in hosts)
    host = F.try_parse_url(trimmed, F.lit("HOST"))
    path = F.replace(F.try_parse_url(trimmed, F.lit("PATH")), F.lit("-"), F.lit(""))
    in_path = F.lower(F.regexp_extract(path, "(?i)([0-9a-f]{32})", 1))
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return (
        F.when(trimmed.rlike(uuid), strip_id(trimmed))
        .when(trimmed.rlike("(?i)^[0-9a-f]{32}$"), F.lower(trimmed))
        .when(
            trimmed.rlike("(?i)^https?://") & host.rlike(rf"(?i)(^|\.)({domains})$"),
            F.nullif(in_path, F.lit("")),
        )
    )


def entity_key(system: str | Column, kind: str | Column, identifier: Column) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in (system, kind)]
    return F.concat_ws(":", *parts, identifier.cast("string"))


def valid_entity_key(key: Column) -> Column:
    return key.rlike(KEY_SHAPE)


def parse_entity_key(key: Column) -> Column:
    parts = F.split(key, ":", 3)
    return F.struct(
        F.get(parts, F.lit(0)).alias("system"),
        F.get(parts, F.lit(1)).alias("kind"),
        F.get(parts, F.lit(2)).alias("id"),
    )


def user_key(raw: Column) -> Column:
    """Key of a person in a user map: UUID-like ids lose dashes, everything is lower case."""
    low = F.lower(wide_trim(raw))
    return F.when(low.rlike("^[0-9a-f-]{32,36}$"), F.replace(low, F.lit("-"), F.lit(""))).otherwise(
        low
    )


def sha_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix + 12 hex digits of the hash of the parts joined by NUL."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    joined = reduce(lambda a, b: F.concat(a, F.decode(F.unhex(F.lit("00")), "UTF-8"), b), columns)
    return F.concat(F.lit(f"{prefix}_"), F.substring(sha_hex(joined), 1, 12))


def hash_tag(prefix: str, value: Column, salt: str = "") -> Column:
    digest = F.substring(sha_hex(F.concat(F.lit(salt), value)), 1, 8)
    return F.concat(F.lit(f"[{prefix}:"), digest, F.lit("]"))


def hash_id(prefix: str, value: Column, salt: str = "") -> Column:
    digest = F.substring(sha_hex(F.concat(F.lit(salt), value)), 1, 8)
    return F.concat(F.lit(f"{prefix}-"), digest)


def hash_key(key: Column, salt: str = "") -> Column:
    """Keep system and kind, hide which object it was."""
    parts = parse_entity_key(key)
    rest = parts["id"]
    hidden = F.concat_ws(
        ":",
        parts["system"],
        parts["kind"],
        F.substring(sha_hex(F.concat(F.lit(salt), rest)), 1, 12),
    )
    return F.when(rest.isNull(), hash_tag("key", key, salt)).otherwise(hidden)


def unique_id_display(prefix: Column, number: Column) -> Column:
    digits = number.cast("string")
    with_prefix = F.concat(prefix, F.lit("-"), digits)
    return F.when(prefix.isNull() | (prefix == ""), digits).otherwise(with_prefix)


def safe_path_segment(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{1,64}$")


def attachment_key(owner: Column, field: Column, index: Column, name: Column) -> Column:
    """Key of a file that does not depend on its signed address."""
    digest = sha_hex(F.concat_ws("|", owner, field, index.cast("string"), name))
    return F.substring(digest, 1, 24)
