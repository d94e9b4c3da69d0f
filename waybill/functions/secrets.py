"""Scrubbing of credentials from text and from key-value data."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from waybill.session import materialize

MASK = "[REDACTED]"
# Address parameters that carry a credential.
SENSITIVE_PARAMETERS = (
    "X-Amz-Signature|X-Amz-Credential|X-Amz-Security-Token|X-Amz-Algorithm|Signature|sig|token|"
    "access_token|refresh_token|api_key|apikey|key|secret|password"
)
# Token shapes and what each becomes.
SCRUB_RULES = [
    (r"\bntn_[A-Za-z0-9]{16,}\b", MASK),
    (r"\bsecret_[A-Za-z0-9]{16,}\b", MASK),
    (r"\bpk_\d+_[A-Za-z0-9]{12,}\b", MASK),
    (r"(?i)\b(Bearer)\s+[A-Za-z0-9._~+/=-]{8,}", f"$1 {MASK}"),
    (r"""(?i)(authorization["']?\s*[:=]\s*["']?)[^"'\s,}]+""", f"$1{MASK}"),
    (rf"""(?i)([?&](?:{SENSITIVE_PARAMETERS})=)[^&\s"'<>]+""", f"$1{MASK}"),
    (r"(?i)(https?://)[^/\s:@]+:[^/\s@]+@", f"$1{MASK}@"),
]
# Names of members whose value is a secret, and parts of names that look like one.
SENSITIVE_KEY = (
    r"(?i)^(authorization|token|access_?token|refresh_?token|api_?key|secret|password|cookie|"
    r"signature)$"
)
CREDENTIAL_KEY = r"(?i)(^|[_-])(token|secret|password|apikey|api_key|authorization|bearer)([_-]|$)"
# Further shapes looked for when data is about to be published.
LEAK_RULES = {
    "JSON web token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "bearer credential": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "API key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "Authorization header": r"(?i)\bAuthorization\s*:",
    "integration token": r"\b(?:ntn|secret)_[A-Za-z0-9]{16,}\b",
    "personal token": r"\bpk_\d+_[A-Za-z0-9]{12,}\b",
}
# Shapes that name a place on a machine.
MACHINE_PATHS = {
    "an absolute /Users path": r"/Users/",
    "an absolute /home path": r"/home/",
    "an absolute /private path": r"/private/",
    "an absolute /var/folders path": r"/var/folders",
    "an absolute /tmp path": r"(?:^|[^A-Za-z0-9])/tmp/",
    "an absolute /root path": r"(?:^|[^A-Za-z0-9])/root(?:/|$)",
    "a Windows drive path": r"\b[A-Za-z]:[\\/]",
    "a Windows UNC path": r"\\\\[A-Za-z0-9.$_-]+\\",
    "a file: URL": r"(?i)\bfile://",
    "a home-relative path": r"(?:^|\s)~/",
}

# Texts without any of these hold no match of the pattern. Most texts hold none, and a plain search is cheap.
SIGNS = {
    LEAK_RULES["JSON web token"]: ["eyJ"],
    LEAK_RULES["API key"]: ["sk-"],
    LEAK_RULES["integration token"]: ["ntn_", "secret_"],
    LEAK_RULES["personal token"]: ["pk_"],
    MACHINE_PATHS["an absolute /Users path"]: ["/Users/"],
    MACHINE_PATHS["an absolute /home path"]: ["/home/"],
    MACHINE_PATHS["an absolute /private path"]: ["/private/"],
    MACHINE_PATHS["an absolute /var/folders path"]: ["/var/folders"],
    MACHINE_PATHS["an absolute /tmp path"]: ["/tmp/"],
    MACHINE_PATHS["an absolute /root path"]: ["/root"],
    MACHINE_PATHS["a Windows drive path"]: [":/", ":\\"],
    MACHINE_PATHS["a Windows UNC path"]: ["\\\\"],
    MACHINE_PATHS["a file: URL"]: ["://"],
    MACHINE_PATHS["a home-relative path"]: ["~/"],
}


def holds(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere; texts without its signs are not searched for it."""
    test = text.rlike(pattern)
    signs = [F.contains(text, F.lit(sign)) for sign in SIGNS.get(pattern, [])]
    return reduce(lambda a, b: a | b, signs) & test if signs else test


def scrub(text: Column, exact: list[str] | None = None) -> Column:
    """Replace registered secrets (8 characters or more) and every known token shape."""
    out = text
    for secret in exact or []:
        if len(secret) >= 8:
            out = F.replace(out, F.lit(secret), F.lit(MASK))
    for pattern, replacement in SCRUB_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def sensitive_key(key: Column) -> Column:
    return key.rlike(SENSITIVE_KEY)


def scrub_map(values: Column) -> Column:
    """A string map with values under sensitive keys blanked and all others scrubbed."""
    return F.transform_values(
        values, lambda k, v: F.when(sensitive_key(k), F.lit(MASK)).otherwise(scrub(v))
    )


def credential_keys(values: Column) -> Column:
    """Keys of a flat map that look like credentials."""
    return F.filter(F.map_keys(values), lambda k: k.rlike(CREDENTIAL_KEY))


def credential_paths(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Paths of keys that look like credentials anywhere in a JSON document, e.g. `a.b[0].token`.

    The members of one level are laid out per round, and the next round reads only those that hold members themselves,
    so the source is read once and there are as many rounds as the deepest document has levels.
    """
    tvf = df.sparkSession.tvf
    holds = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")
    level = df.select(*keys, F.try_parse_json(column).alias("_v"), F.lit("").alias("_path")).where(holds)
    found: list[DataFrame] = []
    while True:
        members = level.lateralJoin(tvf.variant_explode(F.col("_v").outer()))
        named = F.when(F.col("_path") == "", F.col("key")).otherwise(F.concat_ws(".", "_path", "key"))
        here = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos"), F.lit("]"))).otherwise(named)
        members = members.select(*keys, F.col("value").alias("_v"), here.alias("_path"), F.col("key").alias("_key"))
        members = materialize(members.where(F.col("_key").rlike(CREDENTIAL_KEY) | holds))
        found.append(members.where(F.col("_key").rlike(CREDENTIAL_KEY)).select(*keys, F.col("_path").alias("path")))
        level = members.where(holds)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


# A string of serialized JSON, and the colon that makes it a member's name.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"(:?)')
_RULES = [(re.compile(p), r.replace("$1", r"\1")) for p, r in SCRUB_RULES]
_SENSITIVE = re.compile(SENSITIVE_KEY)


def _blanked(members: list[tuple[str, object]]) -> dict[str, object]:
    """The members of one object, which the parser calls from the innermost object outwards."""
    return {name: MASK if _SENSITIVE.match(name) else value for name, value in members}


def _scrubbed(found: re.Match) -> str:
    if found[1]:
        return found[0]
    text = json.loads(found[0])
    clean = text
    for pattern, replacement in _RULES:
        clean = pattern.sub(replacement, clean)
    return found[0] if clean == text else json.dumps(clean, ensure_ascii=False)


def _scrubbed_document(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        kept = json.loads(text, object_pairs_hook=_blanked)
        plain = json.dumps(kept, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return MASK
    return _STRING.sub(_scrubbed, plain)


@F.pandas_udf(StringType())
def scrub_json(documents: pd.Series) -> pd.Series:
    """Nested JSON text with every string scrubbed and values under sensitive keys blanked, at any depth.

    Objects are blanked while they are parsed; strings are scrubbed in the serialized text, from end to end. Spark has
    no expression that rewrites nested values of unknown depth, so this runs in Arrow batches; flat maps use
    ``scrub_map``. Text that is not JSON, or too deeply nested for the parser, is blanked as a whole.
    """
    return documents.map(_scrubbed_document)
