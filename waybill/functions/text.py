"""Text functions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as a browser's `trim` sees it.
WIDE_SPACE = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# The same signs one by one.
WIDE_SIGNS = "\t\n\x0B\f\r \xA0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
NON_ASCII = r"[^\x00-\x7F]"


# Static methods of the Unicode library that Spark itself ships for its collations.
UNICODE_LIBRARY = "com.ibm.icu.text.Normalizer"
NORMAL_FORMS = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFKD": ("decompose", True)}


def normal_form(text: Column, form: str) -> Column:
    """Unicode normal form on the JVM; ASCII text, which has only one form, is passed through."""
    method, compatible = NORMAL_FORMS[form]
    changed = F.java_method(F.lit(UNICODE_LIBRARY), F.lit(method), text, F.lit(compatible))
    return F.when(text.rlike(NON_ASCII), changed).otherwise(text)


def wide_trim(text: Column) -> Column:
    """Read from both ends: a pattern would try every run of white space in the text, and each long run again and again."""
    return F.btrim(text, F.lit(WIDE_SIGNS))


def canon(text: Column, normalize: bool = True) -> Column:
    """Comparison key: compatibility form, lower case, each run of other signs one space."""
    base = normal_form(text, "NFKC") if normalize else text
    return F.trim(F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}]+", " "))


def clean_name(title: Column) -> Column:
    """One-line name, `Untitled` when nothing is left."""
    # A run of white space is one space; single spaces, the most frequent runs, are no match.
    one_line = F.regexp_replace(title, r"[\r\n\t\x0B\f][ \r\n\t\x0B\f]*+| [ \r\n\t\x0B\f]++", " ")
    return F.regexp_replace(wide_trim(one_line), r"\A\z", "Untitled")


def name_changed(title: Column) -> Column:
    return clean_name(title) != wide_trim(title)


def slug(title: Column, normalize: bool = True) -> Column:
    base = normal_form(F.lower(title), "NFKD") if normalize else F.lower(title)
    dashed = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.substring(dashed, 1, 40)
    return F.when(short == "", F.lit("untitled")).otherwise(short)


def normalize_markdown(text: Column, normalize: bool = True) -> Column:
    """White-space-insensitive form for comparing planned and actual text."""
    lf = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    stripped = F.regexp_replace(lf, r"[ \t]+(?=\n|\z)", "")
    squeezed = F.regexp_replace(stripped, r"\n{3,}", "\n\n")
    composed = normal_form(squeezed, "NFC") if normalize else squeezed
    return wide_trim(composed)


def clip(text: Column, size: int) -> Column:
    """At most ``size`` characters, with an ellipsis when something was cut."""
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))
    ).otherwise(text)


def cut(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def query_terms(query: str) -> list[str]:
    return [term for term in query.lower().split() if term]


def matches_terms(haystack: Column, query: str) -> Column:
    """Every term of the query occurs somewhere; an empty query matches everything."""
    text = F.lower(haystack)
    found = F.lit(True)
    for term in query_terms(query):
        found = found & F.contains(text, F.lit(term))
    return found


def replacements(text: Column, needle: str, replacement: str) -> tuple[Column, Column]:
    """The text with ``needle`` replaced everywhere, and how many there were."""
    replaced = F.replace(text, F.lit(needle), F.lit(replacement))
    without = F.replace(text, F.lit(needle), F.lit(""))
    count = (F.length(text) - F.length(without)) / F.lit(len(needle))
    return replaced, count.cast("bigint")


def with_first_difference(df: DataFrame, expected: Column, actual: Column, out: str) -> DataFrame:
    """Add where two texts first differ by line, and the next non-blank line of each from there.

    The position is a column of its own, so the lines after it are cut off once instead of being
    searched from the start.
    """
    lines = df.withColumns({"_left": F.split(expected, "\n"), "_right": F.split(actual, "\n")})
    # A line that differs; none when the expected text is a line-wise prefix of the actual one.
    differs = F.transform("_left", lambda line, i: ~line.eqNullSafe(F.get("_right", i)))
    hit = lines.withColumn("_hit", F.array_position(differs, F.lit(True)))
    shorter = F.least(F.size("_left"), F.size("_right")).cast("bigint")
    at = hit.withColumn("_at", F.when(F.col("_hit") > 0, F.col("_hit") - 1).otherwise(shorter).cast("int"))

    def next_line(side: str) -> Column:
        rest = F.slice(side, F.col("_at") + 1, F.greatest(F.size(side) - F.col("_at"), F.lit(0)))
        shown = F.filter(rest, lambda line: wide_trim(line) != "")
        return F.coalesce(F.get(shown, F.lit(0)), F.lit("(end of text)"))

    found = F.struct(
        (F.col("_at") + 1).cast("bigint").alias("line"),
        next_line("_left").alias("expected"),
        next_line("_right").alias("actual"),
    )
    return at.withColumn(out, found).drop("_left", "_right", "_hit", "_at")


def number_text(number: Column) -> Column:
    """A double the way the source system prints it: no trailing `.0`, plain notation in the
    usual range, `e` notation outside it."""
    size = F.abs(number)
    plain = F.regexp_replace(
        F.regexp_replace(number.cast("string").cast("decimal(38,10)").cast("string"), r"0+$", ""),
        r"\.$",
        "",
    )
    whole = number.try_cast("decimal(38,0)").cast("string")
    powered = F.regexp_replace(
        F.regexp_replace(F.replace(number.cast("string"), F.lit("E"), F.lit("e")), r"\.0e", "e"),
        r"e(\d)",
        "e+$1",
    )
    return (
        F.when((number == F.floor(number)) & (size < 1e21), whole)
        .when((size >= 1e-3) & (size < 1e7), number.cast("string"))
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(powered)
    )
