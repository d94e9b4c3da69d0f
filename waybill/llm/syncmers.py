"""Document fingerprints from closed syncmers, in DataFrame functions alone.

The symbols are words: runs without white space, and single characters of scripts that do not set words apart. A run of
``K`` words is chosen when the smallest hash among its inner runs of ``S`` words stands at one of its edges. Whether a
run is chosen depends on its own words only, so texts that share a passage share its anchors, wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

K, S = 4, 2
# Anchors that the short sketch of a fingerprint holds at most: those with the smallest hashes. The rest of a fingerprint,
# and likeness, follow from all anchors.
SKETCH = 128
# Rows of one part of the global order, and the parts at most (their bounds are known to the driver).
PART_ROWS = 500
MAX_PARTS = 65_536

UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _words(text: Column) -> Column:
    apart = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.split(apart, r"\s+")


def _inner(words: Column) -> Column:
    """Hashes of all runs of two words."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < S, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(hashed, 1, n - 1), F.slice(hashed, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    )


def _chosen(inner: Column) -> Column:
    """For each run of four words its hash if it is a closed syncmer, else null."""

    def at(x: Column, k: Column) -> Column:
        middle, last = F.get(inner, k + 1), F.get(inner, k + 2)
        # The run is left out where only its middle is smallest; runs past the end have a null there.
        return F.when(~((middle < x) & (middle < last)), F.hash(x, last))

    return F.transform(inner, at)


def with_anchors(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with array<int> ``name``: the hashes of the text's closed syncmers by position, null elsewhere.

    The element at place p belongs to the words p to p + 3 of the text, so equal anchors of two texts also say by how
    far the passage moved.
    """
    return docs.withColumn("_words", _words(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "_inner", _inner(F.col("_words"))
    ).withColumn(name, _chosen(F.col("_inner"))).drop("_words", "_inner")


def _linked(anchors: Column) -> Column:
    """Each anchor with its distance to the next one and that one's hash; null where there is no anchor.

    Of two runs that follow each other at least one is an anchor, so the next anchor is one or two places on; the last
    one of a text stands alone.
    """

    def at(x: Column, k: Column) -> Column:
        one, two = F.get(anchors, k + 1), F.get(anchors, k + 2)
        after = F.when(one.isNotNull(), F.xxhash64(x, F.lit(1), one)).when(two.isNotNull(), F.xxhash64(x, F.lit(2), two))
        return F.when(x.isNotNull(), after.otherwise(F.xxhash64(x)))

    return F.transform(anchors, at)


def with_links(docs: DataFrame, text: str, name: str, sketch: str | None = None) -> DataFrame:
    """``docs`` with array<bigint> ``name``: the links of all anchors of the text, in order, each anchor with the next.

    Two texts share a link where two successive anchors stand at one offset to each other in both, so a passage that
    both hold gives a run of shared links, wherever it stands, and passages in another order lose those at their seams.
    A text without an anchor (fewer than four words, or no syncmer) has the hash of the whole text as its one link;
    null counts as empty. ``sketch`` names a column for the smallest ``SKETCH`` distinct anchors.
    """
    found = with_anchors(docs, text, "_anchors")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = found.withColumn("_links", F.array_compact(_linked(F.col("_anchors"))))
    if sketch:
        found = found.withColumn("_distinct", F.array_sort(F.array_distinct(F.array_compact("_anchors"))))
        few = F.when(F.size("_distinct") == 0, F.array(F.hash(whole))).otherwise(F.slice("_distinct", 1, SKETCH))
        found = found.withColumn(sketch, few)
    links = F.when(F.size("_links") == 0, F.array(F.xxhash64(whole))).otherwise(F.col("_links"))
    return found.withColumn(name, links).drop("_anchors", "_links", "_distinct")


def as_text(sketch: Column, links: Column) -> Column:
    """A digest of all links in their order (16 hexadecimal digits), then eight digits for each anchor of the sketch."""
    few = F.array_join(F.transform(sketch, lambda x: F.substring(F.lower(F.lpad(F.hex(x.cast("long")), 16, "0")), 9, 8)), "")
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(links)), 16, "0")), few)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of all links of two texts, given as arrays of distinct ones."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _bounds(docs: DataFrame) -> list[int]:
    """Ids that part the table into ranges of about ``PART_ROWS`` rows: the largest id of each range."""
    rows, most = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    if not rows:
        return []
    parts = max(1, min(MAX_PARTS, rows // PART_ROWS))
    shares = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * parts))).first()[0] if shares else []
    return sorted({*found, most})


def in_order(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """``docs`` (doc_id, text) dealt into parts, and the window in which F.lead reads the next row by descending doc_id.

    The first row follows the last. Rows are dealt by ranges of ids, so each part is ordered by itself; the first row of a part is sent to the part
    before it as well, where it follows the last one. Rows with one id follow each other by text. Rows without an id
    come last; if no row has one, nothing follows the last row. Rows with ``_guest`` are to be left out afterwards.
    """
    bounds = _bounds(docs)
    n = len(bounds)
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in range(max(1, n.bit_length()) - 1, -1, -1)])
    search = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= n - 1) & (F.get(edges, low + step - 1) < F.col("doc_id")), low + step
        ).otherwise(low),
    )
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(search) if n else F.lit(0)
    placed = docs.withColumn("_part", part)
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    if n:
        guest = F.struct(F.pmod(F.col("_part") + 1, F.lit(n)).alias("part"), F.lit(True).alias("guest"))
        first = F.get(edges, F.col("_part")) == F.col("doc_id")
        placed = placed.withColumn("_place", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    else:
        placed = placed.withColumn("_place", own)
    placed = placed.select(*docs.columns, F.col("_place.part").alias("_part"), F.col("_place.guest").alias("_guest"))
    return placed.repartition("_part"), Window.partitionBy("_part").orderBy("_guest", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, n_chars, fingerprint, _held (distinct links), and the next document's next_text (null if
    nothing follows).

    Every input row gives one row; only doc_id and text are read. Null texts count as empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed, order = in_order(own)
    made = placed.withColumn("next_text", F.lead("text").over(order)).where("not _guest")
    made = with_links(made, "text", "_own", "_sketch")
    return made.select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), as_text(F.col("_sketch"), F.col("_own")).alias("fingerprint"),
        F.array_distinct("_own").alias("_held"), "next_text",
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id. Both likenesses are of all anchors of both whole texts.
    """
    made = fingerprints(docs)
    half = "cast(floor(n_chars / 2) as int)"
    after = "coalesce(next_text, '')"
    made = made.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring({after}, 1, {half}))"))
    made = with_links(made, "edited", "_edited", "_sketch")
    made = made.select(
        "doc_id", "n_chars", "fingerprint", "_held", "next_text", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sketch"), F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_held"), F.array_distinct("_edited")).alias("near_edited"),
    )
    made = with_links(made, "next_text", "_next").withColumn("_next", F.array_distinct("_next"))
    near = F.when(F.col("next_text").isNotNull(), likeness(F.col("_held"), F.col("_next"))).otherwise(F.lit(0.0))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near.alias("near_next")
    )
