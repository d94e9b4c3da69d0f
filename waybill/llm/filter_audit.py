"""How filters on documents interact: what each of them removes, in every order in which they could be applied.

The filters are five: A, under 200 words; B, fewer than half of the words are distinct; C, more than 2 percent of the code
points are capitals A-Z; D, any of ``#$%&*|``; E, the same text as a document with a smaller id. Which of them a document
fails does not depend on their order, so documents are reduced to counts by mask of failures before orders are applied.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored
from waybill.llm.text_trie import RadixTrie, routed

LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")

# Bytes of text that one trie holds in a task, and bytes below a prefix that texts are dealt by.
TRIE_BYTES = 16 << 20
ROUTE_BYTES = 4 << 20

SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """The bits of A to D for a UTF-8 text."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    failed = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * points,
        SIGNS.search(text) is not None,
    )
    return sum(1 << k for k, bad in enumerate(failed) if bad)


class Terminal:
    """The rows of one text: the smallest id so far, and how many rows of each part have it."""

    __slots__ = ("mask", "parts", "smallest", "text")

    def __init__(self, text: bytes, mask: int, smallest) -> None:
        self.text, self.mask, self.smallest = text, mask, smallest
        self.parts: dict[str, int] = {}


class Originals:
    """Texts in a trie; rows that some smaller id makes duplicates leave at once, the others when they are asked for."""

    def __init__(self) -> None:
        self.trie, self.bytes, self.settled = RadixTrie(), 0, []

    def add(self, key, part: str, n: int, text: bytes, mask: int | None = None) -> None:
        node = self.trie.insert(text)
        found = node.payload
        if found is None:
            found = node.payload = Terminal(text, own_failures(text) if mask is None else mask, key)
            self.bytes += len(text) + 256
        if key > found.smallest:
            self.settled.append((key, part, found.mask | DUPLICATE, n, None))
            return
        if key < found.smallest:
            self.settled += [(found.smallest, p, found.mask | DUPLICATE, m, None) for p, m in found.parts.items()]
            found.smallest, found.parts = key, {}
        found.parts[part] = found.parts.get(part, 0) + n

    def take_settled(self) -> list[tuple]:
        rows, self.settled = self.settled, []
        return rows

    def take_smallest(self) -> Iterator[tuple]:
        """Rows of the smallest id of each text, one per part, with the text; the trie is empty then."""
        for t in self.trie.terminals():
            for part, n in t.parts.items():
                yield t.smallest, part, t.mask, n, t.text
        self.trie, self.bytes = RadixTrie(), 0


SCHEMA = "doc_id {key}, part string, mask int, n long, text binary"


def _writer(kind: pa.DataType) -> Callable[[list[tuple]], pa.RecordBatch]:
    schema = pa.schema([("doc_id", kind), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])
    return lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema
    )


def _pieces(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) as rows by ``SCHEMA``: settled ones have no text, the others are one per text, trie and part."""
    write, held = None, Originals()
    for batch in batches:
        write = write or _writer(batch.schema.field(0).type)
        for key, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None:  # no id is smaller than a null one, and a null one is smaller than none
                held.settled.append((None, part, own_failures(text), 1, None))
                continue
            held.add(key, part, 1, text)
            if held.bytes >= TRIE_BYTES:
                for rows in _pieces(held.take_smallest()):
                    yield write(rows)
        for rows in _pieces(held.take_settled()):
            yield write(rows)
    if write:
        for rows in _pieces(held.take_smallest()):
            yield write(rows)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by ``SCHEMA`` with ``route``, sorted by it, all of a route in one task: which of them are duplicates.

    A full trie is emptied where the route changes, as no later text can equal one in it.
    """
    write, held, route = None, Originals(), None
    for batch in batches:
        write = write or _writer(batch.schema.field(0).type)
        out = []
        for key, part, mask, n, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != route and held.bytes >= TRIE_BYTES:
                out += [(*row[:4], None) for row in held.take_smallest()]
            route = at
            held.add(key, part, n, text, mask)
        yield write(out + held.take_settled())
    if write:
        yield write([(*row[:4], None) for row in held.take_smallest()])


def failures(docs: DataFrame, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """Counts of rows by doc_id, part and mask: bit k of ``mask`` is set if a row fails filter ``LETTERS[k]``.

    Copies are found in two levels of compressed tries. Every task inserts its own whole texts; a row whose id is not
    the smallest for its text is settled there. What is left, one row per text and trie, is dealt by text prefixes that
    grow where texts are many, and inserted once more; the smallest id stays at the end of each text. So a text that
    holds a third of all rows is shuffled once per trie, not once per row.

    A null text is empty; a null ``source`` is the part "". A null doc_id is smaller than none and larger than none:
    such rows are never duplicates. Rows that repeat an id and its text are not duplicates of each other. Other columns
    than doc_id, source and text are not read. An empty table gives no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    first = stored(rows.mapInArrow(collapse, SCHEMA.format(key=key)), "texts")
    open_rows = routed(first.where("text is not null"), route_bytes)
    again = open_rows.select("doc_id", "part", "mask", "n", "text", "route").mapInArrow(resolve, SCHEMA.format(key=key))
    settled = first.where("text is null").unionByName(again)
    return settled.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` has doc_id, quality, toxic; a document is good (toxic) if any of its rows says 1, and neither without
    rows. Orders and steps are applied to at most 32 counts per part, never to documents. A part is hot without harm:
    its rows are counted by mask before anything is gathered. See ``failures`` for nulls, copies and repeated ids.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    counted = failures(docs, route_bytes).join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad"),
    )
    return apply_orders(counted)


def apply_orders(counted: DataFrame) -> DataFrame:
    """Counts by part and mask (n, good, bad) as one row per part, order of the filters and step."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    failed = F.concat(*[F.when(F.col("mask").bitwiseAND(1 << k) != 0, letter).otherwise("") for k, letter in enumerate(LETTERS)])
    rows = counted.withColumn("failed", failed).withColumn("filter_order", F.explode(orders))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    letter = F.expr("substring(filter_order, step, 1)")
    rows = rows.withColumn("letter", letter).withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
    fails = F.expr("contains(failed, letter)")
    gone = F.expr("length(translate(before, failed, '')) < length(before)")
    removed = fails & ~gone

    def total(when, of: str = "n"):
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")

    steps = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("letter")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "bad").alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "letter").agg(total(removed).alias("shapley"))
    return steps.join(shares, ["part", "letter"]).drop("letter")
