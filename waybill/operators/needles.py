"""Any number of given texts looked for in one pass: an Aho-Corasick automaton over a table of needles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from waybill.operators.quality import long_strings, string_columns

# Letters of needles in one automaton, which takes some 100 bytes for each.
BLOCK_LETTERS = 1_000_000


def within_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


@dataclass
class Needles:
    """(needle, what, whole word); the automaton is built where it is first used, not shipped."""

    rows: list[tuple[str, str, bool]]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        by_needle: dict[str, list[tuple[str, bool]]] = {}
        for needle, what, word in self.rows:
            by_needle.setdefault(needle, []).append((what, word))
        made = ahocorasick.Automaton()
        for needle, meant in by_needle.items():
            made.add_word(needle, (len(needle), meant))
        made.make_automaton()
        return made

    def found(self, text: str) -> set[str]:
        """What the needles in a text stand for."""
        out: set[str] = set()
        for last, (length, meant) in self.automaton.iter(text):
            for what, word in meant:
                if what not in out and not (word and (within_word(text, last - length) or within_word(text, last + 1))):
                    out.add(what)
        return out


def _blocks(needles: DataFrame, letters: int) -> Iterator[Needles]:
    rows: list[tuple[str, str, bool]] = []
    held = 0
    for r in needles.toLocalIterator():
        if rows and held + len(r.needle) > letters:
            yield Needles(rows)
            rows, held = [], 0
        rows.append((r.needle, r.what, r.word))
        held += len(r.needle)
    if rows:
        yield Needles(rows)


def needle_scan(df: DataFrame, keys: list[str], needles: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Which given texts stand in which string column: distinct (keys, path, leak).

    ``needles``: needle, what it is (``what``, null as empty), and ``word``, true if no ASCII letter or digit may
    stand next to it (null as false). Null and empty needles are left out; a null text holds none. Each text is read
    once per block of needles, whatever their number in it: a table of up to ``block_letters`` letters is one block,
    a larger one is searched for in several passes with the same result. Only hits are shuffled.
    """
    columns = [c for c in string_columns(df) if c not in keys]
    schema = StructType([*(df.schema[k] for k in keys), StructField("path", StringType()), StructField("leak", StringType())])
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], schema)
    texts = long_strings(df, keys, columns)
    wanted = needles.where(F.length("needle") > 0).select(
        "needle", F.coalesce("what", F.lit("")).alias("what"), F.coalesce("word", F.lit(False)).alias("word")
    )
    hits = spark.createDataFrame([], schema)
    for block in _blocks(wanted.distinct(), block_letters):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, leaks = [], []
                for k, text in enumerate(batch.column(batch.num_columns - 1)):
                    for what in sorted(shared.value.found(text.as_py() or "")):
                        rows.append(k)
                        leaks.append(what)
                at = pa.array(rows, pa.int64())
                kept = [pc.take(c, at) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(leaks, pa.string())], names=schema.names)

        hits = hits.unionByName(texts.mapInArrow(scan, schema))
    return hits.distinct()
