"""Benchmark decontamination: an FM-index per shard of the training text finds every phrase of a benchmark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.fm_index import FMIndex

WINDOW = 10
# A shard takes documents until it holds so many words; an index takes so many of them.
SHARD_WORDS = 1_000_000
INDEX_WORDS = 400_000
# The benchmark is the stated query set and goes to every task; a larger one is refused, not cut.
MAX_BENCHMARK_BYTES = 256_000_000

# Words are runs of digits, letters a-z and everything beyond ASCII; A-Z are lower-cased.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256)
)
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


@dataclass
class Phrases:
    """The windows of all items, by length, as word numbers; ``items[length][row]`` are those that hold a window."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)

    @classmethod
    def of(cls, benchmark: list[tuple[object, bytes | None]], window: int) -> Phrases:
        made = cls()
        held: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in benchmark:
            words = [made.numbers.setdefault(w, len(made.numbers) + 1) for w in words_of(text)]
            if item is None or not words:
                continue
            length = min(window, len(words))
            for k in range(len(words) - length + 1):
                held.setdefault(length, {}).setdefault(tuple(words[k : k + length]), set()).add(str(item))
        for length, found in held.items():
            made.windows[length] = np.array(list(found), np.int64)
            made.items[length] = [tuple(sorted(x)) for x in found.values()]
        return made

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)

    @property
    def longest(self) -> int:
        return max(self.windows, default=0)


def occurrences(symbols: np.ndarray, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, window row, position) of every occurrence in a shard of word numbers.

    A word that no item has is a separator, and so is the end of a document. A stretch between separators that is
    shorter than the shortest window holds none and is left out of the index; a stretch too long for one index
    continues in the next, with an overlap of one word less than the longest window.
    """
    inside = np.r_[0, (symbols != 0).view(np.int8), 0]
    starts = np.flatnonzero(np.diff(inside) == 1)
    ends = np.flatnonzero(np.diff(inside) == -1)
    fits = ends - starts >= phrases.shortest
    parts: list[tuple[int, int]] = []
    held = 0
    for start, end in zip(starts[fits].tolist(), ends[fits].tolist(), strict=True):
        while True:
            stop = min(end, start + INDEX_WORDS)
            parts.append((start, stop))
            held += stop - start + 1
            if held >= INDEX_WORDS:
                yield from _search(symbols, parts, phrases)
                parts, held = [], 0
            if stop == end:
                break
            start = stop - phrases.longest + 1
    if parts:
        yield from _search(symbols, parts, phrases)


def _search(symbols: np.ndarray, parts: list[tuple[int, int]], phrases: Phrases):
    begin = np.array([p[0] for p in parts])
    size = np.array([p[1] - p[0] for p in parts])
    own = np.cumsum(np.r_[0, size[:-1] + 1])  # where each part starts in the index
    offset = np.repeat(begin - own, size + 1)
    text = np.zeros(len(offset), np.int64)
    inside = np.ones(len(offset), bool)
    inside[own + size] = False
    text[inside] = symbols[(np.arange(len(offset)) + offset)[inside]]
    index = FMIndex(text, len(phrases.numbers) + 1)
    for length, windows in phrases.windows.items():
        low, high = index.ranges(windows)
        count = np.maximum(high - low, 0)
        if count.any():
            which = np.repeat(np.arange(len(windows)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            at = index.locate(rows)
            yield length, which, at + offset[at]


@dataclass
class Found:
    """What a document holds: its words, a mark per word, and the items with an occurring window."""

    n_words: int
    hit: np.ndarray
    items: list[str]

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Code point ranges of text to remove: each run of hit words, merged, from its first to its last letter."""
        if not text or not self.hit.any():
            return []
        words = [m.span() for m in WORD.finditer(text)]
        edge = np.diff(np.r_[0, self.hit.view(np.int8), 0])
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        return [(words[a][0], words[b][1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def search_shard(counts: list[int], symbols: np.ndarray, phrases: Phrases) -> list[Found]:
    """``counts``: words of each document; ``symbols``: their numbers, documents separated by a 0."""
    base = np.cumsum([0] + [c + 1 for c in counts])
    change = np.zeros(len(symbols) + 1, np.int32)
    items: dict[int, set[str]] = {}
    if phrases.windows and len(symbols):
        for length, which, at in occurrences(symbols, phrases):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            doc = np.searchsorted(base, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                items.setdefault(d, set()).update(phrases.items[length][w])
    hit = np.cumsum(change[:-1]) > 0
    return [
        Found(n, hit[base[k] : base[k] + n], sorted(items.get(k, ())))
        for k, n in enumerate(counts)
    ]


def shards(texts: Iterator[bytes | None], phrases: Phrases) -> Iterator[Found]:
    """The findings of each text, in order, searched shard by shard."""
    number = phrases.numbers.get
    counts: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for text in texts:
        words = words_of(text)
        part = np.zeros(len(words) + 1, np.int64)
        part[:-1] = [number(w, 0) for w in words]
        counts.append(len(words))
        parts.append(part)
        held += len(part)
        if held >= SHARD_WORDS:
            yield from search_shard(counts, np.concatenate(parts), phrases)
            counts, parts, held = [], [], 0
    if counts:
        yield from search_shard(counts, np.concatenate(parts), phrases)


def load_phrases(benchmark: DataFrame, window: int) -> Phrases:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; search it in parts of {MAX_BENCHMARK_BYTES}")
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).collect()
    return Phrases.of([(r.item_id, bytes(r.text) if r.text is not None else None) for r in rows], window)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, spans.

    ``items`` are the ids (as sorted strings) of benchmark items of which a window of ``window`` consecutive words
    occurs; an item with fewer words, but not none, is one window. ``n_hit`` counts the words inside any occurrence,
    and ``spans`` are the code point ranges of the text that hold them, merged. A null or empty text has no words. A
    null item_id is no item. Every row of ``docs`` gives one row, also where doc_ids or texts repeat; columns other
    than doc_id, text and item_id are not read. An empty benchmark finds nothing.
    """
    phrases = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            out = out or pa.schema([
                ("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ])
            texts = batch.column(1)
            rows = []
            for k, found in enumerate(shards((v.as_py() for v in texts), phrases.value)):
                n_hit = int(found.hit.sum())
                spans = found.spans(texts[k].as_py().decode("utf-8", "replace")) if n_hit else []
                rows.append((found.n_words, n_hit, found.items, [{"start": a, "end": b} for a, b in spans]))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, list(out)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=out)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def remove_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the spans that ``find_phrases`` reports; all columns as they were, n_chars counted anew.

    The findings are applied where they are made, so texts are not joined or shuffled. A document without a finding
    keeps its text, null or empty included; one of which nothing but benchmark passages and signs was left is dropped.
    """
    phrases = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            coded = (None if v is None else v.encode() for v in (x.as_py() for x in texts))
            changed: dict[int, str] = {}
            dropped = set()
            for k, found in enumerate(shards(coded, phrases.value)):
                if found.hit.any():
                    text = texts[k].as_py()
                    changed[k] = without_spans(text, found.spans(text))
                    if found.hit.all():
                        dropped.add(k)
            if changed:
                new = [changed.get(k, None) if k in changed else v.as_py() for k, v in enumerate(texts)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
                if n_at is not None:
                    sizes = batch.column(n_at)
                    counts = [len(changed[k]) if k in changed else v.as_py() for k, v in enumerate(sizes)]
                    batch = batch.set_column(n_at, batch.schema.field(n_at), pa.array(counts, sizes.type))
                if dropped:
                    batch = batch.filter(pa.array([k not in dropped for k in range(batch.num_rows)]))
            yield batch

    return docs.mapInArrow(clean, docs.schema)
