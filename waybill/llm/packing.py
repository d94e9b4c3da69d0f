"""Packing by powers of two: documents are cut into binary lengths, and equal lengths share a bucket."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that one Python worker remembers, in two generations, and the longest word that it remembers.
CACHE_WORDS = 150_000
CACHE_WORD_BYTES = 64
# Bytes of text that are encoded and cut at once.
TEXT_BYTES = 2 << 20

# Words whose pre-tokens follow from their characters alone: printable ASCII without the apostrophe of contractions, and
# composed Latin letters, which every Unicode version lower-cases one by one.
EXTENDED = "āăąćĉċčďđēĕėęěĝğġģĥħ"
LATIN = f"a-zß-öø-ÿ{EXTENDED}"
PLAIN = re.compile(f"[!-&(-~À-ÖØ-Þ{LATIN}{EXTENDED.upper()}]+")
PRE_TOKEN = re.compile(f"[{LATIN}]+|[0-9]|[^0-9{LATIN}]+")

SCHEMA = "doc_id {key}, start long, length long, doc_tokens long, ids binary"


def byte_symbols() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


class WordEncoder:
    """Token ids of texts, all in one array, and how many each text has.

    White space separates pre-tokens in this tokenizer and is dropped by it, so the ids of a text are those of its
    blank-separated words one after another. The different words of some texts are encoded once, their ids are then
    laid out by word number. Each worker remembers the words it met lately; what it remembers changes no result. Words
    that hold the name of an added token are left to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(names) or "(?!)", re.IGNORECASE)
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """The ids of a pre-token in lower case."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                symbols = part if part.isascii() else part.encode().decode("latin-1").translate(self.symbols)
                ids = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(part) <= CACHE_WORD_BYTES:
                self.parts[part] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        if PLAIN.fullmatch(word) and not ("<" in word and self.added.search(word)):
            return b"".join(map(self._part, PRE_TOKEN.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        """Drop the elder generations: a worker that goes on with other steps keeps one of each at most."""
        self.old, self.old_parts = {}, {}

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        young, old, out = self.young, self.old, []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:  # a word of characters that the tokenizer drops has no ids
                    ids = self._ids(word)
                if len(word) <= CACHE_WORD_BYTES:
                    young[word] = ids
            out.append(ids)
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        if len(self.parts) > CACHE_WORDS:
            self.old_parts, self.parts = self.parts, {}
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8; null: none), one after another, and the number of ids of each."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        coded = lists.flatten().dictionary_encode()
        ids = self.words([w.decode("utf-8", "replace") for w in coded.dictionary.view(pa.binary()).to_pylist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(begins[at] - (ends - lengths), lengths)
        flat = np.frombuffer(b"".join(ids), np.uint32)[places]
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return flat, np.diff(edges)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def binary_lengths(total: int, longest: int) -> list[int]:
    """``total`` as pieces of ``longest`` followed by falling powers of two.

    >>> binary_lengths(4101, 2048)
    [2048, 2048, 4, 1]
    """
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit).

    Every document's ids end with ``end_id``; a null or empty text has that id alone. ``longest`` must be a power of
    two. Texts are encoded whole. Only ``doc_id`` and ``text`` are read, so further columns may have any name; rows
    that repeat a doc_id or a text are cut like any other. An empty table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    key = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for batch in batches:
            for part in _parts(batch):
                flat, sizes = encode(part.column(1))
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4", copy=False)
                yield _pieces(part.column(0), flat, sizes + 1, longest)
        encode.forget()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, SCHEMA.format(key=key.simpleString()))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` a few megabytes of text at a time, never less than a row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _pieces(keys: pa.Array, flat: np.ndarray, sizes: np.ndarray, longest: int) -> pa.RecordBatch:
    """``binary_lengths`` of documents of ``sizes`` ids; pieces lie in ``flat`` as they lie in the documents."""
    whole, rest = sizes // longest, sizes % longest
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    some = rest[:, None] >> bits & 1 == 1
    counts = whole + some.sum(axis=1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    length = np.full(len(doc), longest, np.int64)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Bits stand behind the whole pieces of their document, in the order of the matrix.
    length[place >= whole[doc]] = 1 << np.broadcast_to(bits, some.shape)[some]
    edges = np.concatenate([[0], np.cumsum(length)])
    start = edges[:-1] - np.repeat(np.cumsum(sizes) - sizes, counts)
    ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(flat)])
    columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]), ids]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])


def pack_documents(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``cut_documents`` with the sequence that each of them fills: sequence_id, offset, bucket.

    A sequence is one piece, so no sequence crosses documents; its length is a power of two, so nothing is padded.
    ``bucket`` is the binary logarithm of the length: batches drawn from one bucket are rectangular. Numbering by
    partition needs no shuffle; a bucket as hot as a third of all pieces is spread over all tasks.
    """
    return cut_documents(docs, tokenizer_path, longest, end_id).select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )
