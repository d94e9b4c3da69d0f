from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waybill.llm.packing import binary_lengths, pack_documents
from waybill.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n", "One two, two.", "x" * 3000, "Don't stop the ÉCOLE école ΣΑΣ 12345",
    "the cat sat " * 3000, "One two, two.", "<|endoftext|> is text", "a <|endoftext|> b", "x<|ENDOFTEXT|>y <|startoftext|><|endoftext|>!", "< |endoftext| > <b>", "日本語のテキスト", "Stra\u00dfe %%% _x_ x%%%y \u00c5ngstr\u00f6m A\u030angstrom \u0130stanbul it\u2019s", "'' 's ''s",
]


TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_binary_lengths():
    assert binary_lengths(1, 2048) == [1]
    assert binary_lengths(2048, 2048) == [2048]
    assert binary_lengths(6151, 2048) == [2048, 2048, 2048, 4, 2, 1]


def test_pieces_give_back_every_document(frame):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)]
    packed = pack_documents(frame(rows, "doc_id long, text string, ids string, length int"), PATH).collect()
    for i, text in enumerate(TEXTS):
        pieces = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in pieces for x in struct.unpack(f"<{r.length}I", bytes(r.ids))]
        assert ids == plain_ids(text)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 for r in pieces)
        assert all(2**r.bucket == r.length <= 2048 for r in pieces)
    assert len({r.sequence_id for r in packed}) == len(packed)


def test_repeated_rows_and_empty_table(frame):
    schema = "doc_id long, text string"
    packed = pack_documents(frame([(7, "a b c"), (7, "a b c"), (None, None)], schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 1), (7, 4), (7, 4)]
    assert pack_documents(frame([], schema), PATH).count() == 0


def test_longest_must_be_a_power_of_two(frame):
    with pytest.raises(ValueError):
        pack_documents(frame([], "doc_id long, text string"), PATH, longest=1000)


def test_query_checksums(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op4_packing"](spark, folder).collect()
    assert {r.doc_id for r in got} == set(texts)
    encoded = {k: plain_ids(t) for k, t in texts.items()}
    for r in got:
        ids = encoded[r.doc_id]
        piece = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *piece))


def test_long_runs_that_the_tokenizer_drops(frame):
    texts = ["a " + "\u00a0" * 40 + " b", "\u3000" * 30, "a" + "\u00a0" * 40 + "b " + "\u3000" * 22 + " " + "x" * 100, "\u00a0 \u3000"]
    packed = pack_documents(frame([*enumerate(texts)], "doc_id long, text string"), PATH).collect()
    for i, text in enumerate(texts):
        pieces = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in struct.unpack(f"<{r.length}I", bytes(r.ids))] == plain_ids(text)
