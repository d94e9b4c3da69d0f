from __future__ import annotations

import struct

import pyarrow as pa
import pytest

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_jaccard import brute as near
from waybill.llm.packing import WordEncoder, word_encoder
from waybill.llm.queries import word_tokenizer
from waybill.llm.storage import BATCH_SETTING

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and out.schema == docs.schema
        docs = corpus_pipeline.stored(out, "test-stage")
        found.append(docs.collect())
    return found


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0]}
    toxic = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert len([i for i in toxic if i in kept]) <= len(toxic) / 2
    assert len([i for i in clean if i in kept]) > 0.97 * len(clean)
    assert set(stages[0]) <= set(before)


def test_one_document_of_each_group_stays(stages):
    groups = near([(r.doc_id, r.text) for r in stages[0]])
    assert {r.doc_id for r in stages[1]} == {c for _, c in groups.values()}


def test_benchmark_passages_are_cut(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in stages[1]}
    after = {r.doc_id: r for r in stages[2]}
    for i, row in before.items():
        n, hit, _ = leaks(row.text, items)
        if not hit:
            assert after[i] == row
        elif hit < n:
            assert after[i].text != row.text and after[i].n_chars == len(after[i].text)
        else:
            assert i not in after


def test_packed_pieces_are_the_documents(stages):
    encode = word_encoder(word_tokenizer())
    pieces = {}
    for r in stages[3]:
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == {r.doc_id for r in stages[2]}
    for r in stages[2]:
        whole = encode(pa.array([r.text.encode()]))[0].tobytes() + struct.pack("<I", 1)
        assert b"".join(ids for _, ids in sorted(pieces[r.doc_id])) == whole


def test_run_is_the_stages_in_turn(spark, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[3])


ODD = "doc_id long, text string, score double, predicted int, _possible string, ids string, length int, start string, source string"


def odd_rows():
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (4, ""), (None, text), (None, None), (5, "word " * 40_000), (6, "short")]
    return [(k, t, 7.5, 3, "kept", "x", 4, "s", None) for k, t in rows]


def test_stages_on_nulls_repeats_and_clashing_names(spark, frame):
    docs = frame(odd_rows(), ODD)
    everything = sorted(map(repr, docs.collect()))
    toxic, near, cut, pack = (stage for _, stage in corpus_pipeline.STAGES)
    kept = toxic(spark, docs, FOLDER)
    assert kept.schema == docs.schema and sorted(map(repr, kept.collect())) == everything
    one = near(spark, docs, FOLDER)
    rows = one.collect()
    assert one.schema == docs.schema and all(r.score == 7.5 and r._possible == "kept" for r in rows)
    # Repeats of an id are one document; a null id is in no group.
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "4", "5", "6", "None", "None"]
    clean = cut(spark, docs, FOLDER)
    assert clean.schema == docs.schema and sorted(map(repr, clean.collect())) == everything
    pieces = pack(spark, docs, FOLDER).collect()
    assert sum(r.length for r in pieces if r.doc_id == 3) == 1 and sum(r.length for r in pieces if r.doc_id == 4) == 2
    assert all(len(bytes(r.ids)) == 4 * r.length for r in pieces)


def test_stages_on_empty_tables(spark, frame):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame([], ODD), FOLDER).count() == 0, name


def test_batches_are_bounded_by_bytes(spark):
    """Five thousand texts of 10 kB came to Python in one batch of 50 MB."""
    wide = spark.range(0, 5_000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefghi ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    own = spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING)
    try:
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
        corpus_pipeline.cut_benchmark(spark, docs, FOLDER)
        found = wide.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in found) == 5_000 and max(r.size for r in found) < 10 << 20
        spark.conf.set(BATCH_SETTING, "1m")  # a bound of the session's own stays
        corpus_pipeline.cut_benchmark(spark, docs, FOLDER)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(BATCH_SETTING, own) if own else spark.conf.unset(BATCH_SETTING)


def test_encoder_keeps_one_generation():
    encoder = WordEncoder(word_tokenizer())
    words = [f"word{n}" for n in range(200_000)]
    first = encoder.words(words)
    encoder.words(["another"])
    assert encoder.old
    encoder.forget()
    assert not encoder.old and not encoder.old_parts
    assert encoder.words(words) == first
