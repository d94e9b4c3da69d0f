from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waybill.llm.rollups import Rollup, deletes, inserts, pieces, pieces_by_digit, revisions, words

SCHEMA = "source string, lang string, tokenizer string, tokens long, old long"


def held(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_batches_add_up_and_repeat_safely(spark, frame, tmp_path):
    store = Rollup(spark, str(tmp_path / "totals"))
    assert held(store) == {} and store.batches() == []
    rows = frame([("a", "en", "t1", 5, 4), ("a", "en", "t1", 5, 4), (None, "en", "t1", 1, 1), ("b", None, "t1", None, 0)], SCHEMA)
    assert store.commit("first", inserts(rows)) and not store.commit("first", inserts(rows))
    assert held(store) == {("a", "en", "t1"): (2, 10), (None, "en", "t1"): (1, 1), ("b", None, "t1"): (1, 0)}
    store.commit("gone", deletes(rows.where("source = 'a'").limit(1)))
    store.commit("again", revisions(rows.where("source is null"), "old", "tokens"))
    store.commit("new-version", inserts(rows.where("source = 'a'").withColumn("tokenizer", F.lit("t2"))))
    assert held(store)["a", "en", "t1"] == (1, 5) and held(store)["a", "en", "t2"] == (2, 10)
    store.commit("rest", deletes(rows.where("source = 'a'").limit(1)))
    assert ("a", "en", "t1") not in held(store)
    assert store.commit("nothing", inserts(rows.limit(0)))
    with pytest.raises(ValueError):
        store.commit("../x", inserts(rows))


def test_an_unfinished_batch_does_not_count_and_is_written_again(spark, frame, tmp_path):
    store = Rollup(spark, str(tmp_path / "totals"))
    rows = frame([("a", "en", "t1", 5, 4)], SCHEMA)
    store.commit("one", inserts(rows))
    (tmp_path / "totals/batch=one/_SUCCESS").rename(tmp_path / "mark")
    assert held(store) == {}
    assert store.commit("one", inserts(rows)) and held(store) == {("a", "en", "t1"): (1, 5)}


def test_counts_of_texts(column):
    texts = [None, "", "  \n", "a", " One two\t3,4 ", "x\x0by\x0cz é!"]
    assert column(words, texts) == [0, 0, 0, 1, 3, 4]
    assert column(pieces, texts) == [0, 0, 0, 1, 5, 5]
    assert column(pieces_by_digit, ["12 ab34", "a b"]) == [5, 2]


def test_folded_batches_keep_totals_and_names(spark, frame, tmp_path):
    folder = tmp_path / "totals"
    store = Rollup(spark, str(folder))
    assert not store.compact()
    rows = frame([("a", "en", "t1", 5, 4), (None, "en", "t1", 1, 1)], SCHEMA)
    store.commit("one", inserts(rows))
    store.commit("two", inserts(rows))
    before = held(store)
    assert store.compact() and held(store) == before and not list(folder.glob("batch=*"))
    assert not store.commit("one", inserts(rows)) and store.batches() == ["one", "two"] and held(store) == before
    assert store.commit("three", deletes(rows)) and store.compact()
    assert held(store) == {("a", "en", "t1"): (1, 5), (None, "en", "t1"): (1, 1)}
    assert not store.commit("three", deletes(rows)) and len(list(folder.glob("fold=*"))) == 1
    store.commit("four", inserts(rows))
    four = held(store)
    store.compact()
    mark = next(folder.glob("fold=*")) / "_SUCCESS"
    assert mark.exists() and held(store) == four and store.batches() == ["four", "one", "three", "two"]
