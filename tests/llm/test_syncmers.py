from __future__ import annotations

import hashlib

import pytest

from waybill.llm import syncmers
from waybill.llm.queries import QUERIES
from waybill.llm.syncmers import compare_edited, with_anchors


def edited(rows):
    """doc_id -> (code points, sha256 of the edited text), stated plainly."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_rows", [1, 3, 500])
def test_edited_text_of_the_next_document(frame, monkeypatch, part_rows):
    monkeypatch.setattr(syncmers, "PART_ROWS", part_rows)
    texts = [None, "", "a", "äöü€𝄞", "one two three four five six seven", "日本語のテキスト", "x " * 500, "one two three four five six seven"]
    rows = [(7 * i * i - 40, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in compare_edited(frame([(*r, 3) for r in rows], "doc_id long, text string, _part int")).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == edited(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_anchors_do_not_depend_on_their_context(frame):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(1, passage), (2, "some other words stand before it " + passage + " and after it")]
    got = {r.doc_id: r.a for r in with_anchors(frame(rows, "doc_id long, text string"), "text", "a").collect()}
    own = [x for x in got[1]]
    assert got[2][6 : 6 + 37] == own[:37]
    assert 10 < sum(x is not None for x in own) < 37


def test_single_rows_repeats_null_ids_and_empty_table(frame):
    schema = "doc_id long, text string"
    assert compare_edited(frame([], schema)).count() == 0
    alone = compare_edited(frame([(5, "abcd")], schema)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1
    assert compare_edited(frame([(5, "a b"), (5, "a b"), (None, "c"), (None, None)], schema)).count() == 4
    assert compare_edited(frame([(None, "c d")], schema)).count() == 1


def test_query_finds_the_edited_text(spark):
    rows = QUERIES["op5_closed_syncmers"](spark, "/root/testdata/sf0.01").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(docs)
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited > 0.2 for r in long) > 0.97 * len(long)
    assert sum(r.near_next < 0.1 for r in long) > 0.9 * len(long)


def test_main_path_is_native(spark):
    plan = QUERIES["op5_closed_syncmers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_long_texts_are_compared_whole(frame):
    words = [f"w{k}" for k in range(6000)]
    passage = [f"shared{k}" for k in range(50)]
    texts = {
        6: words, 5: [*words[:3000], "one", "sentence", "more", *words[3000:]], 4: [*words[3000:], *words[:3000]],
        3: [f"a{k}" for k in range(5000)] + passage, 2: passage + [f"b{k}" for k in range(5000)],
    }
    got = {r.doc_id: r for r in compare_edited(frame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()}
    assert len({r.fingerprint for r in got.values()}) == 5
    assert 0.99 < got[6].near_next < 1 and 0.99 < got[5].near_next < 1
    assert 0 < got[3].near_next < 0.02


def test_passages_in_another_order_are_not_the_same(frame):
    a, b, c = ([f"{x}{k}" for k in range(40)] for x in "abc")
    rows = [(2, " ".join(a + b + c)), (1, " ".join(c + b + a))]
    got = {r.doc_id: r for r in compare_edited(frame(rows, "doc_id long, text string")).collect()}
    assert 0.7 < got[2].near_next < 1 and got[1].fingerprint != got[2].fingerprint
