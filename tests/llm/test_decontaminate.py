from __future__ import annotations

import random
import re

import numpy as np

from waybill.llm import decontaminate
from waybill.llm.decontaminate import find_phrases, remove_phrases
from waybill.llm.fm_index import FMIndex, suffix_array

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {b: b + 32 for b in range(65, 91)}


def words(text):
    return SPLIT.findall((text or "").translate(LOWER))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, phrase in items:
        w = words(phrase)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_suffixes_and_search():
    rng = np.random.default_rng(1)
    for size, alphabet in ((1, 3), (40, 3), (500, 2), (700, 40)):
        text = rng.integers(0, alphabet, size)
        text = np.r_[text, 0]
        order = suffix_array(text)
        assert sorted(order.tolist()) == list(range(len(text)))
        index = FMIndex(text, alphabet)
        for n in (1, 2, 5):
            patterns = rng.integers(1, alphabet, (30, n)) if alphabet > 1 else np.zeros((0, n), int)
            low, high = index.ranges(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_agrees_with_brute_force(frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 150)
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", 60)
    rng = random.Random(3)
    vocab = ["the", "Of", "än", "x1", "rare", "日本"]
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, make(rng.choice([3, 9, 10, 12, 20]))) for k in range(12)] + [(50, None), (51, ""), (52, "!?"), (None, "the of")]
    docs = [(k, make(rng.choice([0, 1, 8, 40, 200])), k) for k in range(60)]
    docs += [(100 + k, f"{make(7)} other {items[k % 12][1]}; other {make(3)}", k) for k in range(30)]
    docs += [(200, None, 1), (200, None, 1), (201, items[0][1], 1)]
    d = frame(docs, "doc_id long, text string, n_words int")
    b = frame(items, "item_id long, text string")
    texts = {i: t for i, t, _ in docs}
    got = find_phrases(d, b).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.doc_id], [x for x in items if x[0] is not None])
        inside = "".join(texts[r.doc_id][s.start : s.end] + " " for s in r.spans)
        assert len(words(inside)) == r.n_hit


def test_removal_keeps_clean_documents(frame):
    phrase = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, f"Before it, {phrase}! After it.", "en", "s", 0), (2, phrase, "en", "s", 55), (3, None, "en", "s", None),
        (4, "one two three four", "en", "s", 18), (5, "", "en", "s", 0), (4, "one two three four", "en", "s", 18),
    ]
    d = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = frame([(1, phrase)], "item_id long, text string")
    out = remove_phrases(d, b)
    assert out.columns == d.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id != 3)
    assert got == [(1, "Before it, ! After it.", 22), (4, rows[3][1], 18), (4, rows[3][1], 18), (5, "", 0)]
    assert out.where("doc_id = 3").count() == 1
    assert remove_phrases(d.limit(0), b).count() == 0
    assert remove_phrases(d, b.limit(0)).count() == 6
