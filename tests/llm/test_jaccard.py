from __future__ import annotations

import random

import pytest

from waybill.llm import jaccard
from waybill.llm.components import connected_components
from waybill.llm.jaccard import Threshold, jaccard_components


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = make(30)
    texts = []
    for n in (5, 8, 9, 12, 14, 20, 25, 40, 90, 200):
        for _ in range(3):
            base = make(n)
            texts.append(base)
            for _ in range(rng.choice([1, 4, 9])):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, n // 40)])):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], [rng.choice(vocab)], make(2)])
                texts.append(copy)
    texts += [make(10) + passage for _ in range(15)] + [passage + make(4) for _ in range(10)]
    base = make(60)
    for _ in range(25):  # copies that are linked with their origin but rarely with one another
        copy = list(base)
        copy[rng.randrange(60)] = rng.choice(vocab)
        if rng.random() < 0.5:
            copy[rng.randrange(60)] = rng.choice(vocab)
        texts.append(copy)
    texts += [base, base, ["A"], ["a"], ["b", "c"], ["B", "c"], []]
    rows = [(k, " ".join(t).title() if rng.random() < 0.2 else "  ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, "")]


@pytest.mark.parametrize(("seed", "list_rows", "block"), [(1, 2048, 512), (2, 3, 4)])
def test_agrees_with_brute_force(frame, monkeypatch, seed, list_rows, block):
    monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    docs = frame([(i, t, 7) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_empty_table_repeats_and_null_ids(frame):
    schema = "doc_id long, text string"
    assert jaccard_components(frame([], schema)).collect() == []
    got = jaccard_components(frame([(3, "a b"), (3, "a b"), (None, "a b"), (1, "A B")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 1, 1), (1, 1, 1), (3, 1, 1), (3, 1, 1)]


def test_first_shingles_hold_what_similar_sets_share():
    t = Threshold(80)
    assert [t.first(n, 1) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]
    assert t.smallest_size() == 4


def test_components(frame):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(frame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 95: 90, 90: 90}
    assert connected_components(frame([], "a long, b long")).collect() == []
