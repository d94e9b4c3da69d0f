from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from waybill.llm import toxicity as tx
from waybill.llm.queries import QUERIES
from waybill.llm.toxicity import FEATURES, Isotonic, Lexica, Trees, held_out, score_documents, train

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op2_toxicity"](spark, FOLDER).collect()
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == held_out(str(r.doc_id)) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in tested]) > 0.95
    assert np.mean([p for p, y in tested if y]) > 0.6
    assert np.mean([p for p, y in tested if not y]) < 0.02


def test_features_of_disguised_words():
    lexica = Lexica({"idiot": 5.0, "moron": 4.0}, {"idio": 5.0})
    at = FEATURES.index("disguised_rate")
    for text in ("you 1d!0t there", "an i.d.i.o.t", "an i d i o t here", "idiooooot", "m0r0n"):
        assert lexica.features(text)[at] > 0
    assert lexica.features("nothing here, e.g. at 10 o'clock")[at] == 0
    assert lexica.features("You are an idiot")[FEATURES.index("near_you")] > 0
    assert lexica.features("idiotisch")[FEATURES.index("start_rate")] == 1
    assert lexica.features(None) == lexica.features("") and len(lexica.features("")) == len(FEATURES)


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0)).astype(float)
    p = Trees.fit(x[:1500], y[:1500]).margin(x[1500:]) > 0
    assert (p == y[1500:]).mean() > 0.95
    rising = Isotonic.fit(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.all(np.diff(rising(np.linspace(0, 6, 50))) >= 0)
    assert rising(np.array([2.5]))[0] == 0.5
    assert Trees.fit(np.zeros((0, 3)), np.zeros(0)).margin(np.zeros((2, 3))).shape == (2,)


def test_nulls_repeats_clashing_names_and_no_labels(frame):
    rng = random.Random(1)
    make = lambda toxic: " ".join(rng.choice(["the", "of", "and", "it"]) for _ in range(30)) + (" scum" if toxic else "")
    rows = [(i, make(i % 3 == 0), 1) for i in range(120)] + [(500, None, 1), (501, "", 1), (0, "scum scum", 1), (None, "scum", 1)]
    docs = frame(rows, "doc_id long, text string, score int")
    labels = frame([(i, int(i % 3 == 0)) for i in range(120)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = score_documents(docs, train(docs, labels)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""]
    plain = score_documents(docs, train(docs, labels.limit(0))).collect()
    assert len({r.score for r in plain}) == 1 and all(r.predicted == 0 for r in plain)
    assert score_documents(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def plain_features(lexica: tx.Lexica, text: str) -> list[float]:
    """Every pattern run over the whole text, distances to the second person one by one."""
    low = text.lower()
    tokens = tx.WORD.findall(low)
    n, kinds = max(1, len(tokens)), list(dict.fromkeys(tokens))
    weight = {w: lexica.words[w] for w in kinds if w in lexica.words}
    start = {}
    for w in kinds:
        found = [lexica.starts[w[:k]] for k in tx.PREFIXES if len(w) > k and w[:k] in lexica.starts]
        if found:
            start[w] = max(found)
    yous = [k for k, w in enumerate(tokens) if w in tx.SECOND_PERSON]
    near = sum(any(abs(k - y) <= tx.NEAR_WORDS for y in yous) for k, w in enumerate(tokens) if w in weight or w in start)
    hidden = []
    for match in tx.DISGUISED.findall(low):
        plain = {tx.APART.sub("", match).translate(tx.LOOKS_LIKE), tx.APART.sub("", match.translate(tx.LOOKS_LIKE))}
        hidden += [lexica.words[w] for w in plain if w in lexica.words and w not in kinds]
    spaced = tx.SPACED.findall(low)
    closed = [s.replace(" ", "") for s in spaced] + [tx.REPEATED.sub(r"\1", w) for w in kinds if tx.REPEATED.search(w)]
    hidden += [lexica.words[w] for w in closed if w in lexica.words]
    blanks = text.count(" ") + text.count("\n")
    marks = text.count("!") + text.count("?")
    return [
        sum(w in weight for w in tokens) / n, sum(weight[w] * tokens.count(w) for w in weight) / n,
        max(weight.values(), default=0), len(weight),
        sum(w in start for w in tokens) / n, sum(start[w] * tokens.count(w) for w in start) / n, max(start.values(), default=0),
        len(hidden) / n, max(hidden, default=0), near / n, len(yous) / n,
        sum(map(len, tx.CAPITALS.findall(text))) / max(1, len(text) - blanks), len(tx.SHOUTED.findall(text)) / n,
        marks / max(1, len(text)), len(tx.PUNCTUATION.findall(text)) / n,
        (len(text) - sum(map(len, tokens)) - blanks) / max(1, len(text)),
        len(tx.DIGIT_INSIDE.findall(low)) / n, len(tx.REPEATED.findall(low)) / n, len(spaced) / n, np.log1p(len(tokens)),
    ]


def test_features_equal_plain_patterns():
    """The cheap tests before costly patterns never change a feature."""
    lexica = tx.Lexica({"idiot": 3.0, "stupid": 4.0, "du": 2.5}, {"idio": 2.0, "stupi": 2.75, "dummko": 5.0})
    texts = [
        "", " ", "you i d i o t!", "1d!ot s.t.u.p.i.d you $tupid idiiiiot IDIIIOT!!! ??", "x i  d i o t", "(i d i o t)", "___ aaa ...",
        "stu-pid id!ot idiot", "İ d i o t ΣΑΣ.", "a\ud800aa ss\ud800", "du Dummkopf", "i̇ d i o", "5i d i o t",
    ]
    letters = "iditosupyu IDST  .!?_-*15@$|+\n\t éΣİ²ß"
    draw = np.random.default_rng(3)
    texts += ["".join(draw.choice(list(letters), draw.integers(0, 60))) for _ in range(3000)]
    for text in texts:
        assert np.allclose(lexica.features(text), plain_features(lexica, text), rtol=1e-12, atol=0), text


def test_terms_are_sent_on_before_many_are_held(monkeypatch):
    monkeypatch.setattr(tx, "HELD_TERMS", 100)
    texts = [" ".join(f"word{n % 7} number{n}" for n in range(k, k + 30)) for k in range(0, 300, 10)]
    labels = [k % 2 for k in range(len(texts))]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels), pa.array([0] * len(texts))], names=["text", "toxic", "fold"])
    sent = list(tx._count_terms(iter([rows])))
    assert len(sent) > 3 and max(b.num_rows for b in sent) < 300
    found = {}
    for b in sent:
        for r in b.to_pylist():
            c = found.setdefault((r["kind"], r["term"]), [0, 0])
            c[0], c[1] = c[0] + r["c0"], c[1] + r["c1"]
    plain = {}
    for text, label in zip(texts, labels, strict=True):
        for kind, own in zip("ws", tx.terms(text), strict=True):
            for term in own:
                plain.setdefault((kind, term), [0, 0])[label] += 1
    assert found == plain
