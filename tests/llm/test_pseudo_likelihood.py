from __future__ import annotations

import math
import random

import numpy as np

from waybill.llm.pseudo_likelihood import Network, Reader, Trainer, Vocabulary, score, score_documents, train


def corpus(n):
    rng = random.Random(2)
    pairs = [("salt", "pepper"), ("king", "queen"), ("left", "right"), ("up", "down")]
    return [" ".join(f"{a} and {b}" for a, b in (rng.choice(pairs) for _ in range(60))) for _ in range(n)]


def test_ordered_text_scores_above_shuffled_text(frame):
    texts = corpus(400)
    rng = random.Random(3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:20]]
    docs = frame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(4)
    vocabulary = Vocabulary.of(docs)
    network = train(docs, vocabulary)
    tested = frame([(i, t) for i, t in enumerate(texts[:20] + shuffled)] + [(90, None), (91, ""), (92, "unseen"), (92, "unseen")], "doc_id long, text string")
    got = score_documents(tested, vocabulary, network).collect()
    mean = lambda lo, hi: np.mean([r.per_word for r in got if lo <= r.doc_id < hi])
    assert mean(0, 20) > mean(20, 40) + 0.5
    assert [(r.n_words, r.pseudo_likelihood, r.per_word) for r in got if r.doc_id in (90, 91)] == [(0, 0.0, None)] * 2
    assert len(got) == 44 and all(r.pseudo_likelihood < 0 for r in got if r.n_words)


def test_probabilities_of_all_words_sum_to_one(frame):
    docs = frame([(1, "a a a b b c d e f g")], "doc_id long, text string")
    vocabulary = Vocabulary.of(docs)
    shares = {}
    for word in b"abcdefg":
        _, out, share = vocabulary.look_up(bytes([word]))
        shares[out] = shares.get(out, 0) + math.exp(share)
    assert all(s <= 1 + 1e-9 for s in shares.values())
    network, around = Network.fresh(), [np.array([1, 2])] * 4
    _, shown = network.forward(around)
    assert np.allclose(shown.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(np.exp(network.chosen(around, np.array([5, 9]))), shown[[0, 1], [5, 9]], atol=1e-6)


def test_long_texts_are_scored_in_steps(frame, monkeypatch):
    from waybill.llm import pseudo_likelihood

    docs = frame([(1, "a b c d e " * 50)], "doc_id long, text string")
    vocabulary, network = Vocabulary.of(docs), Network.fresh()
    whole = score(b"a b c d e " * 50, Reader(vocabulary), network)
    monkeypatch.setattr(pseudo_likelihood, "STEP_TOKENS", 7)
    parts = score(b"a b c d e " * 50, Reader(vocabulary), network)
    assert whole[0] == parts[0] == 250 and abs(whole[1] - parts[1]) < 1e-2


def test_gradient():
    rng = np.random.default_rng(1)
    network = Network.fresh()
    around = [rng.integers(0, 50, 64) for _ in range(4)]
    wanted = rng.integers(0, 20, 64)
    loss = lambda: -network.chosen(around, wanted).mean()
    before = loss()
    trainer = Trainer(network)
    for _ in range(30):
        trainer.step(around, wanted)
    assert loss() < before - 1


def test_empty_table(frame):
    docs = frame([], "doc_id long, text string")
    vocabulary = Vocabulary.of(docs)
    assert score_documents(docs, vocabulary, train(docs, vocabulary)).count() == 0


def test_every_word_has_the_share_of_its_own_count(frame, monkeypatch):
    """Words whose counts no task holds, and those that once met in one cell of 2^20, are told apart by their counts."""
    from waybill.llm import pseudo_likelihood as op

    met, first = {}, None
    for k in range(100_000):
        word = b"w%d" % k
        cell = op.xxhash.xxh64_intdigest(word, op.SEED) % (1 << 20)
        if cell in met:
            first = met[cell].decode(), word.decode()
            break
        met[cell] = word
    often, seldom = first
    base = [(k, f"v{k} " * 50) for k in range(900)]
    docs = frame([*base, (1000, f"{often} " * 30), (1001, seldom), (1002, "new")], "doc_id long, text string")
    held = Vocabulary.of(docs.where("doc_id <> 1002"))
    assert math.isclose(held.look_up(often.encode())[2] - held.look_up(seldom.encode())[2], math.log(31 / 2))
    monkeypatch.setattr(op, "HELD", 800)
    joined, network = Vocabulary.of(docs.where("doc_id <> 1002")), Network.fresh()
    assert math.isnan(joined.look_up(often.encode())[2]) and math.isnan(joined.look_up(b"new")[2])
    read = lambda v: {r.doc_id: r.pseudo_likelihood for r in score_documents(docs, v, network).collect()}
    one, other = read(held), read(joined)
    assert len(one) == len(other) == 903 and all(math.isclose(one[k], other[k], rel_tol=1e-9) for k in one)


def test_products_by_blocks():
    from waybill.llm.pseudo_likelihood import _gram, _product

    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500):
        left, right = rng.normal(size=(n, 24)).astype(np.float32), rng.normal(size=(n, 128)).astype(np.float32)
        weight = rng.normal(size=(24, 128)).astype(np.float32)
        assert np.allclose(_product(left, weight), left @ weight, atol=1e-4)
        assert np.allclose(_product(right, weight.T), right @ weight.T, atol=1e-4)
        assert np.allclose(_gram(left, right), left.T @ right, atol=1e-3)


def test_short_texts_are_scored_together_and_alike(frame, monkeypatch):
    from waybill.llm.pseudo_likelihood import score_texts

    texts = [b"a b c d e", None, b"", *(b"%s x%d" % (b"a c " * (k % 40), k) for k in range(300)), b"a b c d e"]
    docs = frame([(k, t and t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    vocabulary, network = Vocabulary.of(docs), Network.fresh()
    alone = [score(t, Reader(vocabulary), network) for t in texts]
    vocabulary.held = {w: n for w, n in vocabulary.held.items() if w != b"x7"}
    calls, chosen = [], Network.chosen
    monkeypatch.setattr(Network, "chosen", lambda *args: calls.append(1) or chosen(*args))
    found = score_texts(texts, Reader(vocabulary), network)
    assert len(calls) < 10  # a call for every text before
    assert found.words == [b"x7"] and found.times.tolist() == [1] and np.flatnonzero(found.rest).tolist() == [3 + 7]
    assert found.totals[0] == found.totals[-1]
    for k, (size, total) in enumerate(alone):
        assert found.sizes[k] == size and (k == 10 or math.isclose(found.totals[k], total, rel_tol=1e-9))


def test_new_words_are_learned_as_they_are_looked_up(frame):
    docs = frame([(1, " ".join(f"w{k} " * (k % 5 + 1) for k in range(900)))], "doc_id long, text string")
    vocabulary = Vocabulary.of(docs)
    reader, words = Reader(vocabulary), [b"w%d" % k for k in range(0, 1000, 3)]
    at = reader.number([words[:100], words])[100:]
    for k, word in zip(at, words, strict=True):
        given, wanted, share = vocabulary.look_up(word)
        assert (reader.given[k], reader.wanted[k]) == (given, wanted)
        assert np.isclose(reader.shares[k], share, rtol=1e-12, equal_nan=True)


def test_large_logits_stay_in_range():
    rng = np.random.default_rng(1)
    around, wanted = [rng.integers(0, 50, 64) for _ in range(4)], rng.integers(0, 20, 64)
    network = Network.fresh()
    network.level += 1_000
    other = Network.fresh()
    assert not network._bound() < 60 and other._bound() < 60
    assert np.allclose(network.chosen(around, wanted), other.chosen(around, wanted), atol=1e-3)
    for net in (network, other):
        Trainer(net).step(around, wanted)
    assert np.isfinite(network.flat()).all() and np.allclose(network.weight, other.weight, atol=1e-2)


def test_step_follows_the_gradient():
    rng = np.random.default_rng(5)
    around, wanted = [rng.integers(0, 50, 300) for _ in range(4)], rng.integers(0, 20, 300)
    network, like = Network.fresh(), Network.fresh()
    trainer = Trainer(network)
    trainer.step(around, wanted)
    hidden, error = like.forward(around)
    error[np.arange(300), wanted] -= 1
    error /= 300
    changes = [hidden.T @ error, error.sum(axis=0), ((error @ like.weight.T) * (1 - hidden**2)).sum(axis=0)]
    for square, change in zip((trainer.square[2], trainer.square[3], trainer.square[1]), changes, strict=True):
        assert np.allclose(square, 1e-6 + change**2, rtol=1e-3, atol=1e-9)
