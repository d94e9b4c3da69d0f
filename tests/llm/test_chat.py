from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import chat
from waybill.llm.chat import K, ROLES, STATES, Hmm, chained, joined, learn, observe, parse_transcripts
from waybill.llm.queries import QUERIES
from waybill.llm.storage import stored


def some_model(seed=0):
    rng = np.random.default_rng(seed)
    return Hmm.of(rng.integers(0, 9, K), rng.integers(0, 9, (K, K)), rng.integers(0, 9, (K, chat.OBSERVATIONS)))


def test_markers():
    assert [observe(x)[0] // 12 for x in ("System: x", "### Human:", "[BOT] y", "Q: why?", "Assistance is near", "a b", "<|user|> z", "User")] == [1, 2, 3, 2, 0, 0, 2, 2]
    assert "[BOT] hello"[observe("[BOT] hello")[1] :] == "hello"
    assert observe("")[1] == 0 and observe("x" * 10_000)[1] == 0


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_chained_chunks_give_the_best_path(frame, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    model = some_model()
    lines = ["User: a?", "b", "", "- c", "Bot: d"]
    rows = [("x", k, line, "clash") for k, line in enumerate(lines)] + [("y", 3, "System: s\nmore", "clash"), (None, None, None, "clash")]
    got = parse_transcripts(frame(rows, "conv_id string, part long, text string, chunk string"), model).collect()
    seen = [observe(line)[0] for line in lines]
    score = lambda p: model.start[p[0]] + sum(model.show[s, o] for s, o in zip(p, seen)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(K), repeat=len(lines)), key=score)
    own = sorted((r for r in got if r.conv_id == "x"), key=lambda r: r.part)
    assert [(r.role, not r.continues) for r in own] == [STATES[s] for s in best]
    assert {r.conv_id for r in got} == {"x", "y", None} and all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" for r in got)


def test_empty_table(frame):
    assert parse_transcripts(frame([], "conv_id long, part long, text string"), some_model()).count() == 0
    assert learn(frame([], "conv_id long, part long, text string, role string")).show.shape == (K, chat.OBSERVATIONS)


def test_roles_of_held_out_conversations(spark):
    folder = "/root/testdata/sf0.01"
    true = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", F.col("turn").alias("part"), F.col("role").alias("true"))
    both = QUERIES["op8_chat_formatting"](spark, folder).join(true, ["conv_id", "part"])
    assert both.where("held_out").agg(F.avg((F.col("role") == F.col("true")).cast("int"))).first()[0] > 0.85
    assert both.select("conv_id", "part").distinct().count() == true.count()


@pytest.mark.parametrize("part", [None, 7])
def test_rows_of_one_number_are_cut_into_chunks(frame, monkeypatch, part):
    monkeypatch.setattr(chat, "CHUNK", 8)
    kept = {}
    monkeypatch.setattr(chat, "stored", lambda made, name: kept.setdefault(name, stored(made, name)))
    model = some_model()
    lines = sorted(random.Random(1).choices(["User: a?", "b", "", "- c", "Bot: d"], k=300))
    seen = [observe(line)[0] for line in lines]
    path = model.path(seen, K, int(chained([model.table(seen)], K, None)[0][1]))
    for conv in ("x", None):
        rows = [(conv, part, line) for line in lines]
        kept.clear()
        got = parse_transcripts(frame(rows, "conv_id string, part long, text string").repartition(5), model).collect()
        assert kept["chat-tables"].count() >= 300 / 8
        assert Counter((r.role, r.continues) for r in got) == Counter((STATES[s][0], not STATES[s][1]) for s in path)


def test_tables_chain_in_two_levels():
    model, rng = some_model(), np.random.default_rng(2)
    seen = rng.integers(0, chat.OBSERVATIONS, 60).tolist()
    pieces = [model.table(seen[k : k + 5]) for k in range(0, 60, 5)]
    ranges = [joined(pieces[k : k + 4]) for k in range(0, 12, 4)]
    assert np.allclose(joined(ranges), model.table(seen))
    ends = chained(ranges, K, None)
    inner = [e for k, (before, last) in enumerate(ends) for e in chained(pieces[4 * k : 4 * k + 4], before, last)]
    assert inner == chained(pieces, K, None)


def test_learning_counts_every_row_once(frame):
    turns = [(c, k, f"{c} {k}", ROLES[k % 3]) for c in range(5) for k in range(40)]
    plain = np.zeros((K, K))
    for c, k, _, _ in turns:
        if k:
            plain[2 * ((k - 1) % 3), 2 * (k % 3)] += 1
    want = Hmm.of(np.array([5, 0, 0, 0, 0, 0]), plain, np.zeros((K, chat.OBSERVATIONS)))
    got = learn(frame(turns, "conv_id long, part long, text string, role string").repartition(7))
    assert np.allclose(np.exp(got.start), np.exp(want.start)) and np.allclose(np.exp(got.move), np.exp(want.move))
