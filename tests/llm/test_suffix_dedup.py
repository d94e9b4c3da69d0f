from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waybill.llm import suffix_dedup
from waybill.llm.queries import QUERIES
from waybill.llm.suffix_dedup import Windows, remove_repeats, sliding, sort_shard
from waybill.llm.two_stage import adjacent_prefixes, repeated_places, two_stage_order, words_at

SCHEMA = "doc_id long, text string, kept string, block int"


def plain(texts, length):
    """Removed byte ranges of each text."""
    coded = [(t or "").encode() for t in texts]
    seen = {}
    for t in coded:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in coded:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (gone[i] if i < len(t) else 0) != (gone[i - 1] if i else 0)]
        out.append((t, list(zip(edges[::2], edges[1::2]))))
    return out


def check(frame, texts, length, **options):
    docs = frame([(i, t, "clash", 3) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in remove_repeats(docs, length, **options).collect()}
    assert len(got) == len(texts)
    for i, (t, spans) in enumerate(plain(texts, length)):
        assert [(s.start, s.end) for s in got[i].spans] == spans, i
        kept = bytearray(t)
        for a, b in reversed(spans):
            del kept[a:b]
        assert bytes(got[i].kept) == bytes(kept) and got[i].n_bytes == len(t)


def corpus(seed, n, words=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 8))) for _ in range(words)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = [say(60) for _ in range(5)]
    texts = [None, "", "short", "-" * 900, "-" * 500 + "x", "y" + "-" * 300 + "a", "ab" * 400, "\0" * 450, shared[0], shared[0]]
    for _ in range(n):
        parts = [say(rng.randint(1, 90)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared)[rng.randint(0, 40) :])
        texts.append(" ".join(parts))
    near = say(400)
    texts += [near, near, near[:700] + "#" + near[700:], near.replace(near[900:903], "?!", 1)]
    return texts


def test_spans_agree_with_a_plain_search(frame):
    check(frame, corpus(1, 60), 200)


def test_small_blocks_pieces_and_shards_change_nothing(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 512)
    monkeypatch.setattr(suffix_dedup, "FRAGMENT_IDS", 3)
    check(frame, corpus(2, 40), 60, shard_bytes=4000, hot_bytes=9000)


def test_hot_routes_are_split(frame):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=70))
    texts = ["".join(rng.choices("xyz", k=30)) + passage + "".join(rng.choices("uvw", k=rng.randint(1, 40))) for _ in range(150)]
    check(frame, texts, 64, shard_bytes=300, hot_bytes=300)


def test_empty_table_and_one_text(frame):
    assert remove_repeats(frame([], SCHEMA)).count() == 0
    check(frame, ["abc " * 100], 200)
    check(frame, ["unique text"], 200)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8))
def test_two_stage_order_is_the_suffix_order(parts):
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    words = words_at(text)
    order = two_stage_order(text, words, np.ones(len(text), bool), 10_000)
    suffixes = [text[i:].tobytes() for i in order]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert suffixes == sorted(suffixes)
    lengths = adjacent_prefixes(words, order, 10_000)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        # Zeros follow the end of the text.
        assert lengths[k] == same or (lengths[k] > same == min(len(a), len(b)) and not any((a + b)[same:same]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=80).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8), st.sampled_from([8, 12]))
def test_shards_find_repeated_windows(parts, length):
    seen = {}
    for p in parts:
        for i in range(len(p) - length + 1):
            seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
    for p, runs in zip(parts, sort_shard(parts, length)):
        hit = {i for a, b in runs for i in range(a, b)}
        assert hit == {i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1}


def test_sorts_only_what_is_wanted():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(97, 100, 3000), [0]]).astype(np.uint8)
    wanted = rng.random(len(text)) < 0.2
    wanted[-30:] = False
    found = repeated_places(text, wanted, 8)
    seen = {}
    for i in np.flatnonzero(wanted):
        seen.setdefault(text[i : i + 8].tobytes(), []).append(i)
    assert set(np.flatnonzero(found)) == {i for v in seen.values() if len(v) > 1 for i in v}


def test_long_runs_of_one_byte_are_unrolled():
    text = np.concatenate([np.full(200_000, 98), [97], np.full(150_000, 98), [0]]).astype(np.uint8)
    order = two_stage_order(text, words_at(text), np.ones(len(text), bool), 16)
    assert sorted(order[:3].tolist()) == sorted([len(text) - 1, 200_000, len(text) - 2])


def test_sliding():
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in range(1, 8):
        assert sliding(np.minimum, values, width, np.uint64(99)).tolist() == [int(values[i : i + width].min()) for i in range(8 - width)]


def test_windows_bar_nothing_that_repeats():
    """Every repeated window passes the filter, whatever stands around it."""
    rng = random.Random(9)
    texts = [(t or "").encode() for t in corpus(7, 30, words=40)]
    rng.shuffle(texts)
    windows = Windows(64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    values, several = windows.anchors(flat, ends)
    passed = {i for start, n, _ in windows.fragments(flat, ends, values[several]) for i in range(start, start + n)}
    seen, begin = {}, 0
    for t in texts:
        for i in range(len(t) - 63):
            seen.setdefault(t[i : i + 64], []).append(begin + i)
        begin += len(t)
    assert {i for v in seen.values() if len(v) > 1 for i in v} <= passed


def test_query_gives_digests(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_suffix_dedup"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    for row, (t, spans) in zip(rows, plain([r.text for r in rows], 200)):
        kept = bytearray(t)
        for a, b in reversed(spans):
            del kept[a:b]
        r = got[row.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), len(t) - len(kept), len(spans), hashlib.sha256(bytes(kept)).hexdigest())
