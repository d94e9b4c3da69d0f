from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from waybill.llm import hard_negatives
from waybill.llm.hard_negatives import Best, Rows, angles_to, directions, score_bounds, scores

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score double"


def plain(rows, every):
    rows = [
        (k, [math.floor(256 * x) for x in v], label) for k, v, label in rows
        if None not in (k, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for key, vector, label in rows:
        if key % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(vector, v)), k, other) for k, v, other in rows if k != key), key=lambda s: (-s[0], s[1]))
        for pos, k, _ in [s for s in scored if s[2] == label][:5]:
            low = [s for s in scored if s[2] != label and 80 * pos <= 100 * s[0] <= 100 * pos][:5]
            out += [(key, k, rank, n, pos, neg) for rank, (neg, n, _) in enumerate(low, 1)]
    return sorted(out)


def mined(frame, rows, every):
    got = hard_negatives.mine(frame([(*r, "clash", 1.0) for r in rows], SCHEMA), F.col("vec_id") % every == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_agrees_with_a_plain_loop(frame, monkeypatch):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [c + rng.gauss(0, 0.5) for c in rng.choice(centres)], rng.randrange(3)) for k in range(240)]
    same = [0.5, -0.25, 0.125, 1.0, -1.0, 0.0]
    rows += [(k, same, k % 3) for k in range(240, 330)]  # ties and a hot vector
    rows += [(400, [0.0] * 6, 0), (401, [], 1), (402, [3.0], 1), (403, None, 1), (404, same, None), (None, same, 1)]
    rows += [(405, [1.0, None, 1.0], 1), (406, [float("nan")] * 6, 0), (407, [float("inf")] * 6, 0), (410, [3e5] * 6, 2), (420, [-3e5] * 6, 2)]
    want = plain(rows, 10)
    assert len(want) > 300
    assert mined(frame, rows, 10) == want
    for name, value in (("CHUNK_ROWS", 16), ("BLOCK_ANCHORS", 7), ("ROUND_BLOCKS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(frame, rows, 10) == want


def test_empty_and_single(frame):
    assert mined(frame, [], 1) == []
    assert mined(frame, [(0, [1.0, 2.0], 1)], 1) == []
    assert mined(frame, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 1) == plain([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 1)


def test_bounds_hold_and_part(frame):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-300, 300, (200, 8)), np.zeros((2, 8), np.int64), np.full((3, 8), 7), -np.full((3, 8), 7)])
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    angles = angles_to(vectors, norms, directions(vectors.astype(float), 6))
    rows = Rows(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), vectors, norms, angles)
    low, high = score_bounds(rows, rows)
    exact = scores(rows, rows)
    assert (low <= exact).all() and (exact <= high).all()
    assert (exact == vectors @ vectors.T).all()
    assert (high < norms[:, None] * norms - 1).mean() > 0.1  # the bounds say more than the norms alone


def test_lists_keep_ties_by_id():
    best = Best(2, 3)
    best.add(np.array([0, 0, 1, 0]), np.array([5, 5, 1, 9]), np.array([8, 2, 4, 7]))
    best.add(np.array([0]), np.array([5]), np.array([1]))
    assert best.scores[0].tolist() == [9, 5, 5] and best.ids[0].tolist() == [7, 1, 2]
    assert best.ids[1, 0] == 4
