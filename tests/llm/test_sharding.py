from __future__ import annotations

import hashlib

import pytest

from waybill.llm import sharding
from waybill.llm.sharding import assign_shards, write_shards


def brute(rows, limit):
    """doc_id -> its bucket: split every bucket that is too large on the next bit."""
    sized = [(int(hashlib.md5(("\x00null" if i is None else str(i)).encode()).hexdigest()[:8], 16), len((t or "").encode()), i) for i, t in rows]
    out = {}

    def place(held, depth, prefix):
        total = sum(s for _, s, _ in held)
        if total <= limit or depth == 32:
            for _, _, i in held:
                out[i] = (depth, prefix, len(held), total)
            return
        for bit in (0, 1):
            part = [x for x in held if x[0] >> (31 - depth) & 1 == bit]
            if part:
                place(part, depth + 1, 2 * prefix + bit)

    if sized:
        place(sized, 0, 0)
    return out


@pytest.mark.parametrize(("limit", "step"), [(10_000, 12), (300, 12), (300, 2), (20, 3)])
def test_agrees_with_brute_force(frame, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP", step)
    rows = [(i, "x" * (i * 37 % 90)) for i in range(150)] + [(500, None), (501, ""), (502, "é" * 400), (None, "null key"), (7, "again")] + [(9, "z" * 30)] * 8
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, depth int")
    got = assign_shards(docs, limit).collect()
    want = brute(rows, limit)
    assert len(got) == len(rows)
    for r in got:
        assert (r.depth, r.prefix, r.shard_rows, r.shard_bytes) == want[r.doc_id]
        assert len(r.shard) == r.depth and int(r.shard or "0", 2) == r.prefix and r.oversized == (r.shard_bytes > limit)
    assert all(r.depth == 32 for r in got if r.oversized)


def test_empty_table_and_written_shards(spark, frame, tmp_path):
    assert assign_shards(frame([], "doc_id long, text string"), 10).count() == 0
    docs = frame([(i, "word " * 5) for i in range(40)], "doc_id long, text string")
    buckets = write_shards(docs, 200, str(tmp_path / "shards")).collect()
    back = spark.read.option("inferSchema", "false").parquet(str(tmp_path / "shards"))
    assert back.count() == 40 and back.select("shard").distinct().count() == len(buckets)
