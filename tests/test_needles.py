from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from waybill.functions import secrets
from waybill.operators import quality
from waybill.operators.needles import needle_scan

WANTED = "needle string, what string, word boolean"


def plain(rows, wanted):
    out = set()
    for key, text in rows:
        for needle, what, word in wanted:
            if not needle or text is None:
                continue
            for m in re.finditer(f"(?={re.escape(needle)})", text):
                near = text[max(0, m.start() - 1) : m.start()] + text[m.start() + len(needle) :][:1]
                if not word or not any(c.isascii() and c.isalnum() for c in near):
                    out.add((key, "text", what or ""))
    return out


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_equals_every_needle_by_itself(spark, block):
    """Needles within needles, at both ends, beside letters of other scripts; the same for any cut into blocks."""
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ab é-1") for _ in range(n))
    rows = [(k, draw(rng.randrange(30))) for k in range(200)] + [(200, None), (201, ""), (202, "a" * 50_000), (3, "ab"), (3, "ab")]
    wanted = [(draw(rng.randrange(1, 4)), f"w{k % 7}", k % 2 == 0) for k in range(30)]
    wanted += [("", "empty", False), ("ab", "w0", True), ("ab", "w1", None), ("a", None, True), (None, "x", True)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = needle_scan(df, ["id"], spark.createDataFrame(wanted, WANTED), block)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows, [w for w in wanted if w[0]])


def test_ten_thousand_needles_in_one_pass(spark):
    wanted = spark.range(10_000).select(
        F.concat(F.lit("person-"), "id").alias("needle"), F.concat(F.lit("p"), F.col("id") % 10).alias("what"), F.lit(True).alias("word")
    )
    docs = spark.range(500).select("id", F.concat(F.lit("by person-"), F.col("id") * 40, F.lit(".")).alias("text"), F.lit(None).cast("string").alias("more"))
    got = needle_scan(docs, ["id"], wanted)
    assert got._jdf.queryExecution().toString().count("MapInArrow") == 4  # one in each of four plans
    assert sorted((r.id, r.path, r.leak) for r in got.collect()) == [(k, "text", "p0") for k in range(250)]


def test_nothing_to_look_for_or_in(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    none = spark.createDataFrame([], WANTED)
    assert needle_scan(docs, ["id"], none).collect() == []
    one = spark.createDataFrame([("a", "x", False)], WANTED)
    assert needle_scan(docs.limit(0), ["id"], one).collect() == []
    assert needle_scan(docs.select("id"), ["id"], one).columns == ["id", "path", "leak"]


def test_machine_paths(spark):
    texts = {
        "see /Users/x": "an absolute /Users path", r"C:\x": "a Windows drive path", r"\\host\share": "a Windows UNC path",
        "/tmp/a": "an absolute /tmp path", "/root": "an absolute /root path", "File://x": "a file: URL", "~/x": "a home-relative path",
    }
    clean = ["x/tmp/a", "/rooted", r"\host\x", "a~/x", "/homes", "profile:/x", ""]
    rows = [(t,) for t in [*texts, *clean]]
    df = spark.createDataFrame(rows, "text string").withColumn("id", F.col("text"))
    got = {(r.id, r.leak) for r in quality.leak_scan(df, ["id"], rules=secrets.MACHINE_PATHS).collect()}
    assert got == set(texts.items())
