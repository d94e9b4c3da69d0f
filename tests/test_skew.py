"""A key that holds a third of all rows: joins split it, and results stay the same."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from waybill.operators import documents as docs, findings as fnd, mapping as mp, relations as rel, state
from waybill.operators import verify as vf
from waybill.sources.sinks import shared_folder

ROWS = 200_000


@contextlib.contextmanager
def big_cluster_settings(spark):
    """Treat these small tables as too big to broadcast and a few hundred kB as a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(column: str, every: int = 5_000):
    """A key that is the same for a third of the rows and spread over the rest."""
    return F.when(F.col(column) % 3 == 0, F.lit(-1)).otherwise(F.col(column) % every)


@pytest.fixture(scope="module")
def numbers(spark):
    """Written once with several files, so scans have several tasks."""
    home = shared_folder(spark, "numbers")
    spark.range(0, ROWS, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("pad")).write.parquet(home)
    return spark.read.parquet(home)


def skew_was_split(df) -> bool:
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(rows) and "skew=true" in plan


def test_fold_splits_a_hot_action(spark, numbers):
    moves = numbers.select(
        F.lit("r").alias("run_id"), hot("id").cast("string").alias("action_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, F.lit("failed")).otherwise(F.lit("in_flight")).alias("event"),
        F.lit(None).cast("string").alias("destination_id"), F.col("pad").alias("error_code"), F.col("id").alias("ts"),
    )
    want = state.fold_checkpoints(moves).where("action_id = '-1'").select("status", "attempts").first()
    assert want.attempts == sum(1 for i in range(0, ROWS, 3) if i % 7)
    with big_cluster_settings(spark):
        folded = state.fold_checkpoints(moves)
        assert skew_was_split(folded)
        assert folded.where("action_id = '-1'").select("status", "attempts").first() == want


def test_routing_splits_a_hot_entity(spark, numbers):
    found = numbers.select(
        F.col("id").alias("seq"), F.lit("C").alias("code"), F.lit("lossy").alias("outcome"), hot("id").cast("string").alias("entity"), F.col("pad").alias("message")
    )
    actions = numbers.where("id < 5000 or id = 5000").select(
        F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("seq"),
        F.when(F.col("id") == 5000, F.lit("-1")).otherwise(F.col("id").cast("string")).alias("source"),
    )
    with big_cluster_settings(spark):
        routed = fnd.route_findings(found, actions)
        assert skew_was_split(routed)
        assert routed.where("owner = 'a5000'").count() == len(range(0, ROWS, 3))
        assert routed.where("owner is null").count() == 0


def test_reconcile_reduces_a_hot_name_before_the_join(spark, numbers):
    candidates = numbers.select(F.lit("t").alias("target"), hot("id").cast("string").alias("match_key"), F.col("pad").alias("item_id"), F.col("id").alias("created_ms"))
    attempts = numbers.select(F.col("id").alias("action_id"), F.lit("t").alias("target"), hot("id").cast("string").alias("match_key"), (F.col("id") + 60_000).alias("since_ms"), "pad")
    with big_cluster_settings(spark):
        verdicts = vf.reconcile_matches(attempts, candidates)
        assert skew_was_split(verdicts)
        assert verdicts.count() == ROWS
        by = dict(verdicts.where("action_id % 3 = 0").groupBy("status").count().collect())
    # The latest two hot items decide: ids 199998 and 199995.
    assert by == {"undecidable": len(range(0, 199_996, 3)), "found": 1}


def test_values_of_one_option_do_not_shuffle(spark, numbers):
    """A third of all cells hold one text: the lookup is by distinct text and small enough to send."""
    cells = numbers.select("id", F.concat(F.lit("n"), hot("id", 50)).alias("v"))
    names = spark.range(40).select(F.lit(0).alias("pos"), F.concat(F.lit("N"), "id").alias("name"))
    none = spark.createDataFrame([], "pos int, `from` string, `to` string")
    done = mp.value_map_join(cells, "v", none, names)
    assert done.where("target is null and v = 'n-1'").count() == len(range(0, ROWS, 3))
    done.collect()
    assert "BroadcastHashJoin" in done._jdf.queryExecution().executedPlan().toString()


def test_a_page_with_a_third_of_all_blocks_is_cut_before_the_shuffle(spark, numbers):
    blocks = numbers.select(hot("id").cast("string").alias("doc"), F.array(F.col("id").cast("int")).alias("path"), "pad")
    kept = docs.block_budget(blocks, 10)
    assert kept.where("doc = '-1'").count() == 10
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert docs.over_budget(blocks, 50).where("doc = '-1'").first().blocks == len(range(0, ROWS, 3))


def test_pairs_are_not_formed_inside_a_group(spark, numbers):
    edges = numbers.select(hot("id").alias("from_id"), (F.col("id") % 100).alias("to_id"))
    planned = spark.range(-1, 5_000).select("id")
    with big_cluster_settings(spark):
        pairs = rel.link_pairs(edges, planned)
        assert pairs.count() == pairs.distinct().count()
        assert pairs.where("a = -1").count() == 100
