"""Content hash of a plan: independent of time, of row order and of how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.plans.summary import one_row


def _fold(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(hashes), ""), 256)


def table_hash(table: DataFrame, row_json: Column, name: str, digits: int = 3) -> DataFrame:
    """One row (name, hash) for a table.

    Each row is hashed from its canonical JSON. Equal rows are counted first, so hot duplicates
    collapse; distinct row hashes are spread evenly over 16^(2*digits) buckets by their leading
    digits, each bucket is hashed in sorted order, bucket hashes are folded by their first digits
    and those once more. No step gathers more than one bucket. Hashes travel as bytes, and to where
    their first digits meet, so that buckets and their folds take one shuffle.
    """
    rows = table.select(F.unhex(F.sha2(row_json, 256)).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    text = F.lower(F.hex("_h"))
    near = rows.repartition(F.substring(text, 1, digits)).select(
        F.substring(text, 1, digits).alias("_m"), F.substring(text, 1, 2 * digits).alias("_b"),
        F.concat(text, F.lit("x"), F.col("_n").cast("string")).alias("_marked"),
    )
    low = near.groupBy("_m", "_b").agg(_fold(F.collect_list("_marked")).alias("_h"))
    mid = low.groupBy(F.col("_m").alias("_b")).agg(_fold(F.collect_list(F.concat("_b", F.lit(":"), "_h"))).alias("_h"))
    top = mid.agg(_fold(F.collect_list(F.concat("_b", F.lit(":"), "_h"))).alias("hash"))
    return top.select(F.lit(name).alias("table"), "hash")


def seal_plan(tables: list[DataFrame]) -> DataFrame:
    """Plan hash and id from the hashes of its tables (rows of ``table_hash``)."""
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.unionByName(other)
    # One row per table of the plan.
    text = F.concat("table", F.lit("="), "hash")
    sealed = rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("hash"))
    return sealed.select(F.concat(F.lit("plan_"), F.substring("hash", 1, 12)).alias("plan_id"), "hash")


def verify_integrity(recorded: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Recompute the seal and compare it with the recorded plan_id and hash."""
    actual = seal_plan(tables).select(F.col("hash").alias("actual_hash"))
    joined = one_row(recorded.select("plan_id", "hash"), actual)
    hash_ok = F.col("hash") == F.col("actual_hash")
    id_ok = F.col("plan_id") == F.concat(F.lit("plan_"), F.substring("hash", 1, 12))
    return joined.select("plan_id", hash_ok.alias("hash_ok"), id_ok.alias("id_ok"), (hash_ok & id_ok).alias("intact"))
