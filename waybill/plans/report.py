"""Report tables, their JSON export and the redacted version that is safe to share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.ids import hash_id, hash_key, hash_tag


def report_items(actions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Each action with its status, outcome, destination and error."""
    held = checkpoints.select(
        F.col("action_id").alias("id"), F.col("status").alias("_status"),
        F.col("destination_id").alias("_dest"), "last_error_code", "last_error_message",
    )
    joined = actions.join(held, "id", "left")
    default = F.when(F.col("disposition") == "skip", F.lit("skipped")).otherwise(F.lit("pending"))
    status = F.coalesce("_status", default)
    error = F.when(
        F.col("last_error_code").isNotNull(), F.concat_ws(": ", "last_error_code", "last_error_message")
    )
    return joined.select(
        F.col("id").alias("action_id"), "seq", "label", "source", status.alias("status"),
        F.when(status.isin("failed", "blocked"), F.lit("failed")).otherwise(F.col("outcome")).alias("outcome"),
        F.coalesce("_dest", "existing_destination_id").alias("destination_id"), error.alias("error"),
    )


def plan_mappings_only(id_map: DataFrame, actions: DataFrame) -> DataFrame:
    """Id-map rows that belong to this plan."""
    wanted = actions.select("scope", F.col("idempotency_key").alias("source_key"))
    return id_map.join(wanted, ["scope", "source_key"], "left_semi")


def redact_items(items: DataFrame, salt: str = "") -> DataFrame:
    """Titles and ids become hashes, errors keep only their code."""
    return items.select(
        "action_id", hash_tag("item", F.col("action_id"), salt).alias("label"),
        hash_key(F.col("source"), salt).alias("source"), "status", "outcome",
        hash_id("dst", F.col("destination_id"), salt).alias("destination_id"),
        F.substring_index("error", ":", 1).alias("error"),
    )


def redact_verification(items: DataFrame, salt: str = "") -> DataFrame:
    """Checks keep only field and status; expected, actual and note are dropped."""
    bare = F.transform("checks", lambda c: c.dropFields("expected", "actual", "note"))
    return items.withColumns(
        {
            "source": hash_key(F.col("source"), salt),
            "destination_id": hash_id("dst", F.col("destination_id"), salt),
            "checks": bare,
        }
    )


def report_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row of a small report table."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json"))
