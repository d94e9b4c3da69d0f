"""Facts about the destination: lists with their paths, options of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPTION = "array<struct<id:string,name:string,label:string,orderindex:string>>"


def target_paths(lists: DataFrame, folders: DataFrame, spaces: DataFrame, workspace: str) -> DataFrame:
    """Each list with its full path; hidden folders and blank parts are left out.

    lists: id, name, folder_id, space_id. folders: id, name, hidden. spaces: id, name.
    """
    shown = folders.select(
        F.col("id").alias("folder_id"), F.when(~F.coalesce("hidden", F.lit(False)), F.col("name")).alias("_folder")
    )
    homes = spaces.select(F.col("id").alias("space_id"), F.col("name").alias("_space"))
    joined = lists.join(shown, "folder_id", "left").join(homes, "space_id", "left")
    parts = F.array(F.lit(workspace), "_space", "_folder", "name")
    return joined.select(
        "id", "name", F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " / ").alias("path")
    )


def field_options(fields: DataFrame) -> DataFrame:
    """Selectable options of each field from its JSON configuration.

    An option needs an id and a name (or label); its order index is a number or nothing.
    """
    options = F.from_json(F.get_json_object("config", "$.options"), OPTION)
    exploded = fields.select("field_id", F.posexplode(options).alias("pos", "o"))
    name = F.coalesce("o.name", "o.label")
    return exploded.where(F.col("o.id").isNotNull() & name.isNotNull()).select(
        "field_id", "pos", F.col("o.id").alias("option_id"), name.alias("name"),
        F.col("o.orderindex").try_cast("double").alias("orderindex"),
    )


def unreachable_targets(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """Configured lists that cannot be reached: blocking findings. lists: id, forbidden."""
    joined = wanted.join(lists.select(F.col("id").alias("list_id"), F.coalesce("forbidden", F.lit(False)).alias("_no")), "list_id", "left")
    return joined.where(F.col("_no").isNull() | F.col("_no")).select(
        "list_id",
        F.when(F.col("_no"), F.lit("DEST_LIST_FORBIDDEN")).otherwise(F.lit("DEST_LIST_NOT_FOUND")).alias("code"),
        F.lit("error").alias("severity"),
    )
