"""Reading snapshots and raw items with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.text import wide_trim
from waybill.schemas import SCHEMAS


def scan_snapshot(
    spark: SparkSession, directory: str, fmt: str = "parquet", tables: list[str] | None = None
) -> dict[str, DataFrame]:
    """One DataFrame per snapshot table under ``directory``, read with its declared schema.

    Filters and column choice on the result reach a parquet scan.
    """
    names = tables or list(SCHEMAS)
    return {n: spark.read.schema(SCHEMAS[n]).format(fmt).load(f"{directory}/{n}") for n in names}


def scan_json_items(
    spark: SparkSession, path: str, item_schema: str, defaults: dict[str, object] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """JSON documents holding an ``items`` array, one row per item, absent members defaulted."""
    schema = f"title string, items array<struct<{item_schema}>>"
    documents = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    items = documents.select(F.coalesce("title", F.lit("Tasks")).alias("list_title"), F.inline("items"))
    filled = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in (defaults or {}).items()}
    return items.withColumns(filled) if filled else items


def item_records(items: DataFrame, system: str, unsupported: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of JSON items, and a finding for each value this source cannot carry."""
    key = F.concat(F.lit(f"{system}:item:"), F.col("id").cast("string"))
    records = items.select(
        key.alias("key"), F.lit(f"{system}:collection:tasks").alias("collection"), "title", "done", "notes"
    )
    fields = F.array_compact(F.array(*[F.when(F.col(u).isNotNull(), F.lit(u)) for u in unsupported]))
    findings = items.select(
        F.lit("ATTACHMENT_NOT_SUPPORTED").alias("code"), F.lit("unsupported").alias("outcome"),
        key.alias("entity"), F.explode(fields).alias("field"),
    )
    return records, findings


def lenient_parse(df: DataFrame, column: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parse each item; rows that do not parse or lack a required member go to quarantine.

    Extra members are ignored and one bad item never loses the others.
    """
    full = f"{schema}, _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_item", F.from_json(column, full, options))
    good = F.col("_item").isNotNull() & F.col("_item._corrupt").isNull()
    for name in required:
        good = good & F.col(f"_item.{name}").isNotNull()
    others = [c for c in df.columns if c != column]
    names = [part.strip().split()[0] for part in schema.split(",")]
    kept = parsed.where(good).select(*others, *[F.col(f"_item.{n}").alias(n) for n in names])
    return kept, parsed.where(~good).select(*df.columns)


def skipped_non_rows(df: DataFrame, collection: str, good: Column) -> DataFrame:
    """Results that are not rows, counted per collection; only collections that have any."""
    counted = df.groupBy(F.col(collection).alias("collection")).agg(
        F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped")
    )
    return counted.where(F.col("skipped") > 0).withColumn("code", F.lit("SOURCE_NON_PAGE_RESULTS_SKIPPED"))


def incremental_windowed_read(windows: list[DataFrame], key: str) -> DataFrame:
    """Overlapping windows of one table put together: each key once, as last seen.

    The last sighting is found by a combinable aggregate, not by a window per key.
    """
    tagged = [w.withColumn("_window", F.lit(i)) for i, w in enumerate(windows)]
    together = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in windows[0].columns if c != key]
    last = together.groupBy(key).agg(F.max_by(F.struct(*rest), "_window").alias("_row"))
    return last.select(key, "_row.*")


def resolve_container_ids(wanted: DataFrame, sources: DataFrame, databases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configured ids to data sources: an id is one, or a database standing for all of its own.

    wanted: pos, id. sources: id, name. databases: database_id, source_id. Returns the distinct
    data sources and the ids that are neither.
    """
    direct = sources.select(F.col("id"), F.col("id").alias("source_id"))
    members = databases.select(F.col("database_id").alias("id"), F.col("source_id").alias("member_id"))
    joined = (
        wanted.join(direct, "id", "left").join(members, "id", "left")
        .withColumn("resolved", F.coalesce("source_id", "member_id"))
    )
    found = joined.where(F.col("resolved").isNotNull())
    first = found.groupBy("resolved").agg(F.min("pos").alias("pos"))
    named = first.join(sources.withColumnRenamed("id", "resolved"), "resolved")
    unknown = joined.where(F.col("resolved").isNull()).select("pos", "id", F.lit("SOURCE_NOT_ACCESSIBLE").alias("code"))
    return named, unknown


def discover_catalog(levels: list[DataFrame]) -> DataFrame:
    """Reachable containers of every level (kind, id, name, path, trashed, in_database), without
    trashed ones and without rows of databases, in catalogue order."""
    together = reduce(DataFrame.unionByName, levels)
    kept = together.where(
        ~F.coalesce("trashed", F.lit(False)) & ~F.coalesce("in_database", F.lit(False))
    ).drop("trashed", "in_database")
    name = wide_trim(F.coalesce("name", F.lit("")))
    shown = F.when(name == "", F.lit("Untitled")).otherwise(name)
    return kept.withColumn("name", shown).orderBy("kind", "name", "id")
