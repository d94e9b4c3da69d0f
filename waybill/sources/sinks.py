"""Writing plans and exports so that a repeated run changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table several outputs share, written once to the shared folder and read back.

    Unlike a checkpoint the files have a known size, so a small one is broadcast when it is joined.
    """
    home = shared_folder(df.sparkSession, name)
    df.write.parquet(home)
    return df.sparkSession.read.schema(df.schema).parquet(home)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_plan_tables(plan_id: str, tables: dict[str, DataFrame], directory: str) -> bool:
    """Persist a sealed plan as one parquet table each. Returns False when it is there already.

    The manifest is written last: a plan without one is unfinished and is written again.
    """
    first = next(iter(tables.values()))
    spark = first.sparkSession
    home = f"{directory}/{plan_id}"
    if _exists(spark, f"{home}/_manifest/_SUCCESS"):
        return False
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{home}/{name}")
    manifest = spark.createDataFrame([(plan_id, sorted(tables))], "plan_id string, tables array<string>")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{home}/_manifest")
    return True


def export_new_records(planned: DataFrame, exported: DataFrame) -> DataFrame:
    """What an export does with each planned record (key, content): new, same or conflict.

    Contents are compared by hash, so the join carries no text.
    """
    held = exported.select("key", F.xxhash64("content").alias("_x"), F.sha2("content", 256).alias("_h"))
    joined = planned.withColumn("_own", F.sha2("content", 256)).join(held.drop("_x"), "key", "left")
    verdict = (
        F.when(F.col("_h").isNull(), F.lit("new"))
        .when(F.col("_h") == F.col("_own"), F.lit("same")).otherwise(F.lit("conflict"))
    )
    return joined.withColumn("result", verdict).drop("_own", "_h")


def append_new(planned: DataFrame, exported: DataFrame, path: str) -> None:
    """Append only the new records; a repeated run appends nothing."""
    new = export_new_records(planned, exported).where(F.col("result") == "new").drop("result")
    new.write.mode("append").parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    """A report table as one JSON document per line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("errorifexists").text(path)
