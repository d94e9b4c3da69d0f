"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# What Spark sends to a Python worker at once; a batch stands several times in an executor's memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "6m"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="waybill-llm-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once and read it back, so that later steps and lost executors do not compute it again."""
    spark = frame.sparkSession
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def bounded_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of a few megabytes, not of thousands of texts, unless the session has its own bound."""
    if not spark.conf.get(BATCH_SETTING, None):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
