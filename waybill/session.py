"""Session defaults and the two lineage helpers the iterative operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "waybill") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a local one only on a single-machine session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="waybill-checkpoint-"))


def config_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of configuration as a relation whose size the optimizer knows, so joins with it
    are broadcast without a hint."""
    kinds = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over all cores before heavy per-row work, when it comes in fewer splits.

    A table of any size has more splits than the cluster has cores and is returned as it is; only
    a small one (one file, one row group) gains the extra exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    Used where two branches must see the very same rows (partition numbers, loop state), so a lost
    executor re-reads files instead of recomputing a different answer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
