"""Running a stream over what is there and handing its result back as a table.

Results go to files in the shared folder, batch by batch; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.sources.sinks import shared_folder
from waybill.streaming.runlog import LATENESS, activity_slices, breaker_alarms, breaker_marks, bursts_of_slices, first_mappings


def read_table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A parquet table as a stream, with the schema its own files declare.

    ``maxFilesPerTrigger`` bounds a micro-batch, and with it what a stateful operator holds.
    """
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.option("maxFilesPerTrigger", 64).parquet(directory)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream over all available input, read back as a table."""
    spark = stream.sparkSession
    home = shared_folder(spark, f"stream-{name}")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def drain_changes(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Update- or complete-mode stream: every batch of changed rows is kept as written, and the
    result is the last version of each key."""
    spark = stream.sparkSession
    home = shared_folder(spark, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/part={number}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.parquet(f"{home}/out")
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return last.select(*keys, "_row.*")


def drain_breaker(events: DataFrame, name: str, limit: int) -> DataFrame:
    """Alarms of the failure breaker over all that a stream of events holds."""
    return breaker_alarms(drain_changes(breaker_marks(events), name, ["run_id", "stretch"]), limit)


def drain_bursts(events: DataFrame, name: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Closed bursts of activity of the runs over all that a stream of events holds."""
    slices = drain_changes(activity_slices(events, gap, lateness), name, ["run_id", "slice"])
    return bursts_of_slices(slices, gap, lateness)


ID_MAP = "source_key string, scope string, destination_id string"


def drain_id_map(mappings: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The id map that a stream of mappings (source_key, scope, destination_id, ts) builds, and the conflicts.

    Each batch is compared with the map as stored by the batches before it, so a key that comes again keeps its
    destination however much later that is. A batch that is run again replaces what it wrote.
    """
    spark = mappings.sparkSession
    home = shared_folder(spark, f"stream-{name}")

    def held(before: int) -> DataFrame:
        parts = [f"{home}/map/part={n}" for n in range(before)]
        return spark.read.schema(ID_MAP).parquet(*parts) if parts else spark.createDataFrame([], ID_MAP)

    def keep(batch: DataFrame, number: int) -> None:
        new, conflicts = first_mappings(batch, held(number))
        new.select("source_key", "scope", "destination_id").write.mode("overwrite").parquet(f"{home}/map/part={number}")
        conflicts.write.mode("overwrite").parquet(f"{home}/conflicts/part={number}")

    query = mappings.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    built = spark.read.parquet(f"{home}/map").drop("part")
    return built, spark.read.parquet(f"{home}/conflicts").drop("part")
