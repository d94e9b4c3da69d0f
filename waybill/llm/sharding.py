"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored

# Bits that the directory starts from, bits that it gains at a time, and bits of the key's hash.
STEP = 12
KEY_BITS = 32


def key_bits(key: Column) -> Column:
    """The first 32 bits of the key's MD5 as a number; null is a key of its own."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column) -> Column:
    return F.call_function("shiftright", bits, (F.lit(KEY_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(depth, prefix, shard_rows, shard_bytes): the buckets, each the first on its path that fits ``limit_bytes``.

    ``rows`` has bits (0 .. 2^32 - 1) and bytes. Sizes are counted for ``STEP`` bits at a time, and only for rows below
    buckets that are still too large; sums are combined before they are shuffled, so a hot prefix is one row per task.
    A bucket that is too large with all bits used stays as it is: it holds one key, or keys of equal hash.
    """
    found = None
    cells, base = rows.select("bits", "bytes"), -1
    while True:
        top = min(KEY_BITS, base + STEP)
        bits = cells.groupBy(_prefix(F.col("bits"), F.lit(top)).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n")
        )
        bits = stored(bits, "cells")
        depths = F.explode(F.sequence(F.lit(base + 1), F.lit(top)))
        levels = bits.withColumn("depth", depths).withColumn(
            "prefix", F.call_function("shiftright", "cell", (F.lit(top) - F.col("depth")).cast("int"))
        )
        sizes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sizes = sizes.withColumn("fits", (F.col("shard_bytes") <= limit_bytes) | (F.col("depth") == KEY_BITS))
        sizes = stored(sizes, "sizes")
        # A bucket is a leaf if it fits and its parent does not (the root has none, and parents above split already).
        parents = sizes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = sizes.where("fits").withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1)))
        first = fitting.where(F.col("depth") == base + 1)
        below = fitting.where(F.col("depth") > base + 1).join(parents, ["depth", "parent"], "left_semi")
        columns = ["depth", "prefix", "shard_rows", "shard_bytes"]
        leaves = first.select(columns).unionByName(below.select(columns))
        found = leaves if found is None else found.unionByName(leaves)
        large = sizes.where((F.col("depth") == top) & ~F.col("fits")).select(F.col("prefix").alias("cell"))
        if top == KEY_BITS or large.isEmpty():
            return stored(found, "directory")
        cells = cells.withColumn("cell", _prefix(F.col("bits"), F.lit(top))).join(stored(large, "large"), "cell", "left_semi")
        cells, base = cells.select("bits", "bytes"), top


def assign_shards(docs: DataFrame, limit_bytes: int, key: str = "doc_id") -> DataFrame:
    """Per document: the key, bytes, depth, prefix, shard, shard_rows, shard_bytes, oversized.

    ``bytes`` is the size of the UTF-8 text (null: 0). ``shard`` names the bucket by its ``depth`` bits ("" is the only
    bucket of a table that fits as a whole). A shard is oversized only if it has one key, or equal hashes: such rows,
    repeats of one id among them, cannot be told apart by the key, and none of them is dropped or moved. Every input
    row gives one row; columns besides the key and text are not read.
    """
    rows = docs.select(
        F.col(key).alias("_key"),
        key_bits(F.col(key)).alias("bits"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )
    buckets = directory(rows, limit_bytes)
    depths = [r.depth for r in buckets.select("depth").distinct().orderBy("depth").collect()]
    # A row is in one bucket only, so one of these (at most 33) pairs has a partner.
    probes = F.array(*[
        F.struct(F.lit(d).alias("depth"), _prefix(F.col("bits"), F.lit(d)).alias("prefix")) for d in depths
    ]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    probed = rows.withColumn("_probe", F.explode(probes)).select("_key", "bytes", "_probe.depth", "_probe.prefix")
    placed = probed.join(buckets, ["depth", "prefix"])
    shard = F.expr("right(lpad(bin(prefix), 32, '0'), depth)")
    return placed.select(
        F.col("_key").alias(key), "bytes", "depth", "prefix", shard.alias("shard"), "shard_rows", "shard_bytes",
        (F.col("shard_bytes") > limit_bytes).alias("oversized"),
    )


def write_shards(docs: DataFrame, limit_bytes: int, path: str, key: str = "doc_id") -> DataFrame:
    """Write ``docs`` below ``path``, one folder per shard, and return the directory.

    Rows of a shard go to the tasks by their shard, whose size the limit bounds.
    """
    rows = docs.withColumn("_bits", key_bits(F.col(key)))
    sized = rows.select(F.col("_bits").alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    buckets = directory(sized, limit_bytes)
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]
    probes = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("_bits"), F.lit(d)).alias("prefix")) for d in depths])
    # A letter in front keeps the bits of a folder's name from being read as a number.
    name = F.expr("concat('s', right(lpad(bin(prefix), 32, '0'), depth))")
    named = buckets.select(F.struct("depth", "prefix").alias("_probe"), name.alias("shard"))
    placed = rows.withColumn("_probe", F.explode(probes)).join(named, "_probe").drop("_probe", "_bits")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    return buckets
