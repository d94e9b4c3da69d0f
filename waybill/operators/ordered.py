"""Order-dependent operators that stay distributed when one key holds most of the rows.

Scans along a log run in two levels. The order column is a unique integer, so a chunk of ``width``
consecutive values holds at most ``width`` rows: rows are windowed inside (key, chunk), chunk
totals are carried across chunks in a window over one row per chunk, and the two are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.session import materialize

CHUNK = 1_000_000


def _with_chunk(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def _scan(df: DataFrame, keys: list[str], order: str, value: Column, out: str, fold, merge,
          zero: Column, width: int) -> DataFrame:
    """Running ``fold`` of ``value`` along ``order`` inside each key. ``df`` carries `_chunk`."""
    valued = df.withColumn("_v", value)
    local = (
        Window.partitionBy(*keys, "_chunk").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = valued.groupBy(*keys, "_chunk").agg(fold("_v").alias("_t"))
    carried = totals.select(*keys, "_chunk", F.coalesce(fold("_t").over(across), zero).alias("_c"))
    joined = valued.withColumn("_l", fold("_v").over(local)).join(carried, [*keys, "_chunk"])
    return joined.withColumn(out, merge(F.coalesce(F.col("_l"), zero), F.col("_c"))).drop(
        "_v", "_l", "_c"
    )


def running_count(
    df: DataFrame, keys: list[str], order: str, flag: Column, out: str, width: int = CHUNK
) -> DataFrame:
    """How many rows so far (this one included) satisfy ``flag``."""
    chunked = df if "_chunk" in df.columns else _with_chunk(df, order, width)
    one = F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    done = _scan(chunked, keys, order, one, out, F.sum, lambda a, b: a + b,
                 F.lit(0).cast("bigint"), width)
    return done if "_chunk" in df.columns else done.drop("_chunk")


def running_max(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, start: int = -1,
    width: int = CHUNK,
) -> DataFrame:
    """Largest ``value`` so far, ``start`` before the first one."""
    chunked = df if "_chunk" in df.columns else _with_chunk(df, order, width)
    done = _scan(chunked, keys, order, value.cast("bigint"), out, F.max, F.greatest,
                 F.lit(start).cast("bigint"), width)
    return done if "_chunk" in df.columns else done.drop("_chunk")


def since_last(
    df: DataFrame, keys: list[str], order: str, count: Column, reset: Column, out: str,
    width: int = CHUNK,
) -> DataFrame:
    """Rows satisfying ``count`` since the last row satisfying ``reset``."""
    chunked = _with_chunk(df, order, width)
    counted = running_count(chunked, keys, order, count, "_n", width)
    marked = running_max(counted, keys, order, F.when(reset, F.col("_n")), "_m", 0, width)
    return marked.withColumn(out, F.col("_n") - F.col("_m")).drop("_n", "_m", "_chunk")


def numbered_runs(
    df: DataFrame, keys: list[str], order: str, numbered: Column, out: str = "ordinal",
    width: int = CHUNK,
) -> DataFrame:
    """Ordinal inside each unbroken run of numbered rows; 0 for any other row."""
    done = since_last(df, keys, order, numbered, ~numbered, out, width)
    return done.withColumn(out, F.when(numbered, F.col(out)).otherwise(F.lit(0).cast("bigint")))


def islands(
    df: DataFrame, keys: list[str], order: str, style: list[str], out: str = "island",
    width: int = CHUNK,
) -> DataFrame:
    """Number the runs of neighbouring rows that agree on ``style``."""
    chunked = _with_chunk(df, order, width)
    look = F.struct(*style)
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    last = chunked.groupBy(*keys, "_chunk").agg(F.max_by(look, F.col(order)).alias("_last"))
    before = last.select(
        *keys, "_chunk",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
    )
    seen = (
        chunked.withColumn("_prev", F.lag(look).over(local))
        .withColumn("_first", F.row_number().over(local) == 1)
        .join(before, [*keys, "_chunk"])
    )
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    flagged = seen.withColumn("_new", ~previous.eqNullSafe(look)).drop("_prev", "_first", "_carry")
    return running_count(flagged, keys, order, F.col("_new"), out, width).drop("_new", "_chunk")


def merge_adjacent(
    df: DataFrame, keys: list[str], order: str, style: list[str], text: str, width: int = CHUNK
) -> DataFrame:
    """Join neighbouring text runs of equal style: one row per run, in order."""
    numbered = islands(df, keys, order, style, "island", width)
    runs = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return numbered.groupBy(*keys, "island", *style).agg(F.array_join(runs, "").alias(text))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position in a total order, without gathering the table in one task.

    One range-partitioned sort; the position inside a partition is added to the number of rows in
    the partitions before it. The sorted rows are materialized so both parts see the same split.
    """
    mask = (1 << 33) - 1
    placed = materialize(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(mask)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(
        out, F.col("_start") + F.col("_at") + 1
    ).drop("_part", "_at", "_start")


def first_by(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """First row of each key by ``order``, as a combinable aggregate (no per-key window)."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), order).alias("_first"))
    return picked.select(*keys, "_first.*")


def group_apart(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """An aggregate by ``keys`` that is about to be joined to rows where a key may be hot.

    It groups by the keys as one struct, so its partitioning does not serve the join and the
    planner shuffles its few rows again. Both sides of the join then come straight from a shuffle,
    which is what the adaptive skew join needs to split the hot key over many tasks.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_key")).agg(*aggregates)
    return grouped.select("_key.*", *[c for c in grouped.columns if c != "_key"])


def last_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key. The rank filter is applied before the shuffle as well, so a
    hot key sends at most ``n`` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")
