"""Counts in a table of fixed size, gathered over all rows: what reaches the driver does not grow with the data."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64
SCHEMA = "block int, counts binary"
ARROW = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def rows_of(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """A table of counts as one compressed row per block; blocks of zeros are left out."""
    parts = counts.reshape(BLOCKS, -1)
    return [(b, zlib.compress(parts[b].astype("<u4").tobytes(), 1)) for b in range(BLOCKS) if parts[b].any()]


def add_up(partial: DataFrame, bits: int) -> np.ndarray:
    """The sum of all partial tables (block, counts): one row per block and task reaches the driver.

    Each task streams over the rows of its blocks and holds one sum per block, however many tasks there were before. A
    sum of 2^32 or more stays at 2^32 - 1; counts only order shingles and bound lists, where any larger number says the
    same.
    """
    width = (1 << bits) // BLOCKS

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_py()), "<u4")
                if block in held:
                    held[block] += part
                else:
                    held[block] = part.astype(np.uint64)
        if held:
            blobs = [zlib.compress(np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], schema=ARROW)

    rows = partial.repartition("block").mapInArrow(combine, SCHEMA)
    total = np.zeros((BLOCKS, width), np.uint64)
    for row in rows.toLocalIterator():
        total[row.block] += np.frombuffer(zlib.decompress(bytes(row.counts)), "<u4")
    return total.reshape(-1)
