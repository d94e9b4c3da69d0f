"""Repeated passages of all texts, found in suffix arrays of the stretches that may repeat.

A passage of ``length`` bytes that occurs twice holds short runs of bytes that occur twice; so hashes of such runs, the
smallest of each neighbourhood, are counted over all texts, and only stretches without a run that occurs once go on. They
are cut into fragments by the smallest hash inside each passage, so that equal passages meet in one task whatever stands
around them. There, suffixes are sorted in two stages, and common prefixes of neighbours decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored
from waybill.llm.two_stage import repeated_places

LENGTH = 200
BLOCK_BYTES = 2 << 20
PIECE_BYTES = 1 << 19  # bytes that are hashed at once
SHARD_BYTES = 2 << 20  # bytes of fragments of several routes that are sorted at once
HOT_BYTES = 8 << 20  # bytes of different fragments of one route that are sorted at once; a route of more is split
FRAGMENT_IDS = 1 << 20  # fragments whose bytes a task remembers to have written

BASE = 0x9E3779B97F4A7C15
LONGS = pa.int64()


class Hasher:
    """Hashes of all runs of ``width`` bytes: a polynomial modulo 2^64, then mixed."""

    def __init__(self, width: int, most: int):
        self.width = width
        inverse = BASE
        for _ in range(6):
            inverse = inverse * (2 - BASE * inverse) % (1 << 64)
        self.powers, self.inverses = self._powers(BASE, most + 1), self._powers(inverse, most + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, power = 1, base
        while done < n:
            some = min(done, n - done)
            out[done : done + some] = out[:some] * np.uint64(power)
            done, power = done + some, power * power % (1 << 64)
        return out

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[self.width :] - sums[: -self.width]) * self.inverses[:n]
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ h >> np.uint64(32)


def sliding(best: np.ufunc, values: np.ndarray, width: int, least) -> np.ndarray:
    """``best`` over each ``width`` neighbouring values, from running values within cells of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    cells = np.full(-(-n // width) * width, least, values.dtype)
    cells[:n] = values
    cells = cells.reshape(-1, width)
    ahead = best.accumulate(cells, axis=1).ravel()
    behind = best.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


class Windows:
    """What is computed for windows of ``length`` bytes: anchors that tell whether they may repeat, and their routes."""

    def __init__(self, length: int):
        if length < 16:
            raise ValueError("passages of fewer than 16 bytes are not searched for")
        self.length = length
        self.anchor = Hasher(max(4, length // 3), PIECE_BYTES + length)
        self.near = length // 2  # neighbouring runs of which the smallest is an anchor
        self.reach = self.near + self.anchor.width - 1  # bytes of such a neighbourhood
        self.route = Hasher(max(4, length // 6), PIECE_BYTES + length)

    def starts(self, ends: np.ndarray, size: int, need: int) -> np.ndarray:
        """Places with ``need`` bytes of their text ahead, in texts with at least one window."""
        good = np.ones(size, bool)
        begin = 0
        for end in ends.tolist():
            good[max(begin, end - need + 1) if end - begin >= self.length else begin : end] = False
            begin = end
        return good

    def neighbourhoods(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per piece: where it begins, the run hashes, and the smallest of each neighbourhood (0 for those across texts)."""
        good = self.starts(ends, len(flat), self.reach)
        for begin in range(0, len(flat), PIECE_BYTES):
            piece = flat[begin : begin + PIECE_BYTES + self.length]
            hashes = self.anchor(piece)
            smallest = sliding(np.minimum, hashes, self.near, np.uint64(2**64 - 1))
            if len(smallest):
                yield begin, hashes, np.where(good[begin : begin + len(smallest)], smallest, np.uint64(0))

    def anchors(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, and which of them occur at several places."""
        places, found = [], []
        edge = np.zeros(self.near - 1, np.uint64)
        for begin, hashes, smallest in self.neighbourhoods(flat, ends):
            largest = sliding(np.maximum, np.concatenate([edge, smallest, edge]), self.near, np.uint64(0))
            at = np.flatnonzero((largest == hashes) & (hashes > 0))
            places.append(at + begin)
            found.append(hashes[at])
        if not places:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        _, first = np.unique(np.concatenate(places), return_index=True)  # pieces overlap
        values, counts = np.unique(np.concatenate(found)[first], return_counts=True)
        return values, counts > 1

    def fragments(self, flat: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, windows, route) of stretches of windows whose anchors all are in ``repeated`` (sorted), by route."""
        good = self.starts(ends, len(flat), self.length)
        spare = self.length - self.reach  # a window holds the neighbourhoods that start at its first spare + 1 bytes
        for begin, _, smallest in self.neighbourhoods(flat, ends):
            at = np.minimum(np.searchsorted(repeated, smallest), max(0, len(repeated) - 1))
            lone = np.cumsum(np.concatenate([[0], repeated[at] != smallest])) if len(repeated) else np.arange(len(smallest) + 1)
            n = min(PIECE_BYTES, len(smallest) - spare)
            if n <= 0:
                continue
            may = (lone[spare + 1 : spare + 1 + n] == lone[:n]) & good[begin : begin + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], may.view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                stretch = flat[begin + a : begin + b - 1 + self.length]
                keys = sliding(np.minimum, self.route(stretch), self.length - self.route.width + 1, np.uint64(2**64 - 1))
                turns = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
                for x, y in zip(turns, [*turns[1:], len(keys)], strict=True):
                    yield begin + a + x, y - x, int(keys[x].view(np.int64))


def _batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Whole texts, each once per block, compressed: block, blob, ends, docs (doc_id and number of the text)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = TaskContext.get().partitionId() << 32
        texts: dict[bytes, int] = {}
        owners, size, kind = [], 0, None

        def block() -> pa.RecordBatch:
            flat = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            rows = pa.array([[{"doc_id": k, "text": t} for k, t in owners]], pa.list_(pa.struct([("doc_id", kind), ("text", pa.int32())])))
            arrays = [pa.array([begin], LONGS), pa.array([pa.compress(flat, "zstd", asbytes=True)], pa.binary()), pa.array([ends.tobytes()], pa.binary()), rows]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "blob", "ends", "docs"])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1), strict=True):
                text = text.as_py() or b""
                if text not in texts:
                    texts[text] = len(texts)
                    size += len(text) + 64
                owners.append((key, texts[text]))
                if size >= BLOCK_BYTES or len(owners) >= 100_000:
                    yield block()
                    begin, texts, owners, size = begin + 1, {}, [], 0
        if owners:
            yield block()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(pack, f"block long, blob binary, ends binary, docs array<struct<doc_id:{key},text:int>>")


def opened(blob: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(ends, np.int64)
    size = int(places[-1]) if len(places) else 0
    return np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True) if size else b"", np.uint8), places


def anchor_rows(blocks: DataFrame, length: int) -> DataFrame:
    """hash, block, several: the distinct anchors of each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            for k in range(batch.num_rows):
                block, blob, ends = (batch.column(c)[k].as_py() for c in range(3))
                values, several = windows.anchors(*opened(blob, ends))
                yield _batch(["hash", "block", "several"], [LONGS, LONGS, pa.bool_()], [values.view(np.int64), np.full(len(values), block), several])

    return blocks.select("block", "blob", "ends").mapInArrow(scan, "hash long, block long, several boolean")


FRAGMENT = "block long, text int, at long, windows int, route long, digest binary, bytes binary"


def fragment_rows(blocks: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """Rows by ``FRAGMENT``; ``bytes`` is null where the same task has written the same fragment before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, written = Windows(length), set()
        names = [part.split()[0] for part in FRAGMENT.split(", ")]
        types = [LONGS, pa.int32(), LONGS, pa.int32(), LONGS, pa.binary(), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                block, blob, ends = (batch.column(c)[k].as_py() for c in range(3))
                known = np.sort(batch.column(3)[k].values.to_numpy().view(np.uint64))
                flat, places = opened(blob, ends)
                data, rows = flat.tobytes(), []
                for start, n, route in windows.fragments(flat, places, known):
                    text = int(np.searchsorted(places, start, "right"))
                    part = data[start : start + n - 1 + length]
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    new = digest not in written
                    if new:
                        if len(written) >= FRAGMENT_IDS:
                            written.clear()
                        written.add(digest)
                    at = start - (int(places[text - 1]) if text else 0)
                    rows.append((block, text, at, n, route, digest, part if new else None))
                    if len(rows) >= 20_000:
                        yield _batch(names, types, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield _batch(names, types, list(zip(*rows, strict=True)))

    return blocks.select("block", "blob", "ends").join(repeated, "block").mapInArrow(scan, FRAGMENT)


def sort_shard(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each part the runs [start, end) of its windows that occur at another place of any part."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8) + np.uint8(1)  # 255 is no byte of UTF-8 and becomes 0
    begins = np.cumsum(sizes + 1) - sizes - 1
    wanted = np.zeros(len(text) + 1, np.int8)
    wanted[begins] += 1
    wanted[begins + sizes - length + 1] -= 1
    found = repeated_places(text, np.cumsum(wanted[:-1]).astype(bool), length)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
    runs: list[list[tuple[int, int]]] = [[] for _ in parts]
    owner = np.searchsorted(begins, edges[::2], "right") - 1
    for k, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        runs[k].append((a - int(begins[k]), b - int(begins[k])))
    return runs


RUN = "route long, digest binary, start int, end int"


def sorted_runs(fragments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Rows by ``RUN``: windows of fragments that occur in another fragment of the route, or at another place of their own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes]] = {}
        size, last = 0, None

        def shard() -> pa.RecordBatch:
            runs = sort_shard([part for _, part in held.values()], length)
            rows = [(route, digest, a, b) for (digest, (route, _)), own in zip(held.items(), runs, strict=True) for a, b in own]
            return _batch(["route", "digest", "start", "end"], [LONGS, pa.binary(), pa.int32(), pa.int32()], list(zip(*rows, strict=True)) or [[]] * 4)

        for batch in batches:
            for route, digest, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if route != last and size >= shard_bytes:
                    yield shard()
                    held, size = {}, 0
                last = route
                if digest not in held:
                    held[digest] = (route, part)
                    size += len(part) + 1
        if held:
            yield shard()

    rows = fragments.where("bytes is not null").select("route", "digest", "bytes")
    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(scan, RUN)


def split_hot(fragments: DataFrame, length: int, hot_bytes: int) -> DataFrame:
    """Fragments of routes whose different bytes pass ``hot_bytes`` as one fragment per window, routed by its own hash.

    Any number of surroundings of one short run of bytes are parted this way, as equal windows have equal hashes. Other
    routes stay as they are.
    """
    hot = fragments.where("bytes is not null").groupBy("route").agg(F.sum(F.length("bytes")).alias("size"))
    hot = stored(hot.where(F.col("size") > hot_bytes).select("route"), "hot-routes")
    if hot.isEmpty():
        return fragments
    whole = fragments.groupBy("digest").agg(F.first("bytes", ignorenulls=True).alias("whole"))
    apart = fragments.join(hot, "route", "left_semi").drop("bytes").join(whole, "digest")
    apart = apart.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    apart = apart.withColumn("bytes", F.expr(f"substring(whole, k + 1, {length})"))
    apart = apart.select(
        "block", "text", (F.col("at") + F.col("k")).alias("at"), F.lit(1).alias("windows"), F.xxhash64("bytes").alias("route"),
        F.unhex(F.md5("bytes")).alias("digest"), "bytes",
    )
    return stored(fragments.join(hot, "route", "left_anti").unionByName(apart.select(fragments.columns)), "windows")


def repeated_runs(blocks: DataFrame, length: int, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """block, text, start, end: windows of the texts of ``blocks`` that begin at another place too (runs may overlap)."""
    by_hash = _over("hash")
    repeated = anchor_rows(blocks, length).withColumn(
        "repeated", (F.min("block").over(by_hash) != F.max("block").over(by_hash)) | F.max("several").over(by_hash)
    )
    lists = repeated.where("repeated").groupBy("block").agg(F.collect_list("hash").alias("hashes"))
    fragments = split_hot(stored(fragment_rows(blocks, lists, length), "fragments"), length, hot_bytes)
    # A fragment that occurs twice as a whole needs no sorting itself, but its bytes stay in the shard for the others.
    twice = fragments.groupBy("route", "digest").agg(F.count("*").alias("n"), F.max("windows").alias("end")).where("n > 1")
    runs = sorted_runs(fragments, length, shard_bytes).unionByName(
        twice.select("route", "digest", F.lit(0).alias("start"), F.col("end").cast("int"))
    )
    found = fragments.select("block", "text", "at", "route", "digest").join(runs, ["route", "digest"])
    return found.select("block", "text", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))


def _over(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges, merged), kept (the bytes left).

    A byte goes if it lies in ``length`` bytes of its text that also begin at another place of any text, the same one
    included. Places are judged on the texts as they came. A null text is empty; texts shorter than ``length`` stay.
    Every row of ``docs`` gives one row: rows that repeat an id or a text are documents of their own, so their texts
    repeat. Other columns than doc_id and text are not read. An empty table gives no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    blocks = stored(blocks_of(docs), "blocks")
    runs = repeated_runs(blocks, length, shard_bytes, hot_bytes)
    lists = runs.groupBy("block").agg(F.collect_list(F.struct("text", "start", "end")).alias("runs"))
    schema = f"doc_id {key}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", LONGS), ("end", LONGS)]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat, ends = opened(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                data, owners, runs = flat.tobytes(), batch.column(2)[k].values, batch.column(3)[k].values
                keys, texts = owners.field("doc_id"), owners.field("text").to_numpy()
                marks = np.zeros(len(flat) + 1, np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                if runs is not None and len(runs):
                    own, a, b = (runs.field(name).to_numpy() for name in ("text", "start", "end"))
                    np.add.at(marks, begins[own] + a, 1)
                    np.add.at(marks, begins[own] + b + length - 1, -1)
                for t in np.flatnonzero(np.bincount(texts, minlength=len(ends)) > 1):
                    if ends[t] - begins[t] >= length:
                        marks[begins[t]] += 1
                        marks[ends[t]] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                spans, kept = [], []
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    cuts = [0, *edges, b - a]
                    kept.append(b"".join(data[a + x : a + y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
                sizes = (ends - begins)[texts]
                for start in range(0, len(texts), 2000):
                    some = texts[start : start + 2000].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, 2000), pa.array(sizes[start : start + 2000], LONGS), pa.array([spans[t] for t in some], span), pa.array([kept[t] for t in some], pa.binary())],
                        names=["doc_id", "n_bytes", "spans", "kept"],
                    )

    return blocks.join(lists, "block", "left").select("blob", "ends", "docs", "runs").mapInArrow(cut, schema)
