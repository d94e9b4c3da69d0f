"""Hard negatives by angular triangle filtering: stored angles to reference directions bound every score before it is taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.storage import stored

REFERENCES = 8
SAMPLE_ROWS = 512  # rows that the reference directions are chosen from; any choice gives the same results
CHUNK_ROWS = 1024
BLOCK_ANCHORS = 512
ROUND_BLOCKS = 16  # blocks that are searched at once; one has at most BLOCK_ANCHORS anchors

# Angles come from cosines that are off by some 1e-15, which near 0 and pi is some 1e-7 of an angle.
ANGLE_ERROR = 4e-7
NONE = np.iinfo(np.int64).min


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit rows of ``sample`` that lie far from each other, the farthest from all before them first."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    while len(chosen) < min(count, len(unit)):
        near = np.abs(unit @ unit[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        chosen.append(int(near.argmin()))
    return unit[chosen]


def angles_to(rows: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references; rows without a length lie at 0, where their bounds are 0 whatever the angle."""
    cosines = rows.astype(np.float64) @ references.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


class Rows:
    """Some rows as arrays: ids, labels, whole-number vectors, norms and angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.vectors, self.norms, self.angles = ids, labels, vectors, norms, angles

    @classmethod
    def read(cls, n: int, ids: bytes, labels: bytes, vectors: bytes, norms: bytes, angles: bytes) -> Rows:
        longs, doubles = (lambda b: np.frombuffer(b, np.int64)), (lambda b: np.frombuffer(b, np.float64))
        return cls(longs(ids), longs(labels), longs(vectors).reshape(n, -1), doubles(norms), doubles(angles).reshape(n, -1))


def score_bounds(a: Rows, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores between rows of ``a`` and ``x``, rounded outwards.

    With angles s and t to a reference, the angle between two rows is at least ``|s - t|`` and at most ``s + t`` or
    ``2 pi - s - t``. The cosine of each end times both norms bounds the inner product.
    """
    least = np.zeros((len(a.ids), len(x.ids)))
    most = np.full_like(least, np.pi)
    for j in range(a.angles.shape[1]):
        s, t = a.angles[:, j, None], x.angles[None, :, j]
        np.maximum(least, np.abs(s - t), out=least)
        total = s + t
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    size = a.norms[:, None] * x.norms[None, :]
    slack = 1 + size * 1e-9
    upper = np.cos(np.maximum(least - ANGLE_ERROR, 0)) * size + slack
    lower = np.cos(np.minimum(np.maximum(most, least) + ANGLE_ERROR, np.pi)) * size - slack
    return lower, upper


def scores(a: Rows, x: Rows) -> np.ndarray:
    """Exact inner products. Products that may pass 2^62 do not fit the result's type and are an error."""
    dims = min(a.vectors.shape[1], x.vectors.shape[1])  # what one of them lacks counts as 0
    p, q = a.vectors[:, :dims], x.vectors[:, :dims]
    largest = float(np.abs(p.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * dims
    if largest < 2.0**52:
        return (p.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if float(a.norms.max(initial=0)) * float(x.norms.max(initial=0)) >= 2.0**62:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return p @ q.T


class Best:
    """The first ``depth`` rows of each of ``lists`` lists, by falling score and rising id."""

    def __init__(self, lists: int, depth: int):
        self.depth = depth
        self.scores = np.full((lists, depth), NONE)
        self.ids = np.full((lists, depth), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score that a row must reach to enter each list."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        at = np.concatenate([at, np.repeat(lists, self.depth)])
        score = np.concatenate([score, self.scores[lists].ravel()])
        ids = np.concatenate([ids, self.ids[lists].ravel()])
        order = np.lexsort((ids, -score.astype(np.float64), at)) if abs(score[score > NONE]).max(initial=0) < 2**52 else np.array(
            sorted(range(len(at)), key=lambda k: (at[k], -int(score[k]), ids[k])), np.int64
        )
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        place = np.arange(len(at)) - first
        keep = place < self.depth
        self.scores[at[keep], place[keep]] = score[keep]
        self.ids[at[keep], place[keep]] = ids[keep]


def positives_in(anchors: Rows, chunk: Rows, best: Best) -> None:
    """Merge the rows of ``chunk`` that share an anchor's label into the anchor's list."""
    _, upper = score_bounds(anchors, chunk)
    wanted = (anchors.labels[:, None] == chunk.labels[None, :]) & (anchors.ids[:, None] != chunk.ids[None, :])
    wanted &= upper >= best.least()[:, None]
    _score(anchors, chunk, wanted, lambda at, score, ids: best.add(at, score, ids))


def negatives_in(anchors: Rows, windows: np.ndarray, chunk: Rows, best: Best) -> None:
    """Merge rows of other labels whose score lies in a window, of which every anchor has ``windows.shape[1]``.

    ``windows`` has the lowest and the highest score of each; an empty one is (1, 0). Only rows whose interval of possible
    scores overlaps a window that they could still enter are scored.
    """
    count = windows.shape[1]
    lower, upper = score_bounds(anchors, chunk)
    need = np.maximum(windows[:, :, 0], best.least().reshape(-1, count))
    wanted = np.zeros(lower.shape, bool)
    for w in range(count):
        some = windows[:, w, 0] <= windows[:, w, 1]
        wanted |= some[:, None] & (upper >= need[:, w, None]) & (lower <= windows[:, w, 1, None])
    wanted &= anchors.labels[:, None] != chunk.labels[None, :]

    def merge(at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(count):
            fits = (score >= need[at, w]) & (score <= windows[at, w, 1])
            best.add(at[fits] * count + w, score[fits], ids[fits])

    _score(anchors, chunk, wanted, merge)


def _score(anchors: Rows, chunk: Rows, wanted: np.ndarray, merge: Callable) -> None:
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return
    part = lambda r, k: Rows(r.ids[k], r.labels[k], r.vectors[k], r.norms[k], r.angles[k])
    found = scores(part(anchors, rows), part(chunk, columns))
    at, x = np.nonzero(wanted[np.ix_(rows, columns)])
    merge(rows[at], found[at, x], chunk.ids[columns[x]])


ROW_SCHEMA = "vec_id long, label long, vector array<long>, anchor boolean"
ANGLED = "vec_id long, label long, vector binary, norm double, angles binary, anchor boolean, nearest int, turn double"
CHUNK = "n int, ids binary, labels binary, vectors binary, norms binary, angles binary, low array<double>, high array<double>, reach double"


def whole_rows(embeddings: DataFrame, anchors: Column, scale: int = 256) -> DataFrame:
    """Rows that take part, their components as ``floor(scale * x)``."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x * scale)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )


def _columns(schema: str, columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def with_angles(rows: DataFrame) -> DataFrame:
    """Norms and angles to reference directions, the nearest of these and the angle to it."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    padded = np.array([r.vector + [0] * (width - len(r.vector)) for r in sample], np.float64).reshape(len(sample), width)
    references = directions(padded, REFERENCES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            vectors = np.zeros((batch.num_rows, width), np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            vectors[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            angles = angles_to(vectors, norms, references)
            nearest = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(norms), np.int64)
            turn = angles.min(axis=1, initial=np.pi)
            yield _columns(
                ANGLED,
                [batch.column(0), batch.column(1), [v.tobytes() for v in vectors], norms, [a.tobytes() for a in angles], batch.column(3), nearest.astype(np.int32), turn],
                [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.bool_(), pa.int32(), pa.float64()],
            )

    return rows.mapInArrow(measure, ANGLED)


def chunks(angled: DataFrame, size: int) -> DataFrame:
    """Rows in order of direction, ``size`` to a row, with the range of their angles and the largest norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                n = part.num_rows
                blob = lambda k, part=part: b"".join(part.column(k).to_pylist())
                longs = lambda k, part=part: part.column(k).to_numpy(zero_copy_only=False).tobytes()
                angles = np.frombuffer(blob(4), np.float64).reshape(n, -1)
                norms = part.column(3).to_numpy()
                yield _columns(
                    CHUNK, [[n], [longs(0)], [longs(1)], [blob(2)], [norms.tobytes()], [angles.tobytes()], [angles.min(axis=0)], [angles.max(axis=0)], [norms.max()]],
                    [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()],
                )

    parts = max(1, -(-angled.count() // (8 * size)))
    order = ["nearest", "turn", "vec_id"]
    return angled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, CHUNK)


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` stored with a number ``no`` from 0 on, and how many there are. Only counts per file partition are gathered."""
    at = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("_at", at), name)
    part = F.call_function("shiftright", "_at", F.lit(33))
    counts = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    begin, total = {}, 0
    for k in sorted(counts):
        begin[k], total = total, total + counts[k]
    if not total:
        return rows.withColumn("no", F.lit(0).cast("long")).drop("_at"), 0
    starts = rows.sparkSession.createDataFrame(list(begin.items()), "_part long, _begin long")
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(
        "no", F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ).drop("_at", "_part", "_begin"), total


def _reachable(spread: bool) -> Column:
    """Whether some score between a chunk and a block may reach ``need``, from the ranges of their angles."""
    if not spread:
        return F.lit(True)
    gaps = F.zip_with(
        F.zip_with("low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y)
    )
    gap = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)) - ANGLE_ERROR, F.lit(0.0))
    size = F.col("reach") * F.col("b_reach")
    return F.cos(gap) * size + 1 + size * 1e-9 >= F.col("need")


PAIR = ["n", "ids", "labels", "vectors", "norms", "angles"]


def searched(chunk_rows: DataFrame, blocks: DataFrame, count: int, depth: int, name: str, windows: int) -> DataFrame:
    """The first ``depth`` rows of each list of all anchors: block, list, score, id; ``windows`` lists per anchor, 0 for positives.

    Blocks are joined to chunks by their number, a round of ``ROUND_BLOCKS`` at a time; that many blocks are the size
    which the hint to send them to all tasks rests on. A task merges all its chunks into one list per anchor before
    anything is shuffled.
    """
    spark = chunk_rows.sparkSession
    schema = "no long, list int, score long, id long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                no, chunk = row[0], Rows.read(*row[1:7])
                if no not in held:
                    anchors = Rows.read(*row[7:13])
                    edges = np.frombuffer(row[13], np.int64).reshape(len(anchors.ids), -1, 2) if windows else None
                    held[no] = (anchors, edges, Best(len(anchors.ids) * max(1, windows), depth))
                anchors, edges, best = held[no]
                if windows:
                    negatives_in(anchors, edges, chunk, best)
                else:
                    positives_in(anchors, chunk, best)
        for no, (_, _, best) in held.items():
            at, place = np.nonzero(best.scores > NONE)
            yield _columns(schema, [np.full(len(at), no), at.astype(np.int32), best.scores[at, place], best.ids[at, place]], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    found = None
    for start in range(0, count, ROUND_BLOCKS):
        some = blocks.where(F.col("no").between(start, start + ROUND_BLOCKS - 1))
        some = some.select("no", *[F.col(c).alias(f"b_{c}") for c in [*PAIR, "low", "high", "reach"]], *(["need", "windows"] if windows else []))
        last = min(count, start + ROUND_BLOCKS) - 1
        here = chunk_rows.withColumn("no", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(last).cast("long"))))
        pairs = here.join(F.broadcast(some), "no").where(_reachable(bool(windows)))
        pairs = pairs.select("no", *PAIR, *[f"b_{c}" for c in PAIR], *(["windows"] if windows else []))
        part = stored(first_rows(pairs.mapInArrow(search, schema), depth), name)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"{schema}, rank int")


def first_rows(found: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("no", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def mine(
    embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, floor_percent: int = 80
) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, embedding, label (whole numbers); ``anchors`` says which rows are searched for. Scores are
    inner products of ``floor(256 * x)``. Positives are the first rows of the anchor's label, negatives the first of other
    labels with ``floor_percent * positive <= 100 * negative <= 100 * positive``; higher scores come first, ties by
    smaller vec_id. Rows with a null id, label or vector, or a component that is null or not finite, take no part.
    A shorter vector counts as followed by zeros. Rows that repeat a vec_id are rows of their own, but no row is a
    positive for its own id. Further columns are not read. Empty tables, and anchors without a positive or a negative
    in the window, give no rows. A vector as hot as a third of all rows fills chunks like any other.
    """
    angled = stored(with_angles(whole_rows(embeddings, anchors)), "angles")
    chunk_rows = stored(chunks(angled, CHUNK_ROWS), "chunks")
    blocks, count = numbered(chunks(angled.where("anchor"), BLOCK_ANCHORS), "blocks")
    first = searched(chunk_rows, blocks, count, positives, "positives", 0)
    lists = first.groupBy("no").agg(F.collect_list(F.struct("list", "rank", "score", "id")).alias("found"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, n, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows = np.tile(np.array([1, 0], np.int64), (n, positives, 1))
                for row in found:
                    windows[row["list"], row["rank"] - 1] = -(-floor_percent * row["score"] // 100), row["score"]
                low, some = windows[:, :, 0], windows[:, :, 0] <= windows[:, :, 1]
                need = float(low[some].min()) if some.any() else None
                yield _columns("no long, windows binary, need double", [[no], [windows.tobytes()], [need]], [pa.int64(), pa.binary(), pa.float64()])

    ranges = blocks.select("no", "n").join(lists, "no").mapInArrow(edges, "no long, windows binary, need double")
    wide = stored(blocks.join(ranges, "no"), "windows")
    second = searched(chunk_rows, wide, count, negatives, "negatives", positives)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(ids, np.int64)
                yield _columns("no long, anchor int, anchor_id long", [np.full(len(found), no), np.arange(len(found), dtype=np.int32), found], [pa.int64(), pa.int32(), pa.int64()])

    named = blocks.select("no", "ids").mapInArrow(names, "no long, anchor int, anchor_id long")
    first = first.select("no", F.col("list").alias("anchor"), F.col("rank").alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    second = second.select(
        "no", F.expr(f"list div {positives}").cast("int").alias("anchor"), (F.col("list") % positives + 1).alias("which"), "rank",
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    out = second.join(first, ["no", "anchor", "which"]).join(named, ["no", "anchor"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
