"""N-gram Jaccard join by a size-aware heavy-light scheme: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct word shingles. Two sets of sizes a, b that reach the threshold t share at least
``o = ceil(t * max(a, b))`` shingles, so under one order of all shingles they share at least c of the first
``size - ceil(t * size) + c`` of each. Shingles are ordered by how frequent they are (a sketch over all documents),
rare ones first.

* A small set (size <= boundary) is listed under every subset of two shingles of its first ones (c = 2).
* A large set is listed under each of its first shingles (c = 1); so is a small one that is large enough to reach a
  large one.
* The boundary is where the lists' estimated cost is lowest, from the sizes of all sets and the sketch.

Lists are never expanded into pairs. The most typical document of a list is its pivot, and every other is compared
with it. Only where a list has members that this leaves apart are its members compared with each other: in blocks, by
parity bitmaps whose distance bounds the overlap from above. What passes is verified on the sets themselves, so every
link that matters to a component is found, and none is added.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm import sketch
from waybill.llm.components import connected_components
from waybill.llm.storage import free_name, stored

SKETCH_BITS = 21
FILTER_BITS = 21
BITMAP_BITS = 4096
# Rows of a list that one window gathers, and members that one task compares with as many others.
LIST_ROWS = 2_048
BLOCK = 512
# Sizes for which subsets are considered at all; beyond them their number explodes.
LARGEST_SMALL = 64
# Words that one Python worker remembers the hashes of, and the words that are hashed at once.
CACHE_WORDS = 300_000
CHUNK_WORDS = 200_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes, each sorted."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, texts: Iterator[bytes | None]) -> Iterator[np.ndarray]:
        """Words are lower-cased in A-Z and split at ASCII white space."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(self._hashes(text.lower().split()) if text else np.zeros(0, np.uint64))
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                yield from self._sets(held)
                held, size = [], 0
        yield from self._sets(held)

    def _sets(self, held: list[np.ndarray]) -> Iterator[np.ndarray]:
        if not held:
            return
        words = np.concatenate([*held, np.zeros(self.width, np.uint64)])
        n = len(words) - self.width
        value = np.full(n, self.width, np.uint64)
        for k in range(self.width):
            value = mix(value * _A + words[k : n + k])
        at = 0
        for own in held:
            if len(own) >= self.width:
                yield np.unique(value[at : at + len(own) - self.width + 1])
            elif len(own):
                short = np.array([len(own)], np.uint64)
                for w in own:
                    short = mix(short * _A + w)
                yield short
            else:
                yield own
            at += len(own)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""

    percent: int

    def first(self, size: int, shared: int) -> int:
        """How many first shingles of a set hold ``shared`` of those that any similar set has too."""
        return min(size, size - -(-self.percent * size // 100) + shared)

    def smallest_partner(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def smallest_size(self) -> int:
        """Below this size a set is similar only to an equal one: size / (size + 1) misses the threshold."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 62


@dataclass(frozen=True)
class Plan:
    boundary: int
    mean_list: float


def choose_boundary(sizes: dict[int, int], counts: np.ndarray, threshold: Threshold) -> Plan:
    """The size up to which subsets cost less than scanning lists.

    A set listed under subsets costs one entry each; one listed under single shingles costs an entry and the scan of
    the list, whose mean length is taken from the sketch (less what its cells hold by chance).
    """
    total = float(counts.sum())
    noise = total / len(counts)
    square = float((counts.astype(np.float64) ** 2).sum())
    mean_list = max(1.0, square / total - noise) if total else 1.0
    low = threshold.smallest_size()

    def subsets(n: int) -> float:
        p = threshold.first(n, 2)
        return p * (p - 1) / 2

    def lists(n: int) -> float:
        return threshold.first(n, 1) * (1 + mean_list)

    best, at = None, 0
    for boundary in [0, *range(low, LARGEST_SMALL + 1)]:
        cost = 0.0
        for n, rows in sizes.items():
            if n < low:
                continue
            if n <= boundary:
                cost += rows * subsets(n)
            if n > boundary or n >= threshold.smallest_partner(boundary + 1):
                cost += rows * lists(n)
        if best is None or cost < best:
            best, at = cost, boundary
    return Plan(at, mean_list)


def _batch_of(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


PROFILE = "doc_id long, size int, signature binary, block int, counts binary"
PROFILE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("size", pa.int32()), ("signature", pa.binary()), ("block", pa.int32()), ("counts", pa.binary()),
])


def _profile(texts: DataFrame, width: int) -> DataFrame:
    """A row per document (size and a 128-bit signature of its set), and each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(width), np.zeros(1 << SKETCH_BITS, np.uint32)
        last = np.uint64(len(counts) - 1)
        for batch in batches:
            sizes, signatures = [], []
            for s in shingler(v.as_py() for v in batch.column(1)):
                np.add.at(counts, (s & last).astype(np.int64), 1)
                sizes.append(len(s))
                signatures.append(xxhash.xxh3_128_digest(s.tobytes()))
            nothing = pa.nulls(len(sizes))
            yield _batch_of(
                [batch.column(0), sizes, signatures, nothing.cast(pa.int32()), nothing.cast(pa.binary())], PROFILE_ARROW
            )
        rows = sketch.rows_of(counts)
        if rows:
            nothing = pa.nulls(len(rows))
            blocks, blobs = zip(*rows, strict=True)
            yield _batch_of(
                [nothing.cast(pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary()), blocks, blobs], PROFILE_ARROW
            )

    return texts.mapInArrow(run, PROFILE)


ENTRIES = "key long, salt int, salts int, doc_id long, score int"
ENTRIES_ARROW = pa.schema([
    ("key", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int32()),
])


def _entries(texts: DataFrame, width: int, threshold: Threshold, plan: Plan, counts) -> DataFrame:
    """The lists: a row for each key under which a set is listed. ``score`` is how typical the set's shingles are.

    The sketch bounds the length of every list from above; a list that may be long is dealt over ``salts`` parts.
    """
    low, bridge = threshold.smallest_size(), threshold.smallest_partner(plan.boundary + 1)
    boundary = plan.boundary

    def keys(s: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((s, frequency))[: threshold.first(len(s), 2)]
        first, often = s[order], frequency[order]
        found, bound = [], []
        if len(s) <= boundary:
            i, j = np.triu_indices(len(first), 1)
            found.append(mix(first[i] * _A + first[j]))
            bound.append(np.minimum(often[i], often[j]))
        if len(s) > boundary or len(s) >= bridge:
            n = threshold.first(len(s), 1)
            found.append(first[:n])
            bound.append(often[:n])
        return np.concatenate(found), np.concatenate(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(width), counts.value
        last = np.uint64(len(table) - 1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            owner: list[tuple[int, int, int]] = []
            held = 0
            for k, s in enumerate(shingler(v.as_py() for v in batch.column(1))):
                if len(s) < low or ids[k] is None:
                    continue
                frequency = table[(s & last).astype(np.int64)]
                found.append(keys(s, frequency))
                owner.append((ids[k], int(16 * np.log2(frequency.astype(np.float64) + 1).mean()), len(found[-1][0])))
                held += owner[-1][2]
                if held > 100_000:
                    yield _listed(found, owner)
                    found, owner, held = [], [], 0
            if found:
                yield _listed(found, owner)

    return texts.mapInArrow(run, ENTRIES)


def _listed(found: list[tuple[np.ndarray, np.ndarray]], owner: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, scores, n = (np.array(x, np.int64) for x in zip(*owner, strict=True))
    ids = np.repeat(ids, n)
    salts = np.concatenate([f[1] for f in found]).astype(np.int64) // LIST_ROWS + 1
    salt = mix(ids.view(np.uint64) * _A) % salts.astype(np.uint64)
    keys = np.concatenate([f[0] for f in found]).view(np.int64)
    return _batch_of(
        [keys, salt.astype(np.int32), salts.astype(np.int32), ids, np.repeat(scores.astype(np.int32), n)], ENTRIES_ARROW
    )


def _lists(entries: DataFrame) -> DataFrame:
    """(key, doc_id, pivot, crowded): every entry beside the most typical document of its list, its pivot.

    A list dealt over several parts has a pivot in each, and these have one among themselves. Lists with one entry
    are left out; ``crowded`` ones may hold more than a pivot and one other.
    """
    top = F.max(F.struct("score", "doc_id"))
    part = Window.partitionBy("key", "salt")
    rows = entries.withColumn("n", F.count("*").over(part)).withColumn("top", top.over(part))
    rows = rows.where("n > 1 or salts > 1")
    rows = stored(
        rows.select("key", "doc_id", "score", "salts", F.col("top.doc_id").alias("pivot"), F.expr("n > 2 or salts > 1").alias("crowded")),
        "lists",
    )
    heads = rows.where("salts > 1 and doc_id = pivot").select("key", "doc_id", "score", "crowded").distinct()
    heads = heads.withColumn("pivot", top.over(Window.partitionBy("key"))["doc_id"])
    return rows.select("key", "doc_id", "pivot", "crowded").unionByName(heads.select("key", "doc_id", "pivot", "crowded"))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the shingles that fall on k: two bitmaps differ in no more bits than their sets."""
    slot = (mix(s) >> np.uint64(32)).astype(np.int64) % BITMAP_BITS
    return np.packbits((np.bincount(slot, minlength=BITMAP_BITS) & 1).astype(np.uint8)).view(np.int64)


MARKS = "doc_id long, size int, bits array<long>"
SETS = "doc_id long, shingles array<long>"


def _cells(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64) * _A) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter_of(values: DataFrame):
    """A broadcast table of fixed size that says which numbers may be in ``values`` (one long column)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FILTER_BITS, np.uint32)
        for batch in batches:
            np.add.at(counts, _cells(batch.column(0).to_numpy()), 1)
        for block, blob in sketch.rows_of(counts):
            yield _batch_of([[block], [blob]], sketch.ARROW)

    marked = sketch.add_up(values.mapInArrow(mark, sketch.SCHEMA), FILTER_BITS)
    return values.sparkSession.sparkContext.broadcast(marked > 0)


def _maybe_in(column: Column, values: DataFrame) -> Column:
    """False only where the number in ``column`` is not in ``values``; such rows need not be joined."""
    chosen = _filter_of(values)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series) -> pd.Series:
        known = x.notna()
        found = np.zeros(len(x), bool)
        found[known] = chosen.value[_cells(x[known].to_numpy().astype(np.int64))]
        return pd.Series(found)

    return possible(column)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id long); null ids stay.

    Only rows that a filter of fixed size cannot clear are joined, so the texts of the others are not shuffled.
    """
    flag = free_name(docs.columns, "_possible")
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(flag, _maybe_in(F.col("doc_id").cast("long"), ids.select("doc_id")))
    rest = marked.where(F.col(flag)).join(ids, "doc_id", "left_anti")
    return marked.where(~F.col(flag)).select(*own).unionByName(rest.select(*own))


def _of_wanted(texts: DataFrame, wanted: DataFrame, width: int, schema: str, columns) -> DataFrame:
    """``columns`` (doc_ids, sets) of the documents in ``wanted``, and of a few others by chance.

    Only their texts become sets, and no text is shuffled.
    """
    chosen = _filter_of(wanted.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            taken, content = batch.column(0), batch.column(1)
            keep = np.flatnonzero(taken.is_valid().to_numpy(zero_copy_only=False))
            keep = keep[chosen.value[_cells(taken.drop_null().to_numpy())]]
            for at in range(0, len(keep), 200):
                part = keep[at : at + 200].tolist()
                yield columns(taken.take(pa.array(part, pa.int64())), list(shingler(content[k].as_py() for k in part)))

    return texts.mapInArrow(run, schema)


def _marks(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, size, bits): what bounds the overlap of two sets."""
    arrow = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("bits", pa.list_(pa.int64()))])

    def columns(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return _batch_of([ids, [len(s) for s in sets], [bitmap(s) for s in sets]], arrow)

    return _of_wanted(texts, wanted, width, MARKS, columns)


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the threshold."""
    sides = pairs
    for end in ("a", "b"):
        sides = sides.join(
            marks.select(F.col("doc_id").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}")), end
        )
    apart = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x
    )
    return sides.where(apart * (100 + percent) <= (100 - percent) * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _verified(likely: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    arrow = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def columns(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return _batch_of([ids, [s.view(np.int64) for s in sets]], arrow)

    ends = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_of_wanted(texts, ends, width, SETS, columns), "sets")
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


BLOCK_PAIRS = "a long, b long"
PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare_blocks(percent: int):
    def near(rows: dict[str, np.ndarray]) -> np.ndarray:
        """Members of one block beside those of another (or itself): pairs of different components that bitmaps allow."""
        kinds, count = np.unique(rows["component"], return_counts=True)
        rare = np.flatnonzero(rows["component"] != kinds[count.argmax()])  # two of the largest need no comparison
        one = rows["low"][0] == rows["high"][0]
        found = []
        for k in rare.tolist():
            apart = np.bitwise_count(rows["bits"] ^ rows["bits"][k]).sum(axis=1, dtype=np.int64)
            near = (rows["component"] != rows["component"][k]) & (one | (rows["mine"] != rows["mine"][k]))
            near &= apart * (100 + percent) <= (100 - percent) * (rows["size"] + rows["size"][k])
            other = rows["rep"][near]
            found.append(np.stack([np.minimum(other, rows["rep"][k]), np.maximum(other, rows["rep"][k])], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    names = ("key", "low", "high", "mine", "rep", "size", "component")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = {n: batch.column(n).to_numpy().astype(np.int64) for n in names}
                rows["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_BITS // 64)
                held = rows if held is None else {n: np.concatenate([held[n], rows[n]]) for n in rows}
            if held is None or not len(held["key"]):
                continue
            new = np.zeros(len(held["key"]), bool)
            for n in ("key", "low", "high"):
                new[1:] |= held[n][1:] != held[n][:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            ends = [*starts[1:], len(new)]
            done = len(starts) if batch is None else len(starts) - 1  # the last list may go on in the next batch
            found = [near({n: v[a:b] for n, v in held.items()}) for a, b in zip(starts[:done], ends[:done], strict=True)]
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                yield _batch_of([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], PAIRS_ARROW)
            held = {n: v[starts[-1] :] for n, v in held.items()} if batch is not None else None

    return compare


def _left_apart(lists: DataFrame, pairs: DataFrame, reps: DataFrame, marks: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs that pivots do not decide: of lists whose pivot is linked with some members and not with others.

    ``pairs`` has (doc_id, pivot) as listed, and the nodes a, b of both. Filters of fixed size take the rows of other
    lists out before anything is joined.
    """
    component = labels.select(F.col("node").alias("rep"), "component")

    def label(frame: DataFrame, end: str) -> DataFrame:
        named = component.select(F.col("rep").alias(end), F.col("component").alias(f"c_{end}"))
        return frame.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))

    nodes = pairs.select("a", "b").distinct()
    failed = stored(label(label(nodes, "a"), "b").where("c_a <> c_b").select("a", "b"), "failed")
    listed = F.xxhash64("doc_id", "pivot")
    apart = stored(pairs.join(failed, ["a", "b"], "left_semi").select("doc_id", "pivot", listed.alias("listed")), "failed-entries")
    crowded = lists.where("crowded")
    near = crowded.where(_maybe_in(listed, apart.select("listed")))
    keys = stored(near.join(apart, ["doc_id", "pivot"], "left_semi").select("key").distinct(), "open-lists")
    members = crowded.where(_maybe_in(F.col("key"), keys)).join(keys, "key", "left_semi")
    members = members.select("key", F.explode(F.array("doc_id", "pivot")).alias("doc_id")).distinct()
    members = stored(members.join(reps.select("doc_id", "rep"), "doc_id").select("key", "rep").distinct(), "members")
    counts = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"), "list-sizes")
    members = members.join(counts, "key").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = members.join(marks.select(F.col("doc_id").alias("rep"), "size", "bits"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", "size", "component", "bits"
    )
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    near = dealt.mapInArrow(_compare_blocks(percent), BLOCK_PAIRS)
    return near.distinct().join(nodes, ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included).

    Two documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent`` / 100. A text with fewer words has the whole sequence as its one shingle; a text that is null or has no
    words has none and is linked with nothing. Every input row gives one row; rows that repeat a doc_id are one node,
    and a row with a null doc_id has a null component. Columns other than doc_id and text are not read.
    """
    threshold = Threshold(percent)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    profile = stored(_profile(texts, width), "profile")
    found = profile.where("block is null").select("doc_id", "size", "signature")
    counts = sketch.add_up(profile.where("block is not null").select("block", "counts"), SKETCH_BITS)
    small = found.where(F.col("size").between(1, LARGEST_SMALL)).groupBy("size").count().collect()
    plan = choose_boundary({r["size"]: r["count"] for r in small}, counts, threshold)
    table = spark.sparkContext.broadcast(np.minimum(counts, np.uint64(0xFFFFFFFF)).astype(np.uint32))

    # Documents with equal sets are one node, named by the smallest doc_id.
    classes = stored(
        found.where("size > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("rep")), "classes"
    )
    nodes = stored(found.join(classes, "signature", "left").select("doc_id", "size", "rep"), "nodes")
    reps = nodes.where("rep is not null").select("doc_id", "rep", "size")

    lists = _lists(_entries(texts, width, threshold, plan, table))
    pairs = lists.where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    pairs = pairs.join(reps, "doc_id").select("doc_id", "pivot", F.col("rep").alias("x"), "size")
    pairs = pairs.join(reps.select(F.col("doc_id").alias("pivot"), F.col("rep").alias("y"), F.col("size").alias("other")), "pivot")
    pairs = stored(
        pairs.where("x <> y").select(
            "doc_id", "pivot", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
            (100 * F.least("size", "other") >= percent * F.greatest("size", "other")).alias("sizes_fit"),
        ),
        "pairs",
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    marks = stored(_marks(texts, ends, width), "marks")
    likely = stored(_likely(pairs.where("sizes_fit").select("a", "b").distinct(), marks, percent), "likely")
    links = stored(_verified(likely, texts, width, percent), "verified")
    labels = connected_components(links)
    more = stored(_left_apart(lists, pairs, reps, marks, labels, percent), "apart")
    if not more.isEmpty():
        more = _verified(more, texts, width, percent)
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    labels = labels.select(F.col("node").alias("rep"), "component")
    return nodes.join(labels, "rep", "left").select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    )
