"""Chat formatting: a hidden Markov model over speaker markers and line features recovers the roles of a transcript.

A transcript comes in parts (conv_id, part, text), each with one or more lines. States are the roles, each at the first
line of a turn or further on. All rows are put in one order, dealt by ranges of it, and cut into chunks of so many
rows: every chunk becomes the table of its best path scores between any two states, the tables of a conversation are
chained in two levels (within each range, and over ranges), and each chunk is then decoded between the states at its
ends. That is the exact Viterbi path, and no task reads a whole long conversation or all of its tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waybill.llm.storage import stored

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
K = len(STATES)
# Rows of one chunk at most.
CHUNK = 256

_OPEN, _CLOSE = r"^[\s#>*\[<|({_]*", r"(?:\s+\d+)?[\s\])>|*}_]*(?:[:：>\]|*]|-\s|$)[\s\])>|*:_]*"
MARKERS = {
    "system": re.compile(_OPEN + r"(?:system|sys|instructions?|context)" + _CLOSE, re.I),
    "user": re.compile(_OPEN + r"(?:user|human|you|me|question|q|customer|prompter|visitor)" + _CLOSE, re.I),
    "assistant": re.compile(_OPEN + r"(?:assistant|ai|bot|answer|a|agent|model|gpt|support|response)" + _CLOSE, re.I),
}
LISTED = re.compile(r"^\s*(?:[-*•]\s|\d+[.)]\s|```|\|)")
# Observations: marker (none or a role) x shape (blank, listed, question, other) x length (three classes).
OBSERVATIONS = 4 * 4 * 3


def observe(line: str) -> tuple[int, int]:
    """(observation, letters of the speaker marker at its start)."""
    marker, cut = 0, 0
    if line[:60].strip():
        for k, role in enumerate(ROLES):
            match = MARKERS[role].match(line[:60])
            if match:
                marker, cut = k + 1, match.end()
                break
    rest = line[cut:].strip()
    shape = 0 if not rest else 1 if LISTED.match(rest) else 2 if rest.endswith(("?", "？")) else 3
    length = 0 if len(rest) < 40 else 1 if len(rest) < 200 else 2
    return (marker * 4 + shape) * 3 + length, cut


@dataclass
class Hmm:
    """Log-probabilities; counts are smoothed by one half, so that nothing is impossible but what cannot follow."""

    start: np.ndarray
    move: np.ndarray
    show: np.ndarray

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, show: np.ndarray) -> Hmm:
        allowed = np.array([[b or roles == other for other, b in STATES] for roles, _ in STATES])
        first = np.array([b for _, b in STATES])
        move = np.where(allowed, move + 0.5, 0)
        start = np.where(first, start + 0.5, 0)
        # A role's lines show the same apart from the marker; a marker in mid-turn is a quotation and rare.
        show = show + 0.5
        with np.errstate(divide="ignore"):
            return cls(
                np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(show / show.sum(axis=1, keepdims=True))
            )

    def table(self, seen: list[int]) -> np.ndarray:
        """best[i, j]: the best path over ``seen`` that comes from state i and ends in j; row K starts the conversation."""
        best = None
        for o in seen:
            step = self.show[:, o]
            if best is None:
                best = np.vstack([self.move, self.start]) + step
            else:
                best = (best[:, :, None] + self.move[None]).max(axis=1) + step
        return best

    def path(self, seen: list[int], before: int, last: int) -> list[int]:
        """The best states over ``seen`` between the state ``before`` (K: none) and the last one; the first of equals."""
        score = (self.start if before == K else self.move[before]) + self.show[:, seen[0]]
        back = []
        for o in seen[1:]:
            options = score[:, None] + self.move
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + self.show[:, o]
        found = [last]
        for choice in reversed(back):
            found.append(int(choice[found[-1]]))
        return found[::-1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((conv_id, chunk), rows) of sorted rows whose first two columns are those; a group may span batches."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key, held


def _ordered(parts: DataFrame, *more: str) -> DataFrame:
    """conv_id, part, text and ``more``, dealt by ranges of the order of conversation, part and text and sorted in each.

    A null number comes first. Texts are ordered by their beginnings, then by a hash, as bounds of ranges reach the
    driver. The last key sets equal rows apart, so that they can be dealt over several ranges.
    """
    keys = ["conv_id", "part", F.substring("text", 1, 256), F.xxhash64("text"), *more, "_tie"]
    rows = parts.select("conv_id", "part", F.coalesce("text", F.lit("")).alias("text"), *more)
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")


# Places count up from the partition's number times this.
RANGE = 1 << 33


def _lines(text: str) -> list[str]:
    return text.split("\n")


COUNTS = "kind string, a int, b int, n long"


def learn(parts: DataFrame) -> Hmm:
    """The model from parts whose ``role`` is known; the driver gathers one number per cell of its tables, and the two
    ends of each range of rows, at which conversations may go on."""
    place = {s: k for k, s in enumerate(STATES)}
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([
        ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
        ("conv_id", to_arrow_type(parts.schema["conv_id"].dataType)),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, show = np.zeros(K, np.int64), np.zeros((K, K), np.int64), np.zeros((K, OBSERVATIONS), np.int64)
        state, at, first, any_row = -1, None, -1, False
        first_of = None
        for batch in batches:
            for conv, _, text, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = any_row and conv != at
                if fresh:
                    state = -1
                known = role in ROLES
                if not any_row:
                    first, first_of = place[role, True] if known else -1, conv
                elif fresh and known:
                    start[place[role, True]] += 1
                any_row, at = True, conv
                if not known:
                    state = -1
                    continue
                for n, line in enumerate(_lines(text)):
                    new = place[role, n == 0]
                    if state >= 0:
                        move[state, new] += 1
                    show[new, observe(line)[0]] += 1
                    state = new
        if not any_row:
            return
        rows = [("start", int(a), 0, int(start[a]), None) for a in np.flatnonzero(start)]
        rows += [(k, int(a), int(b), int(t[a, b]), None) for k, t in (("move", move), ("show", show)) for a, b in np.argwhere(t)]
        here = TaskContext.get().partitionId()
        rows += [("first", here, first, 0, first_of), ("last", here, state, 0, at)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    start, move, show = np.zeros(K), np.zeros((K, K)), np.zeros((K, OBSERVATIONS))
    ends: dict[str, dict[int, tuple]] = {"first": {}, "last": {}}
    # The ends of a range have its number in ``a``, so each of them is a group of its own.
    cells = _ordered(parts, "role").mapInArrow(count, f"{COUNTS}, conv_id {kind}").groupBy("kind", "a", "b", "conv_id").agg(F.sum("n").alias("n"))
    for what, a, b, conv, n in cells.collect():
        if what in ends:
            ends[what][a] = (conv, b)
        elif what == "start":
            start[a] = n
        else:
            (move if what == "move" else show)[a, b] = n
    before = None
    for here, (conv, first) in sorted(ends["first"].items()):
        if first >= 0:
            if before is None or before[0] != conv:
                start[first] += 1
            elif before[1] >= 0:
                move[before[1], first] += 1
        before = ends["last"][here]
    return Hmm.of(start, move, show)


def joined(tables: list[np.ndarray]) -> np.ndarray:
    """The table of several stretches that follow each other."""
    whole = tables[0]
    for table in tables[1:]:
        whole = (whole[:, :, None] + table[None, :K]).max(axis=1)
    return whole


def chained(tables: list[np.ndarray], before: int, last: int | None) -> list[tuple[int, int]]:
    """The states before and at the end of each stretch on the best path from ``before`` to ``last`` (None: any)."""
    scores = [tables[0][before]]
    for table in tables[1:]:
        scores.append((scores[-1][:, None] + table[:K]).max(axis=0))
    last = int(scores[-1].argmax()) if last is None else last
    found = []
    for n in range(len(tables) - 1, -1, -1):
        start = before if n == 0 else int((scores[n - 1] + tables[n][:K, last]).argmax())
        found.append((start, last))
        last = start
    return found[::-1]


def parse_transcripts(parts: DataFrame, model: Hmm) -> DataFrame:
    """Per run of lines of one turn within a part: conv_id, part, segment, role, continues, text, rendered.

    ``text`` has no speaker marker; ``continues`` says that the turn began in an earlier part or segment; ``rendered``
    is the canonical form. A null or empty text is one empty line. Parts that repeat are decoded as they come; a null
    conv_id is a conversation of its own. Columns besides conv_id, part and text are not read. An empty table gives
    none.
    """
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = parts.schema["conv_id"].dataType.simpleString()
    part_kind = parts.schema["part"].dataType.simpleString()
    part_type = to_arrow_type(parts.schema["part"].dataType)
    id_type = to_arrow_type(parts.schema["conv_id"].dataType)

    table_schema = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("best", pa.list_(pa.float64()))])
    ends_schema = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])

    def written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows:
            out.append(row)
            if len(out) >= 2_000:
                yield written(out, schema)
                out = []
        if out:
            yield written(out, schema)

    def as_table(cells: list[float]) -> np.ndarray:
        return np.array(cells).reshape(K + 1, K)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        found = (
            (conv, chunk, hmm.table([observe(line)[0] for row in rows for line in _lines(row[3])]).ravel().tolist())
            for (conv, chunk), rows in _chunks(batches)
        )
        yield from flushed(found, table_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, rng, joined([as_table(r[3]) for r in rows]).ravel().tolist()) for (conv, rng), rows in _chunks(batches))
        yield from flushed(found, table_schema)

    def over_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (conv, row[2], before, last)
            for (conv, _), rows in _chunks(batches)
            for row, (before, last) in zip(rows, chained([as_table(r[3]) for r in rows], K, None), strict=True)
        )
        yield from flushed(found, ends_schema)

    def within_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (conv, row[2], before, last)
            for (conv, _), rows in _chunks(batches)
            for row, (before, last) in zip(rows, chained([as_table(r[3]) for r in rows], *rows[0][4:]), strict=True)
        )
        yield from flushed(found, ends_schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        schema = pa.schema([
            ("conv_id", id_type), ("part", part_type), ("segment", pa.int32()),
            ("role", pa.string()), ("continues", pa.bool_()), ("text", pa.string()), ("rendered", pa.string()),
        ])

        def segments() -> Iterator[tuple]:
            for (conv, _), rows in _chunks(batches):
                lines = [(k, line) for k, row in enumerate(rows) for line in _lines(row[3])]
                seen = [observe(line) for _, line in lines]
                path = hmm.path([o for o, _ in seen], *rows[0][4:])
                segment, at = 0, None
                held: list[str] = []
                out: list[list] = []
                for (k, line), (_, cut), state in zip(lines, seen, path, strict=True):
                    role, first = STATES[state]
                    if first or at != k:
                        segment = 0 if at != k else segment + 1
                        held = []
                        out.append([conv, rows[k][2], segment, role, not first, held])
                        at = k
                    held.append(line[cut:] if first else line)
                for *row, kept in out:
                    text = "\n".join(kept).strip()
                    yield (*row, text, f"<|{row[3]}|>\n{text}\n<|end|>")

        yield from flushed(segments(), schema)

    placed = _ordered(parts).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, "chat-parts").withColumn("chunk", F.floor(F.col("at") / CHUNK).cast("long"))
    rows = placed.select("conv_id", "chunk", "part", "text", "at").repartition("chunk").sortWithinPartitions("chunk", "at")
    kinds = f"conv_id {kind}, chunk long, best array<double>"
    ends_kinds = f"conv_id {kind}, chunk long, before int, last int"
    best = stored(rows.drop("at").mapInArrow(tables, kinds), "chat-tables")
    best = best.withColumn("rng", F.floor(F.col("chunk") * CHUNK / RANGE).cast("long"))

    by_range = best.select("conv_id", "rng", "chunk", "best").repartition("conv_id", "rng").sortWithinPartitions("conv_id", "rng", "chunk")
    whole = by_range.mapInArrow(fold, kinds).select("conv_id", F.lit(0).alias("all"), F.col("chunk").alias("rng"), "best")
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "rng").mapInArrow(over_ranges, ends_kinds)
    whole = whole.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_rng"), "before", "last")

    ends = best.join(whole, best.conv_id.eqNullSafe(F.col("_conv")) & (F.col("rng") == F.col("_rng")))
    ends = ends.select("conv_id", "rng", "chunk", "best", "before", "last").repartition("conv_id", "rng").sortWithinPartitions("conv_id", "rng", "chunk")
    ends = ends.mapInArrow(within_ranges, ends_kinds)
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "before", "last")

    both = placed.join(ends, placed.conv_id.eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    both = both.select("conv_id", "chunk", "part", "text", "before", "last", "at").repartition("chunk").sortWithinPartitions("chunk", "at")
    return both.drop("at").mapInArrow(
        decode, f"conv_id {kind}, part {part_kind}, segment int, role string, continues boolean, text string, rendered string"
    )
