"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are rates over the whole text: hits of lexica (whole words, word beginnings, and words as they read once
disguises are undone), how near they stand to the second person, capitals, punctuation and signs of obfuscation. The
lexica are learned from labelled training rows too; nothing but the text enters a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored

# The classifier is fitted on at most so many labelled rows, those with the smallest hash of their id.
TRAINING_ROWS = 20_000
# Longest lexicon of each kind, the rows that a term must occur in, and its least log-odds.
LEXICON_TERMS = 4_000
LEXICON_ROWS = 3
LEXICON_ODDS = 2.5
NEAR_WORDS = 6
# Terms that one task counts before it sends them on.
HELD_TERMS = 50_000
CALIBRATION_FOLDS = 4
PREFIXES = (4, 5, 6)

WORD = re.compile(r"[^\W_]+")
# A word written with signs or digits for letters, or with letters set apart by signs: 1d!ot, s.t.u.p.i.d, i d i o t.
DISGUISED = re.compile(
    r"[0-9@$!|]++[^\W\d_]++(?:[0-9@$!|*+.\-_]++[^\W\d_]++)*+|(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*+.\-_]++[^\W\d_]++)++"
)
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
DIGIT_INSIDE = re.compile(r"[^\W\d_][0-9@$][^\W\d_]")
LOOKS_LIKE = str.maketrans("01345789@$!|+", "oieastbgasiit")
APART = re.compile(r"[*.\-_+|!]+")
REPEATED = re.compile(r"(\w)\1{2,}")
PUNCTUATION = re.compile(r"[!?]{2,}")
# A sign or digit before a letter, without which no word is disguised.
SIGN_BEFORE = re.compile(r"[0-9@$!|*+.\-_][^\W\d_]")
# Plain English insults, which stand in the lexicon even where too few labels teach them.
SEED_WORDS = frozenset(
    "idiot idiots idiotic stupid stupidity moron morons moronic dumb dumbass fool fools foolish loser losers pathetic worthless "
    "disgusting scum trash garbage filth filthy vermin clown clowns jerk jerks creep creeps imbecile cretin dimwit halfwit "
    "bastard bastards bitch asshole shit fuck fucking retard retarded scumbag lowlife maggot parasite".split()
)
SEED_ODDS = 3.0
# Second person in the languages of the corpus and a few more.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros você seu sua".split()
)

FEATURES = [
    "word_rate", "word_weight", "word_top", "word_kinds", "start_rate", "start_weight", "start_top", "disguised_rate",
    "disguised_top", "near_you", "you_rate", "capital_rate", "shouted_rate", "mark_rate", "mark_runs", "sign_rate",
    "digit_in_word_rate", "repeat_rate", "spaced_rate", "log_words",
]


def terms(text: str) -> tuple[set[str], set[str]]:
    """Distinct words and distinct word beginnings of a text."""
    words = set(WORD.findall(text.lower()))
    return words, {w[:n] for w in words for n in PREFIXES if len(w) > n}


def repeats_thrice(text: str) -> bool:
    """Whether a letter, digit or underscore stands three times in a row, by comparing whole arrays of characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = codes[1:] == codes[:-1]
    found = codes[2:][same[1:] & same[:-1]]
    return any(c == "_" or c.isalnum() for c in map(chr, np.unique(found).tolist()))


@dataclass
class Lexica:
    """Log-odds of terms that mark label 1."""

    words: dict[str, float]
    starts: dict[str, float]

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(start[: PREFIXES[0]] for start in self.starts)

    @classmethod
    def learn(cls, counts: list[tuple[str, str, int, int]], n0: int, n1: int) -> Lexica:
        """``counts``: (kind, term, rows with label 0, rows with label 1)."""
        made = cls({}, {})
        for kind, held in (("w", made.words), ("s", made.starts)):
            scored = []
            for k, term, c0, c1 in counts:
                odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
                if k == kind and c1 >= LEXICON_ROWS and odds >= LEXICON_ODDS:
                    scored.append((-odds * np.sqrt(c1), term, float(odds)))
            held.update((term, odds) for _, term, odds in sorted(scored)[:LEXICON_TERMS])
        usual = {term for k, term, c0, c1 in counts if k == "w" and c0 > c1}
        made.words = {w: SEED_ODDS for w in sorted(SEED_WORDS - usual)} | made.words
        return made

    def features(self, text: str | None) -> list[float]:
        """The values of ``FEATURES``; all are defined for a null or empty text.

        Each costly pattern runs only where a cheap test over the whole text leaves it a chance.
        """
        text = text or ""
        low = text.lower()
        tokens = WORD.findall(low)
        n, chars = max(1, len(tokens)), max(1, len(text))
        hits: list[tuple[int, float]] = []
        counted = Counter(tokens)
        weights = {w: self.words[w] for w in counted if w in self.words}
        starts = {}
        for w in counted:
            if w[: PREFIXES[0]] in self.heads:
                best = max((self.starts.get(w[:k], 0.0) for k in PREFIXES if len(w) > k), default=0.0)
                if best:
                    starts[w] = best
        marked = {**starts, **weights}
        if marked:
            hits = [(k, marked[w]) for k, w in enumerate(tokens) if w in marked]
        seconds = [k for k, w in enumerate(tokens) if w in SECOND_PERSON]
        near = 0
        if hits and seconds:
            at = np.array(seconds)
            where = np.array([k for k, _ in hits])
            place = np.searchsorted(at, where)
            gap = np.minimum(
                np.abs(at[np.minimum(place, len(at) - 1)] - where), np.abs(at[np.maximum(place - 1, 0)] - where)
            )
            near = int((gap <= NEAR_WORDS).sum())
        disguised = []
        signed = [p for p in low.split() if SIGN_BEFORE.search(p)] if SIGN_BEFORE.search(low) else []
        for match in (m for p in signed for m in DISGUISED.findall(p)):
            for plain in {APART.sub("", match).translate(LOOKS_LIKE), APART.sub("", match.translate(LOOKS_LIKE))}:
                if plain in self.words and plain not in counted:
                    disguised.append(self.words[plain])
        # A spaced-out word is three words of one letter at least.
        spaced = SPACED.findall(low) if b"\1\1\1" in bytes([len(w) == 1 for w in tokens]) else []
        disguised += [self.words[w] for w in (s.replace(" ", "") for s in spaced) if w in self.words]
        repeated = repeats_thrice(low)
        shrunk = [REPEATED.sub(r"\1", w) for w in counted if REPEATED.search(w)] if repeated else []
        disguised += [self.words[w] for w in shrunk if w in self.words]
        word_hits = sum(counted[w] for w in weights)
        start_hits = sum(counted[w] for w in starts)
        solid = max(1, len(text) - text.count(" ") - text.count("\n"))
        marks = text.count("!") + text.count("?")
        capitals = list(map(len, CAPITALS.findall(text)))
        return [
            word_hits / n, sum(weights[w] * counted[w] for w in weights) / n, max(weights.values(), default=0.0), float(len(weights)),
            start_hits / n, sum(starts[w] * counted[w] for w in starts) / n, max(starts.values(), default=0.0),
            len(disguised) / n, max(disguised, default=0.0), near / n, len(seconds) / n,
            sum(capitals) / solid, len(SHOUTED.findall(text)) / n if max(capitals, default=0) > 2 else 0.0, marks / chars,
            len(PUNCTUATION.findall(text)) / n if marks > 1 else 0.0, (len(text) - sum(map(len, tokens)) - text.count(" ") - text.count("\n")) / chars,
            sum(len(DIGIT_INSIDE.findall(p)) for p in signed) / n, len(REPEATED.findall(low)) / n if repeated else 0.0, len(spaced) / n, float(np.log1p(len(tokens))),
        ]


# --- boosted trees -----------------------------------------------------------------------------------------------

TREES, DEPTH, RATE, BINS, LEAF_WEIGHT, LEAST_ROWS = 60, 3, 0.15, 64, 1.0, 3


@dataclass
class Trees:
    """Complete trees of a fixed depth: ``feature``/``edge`` per inner node, ``value`` per leaf."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Second-order boosting of the logistic loss over histograms of the features."""
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        base = float(np.log(rate / (1 - rate)))
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        feature, edge = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
        value = np.zeros((TREES, leaves))
        if not len(y):
            return cls(base, feature, edge, value)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f, cuts in enumerate(edges):
                    if not len(cuts):
                        continue
                    size = width * (len(cuts) + 1)
                    slot = node * (len(cuts) + 1) + bins[:, f]
                    hist = [np.bincount(slot, w, size).reshape(width, -1).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                    (gl, gt), (hl, ht), (nl, nt) = ((a[:, :-1], a[:, -1:]) for a in hist)
                    gain = gl**2 / (hl + LEAF_WEIGHT) + (gt - gl) ** 2 / (ht - hl + LEAF_WEIGHT) - gt**2 / (ht + LEAF_WEIGHT)
                    gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for w in np.flatnonzero(top > best):
                        best[w] = top[w]
                        feature[t, first + w], edge[t, first + w] = f, cuts[k[w]]
                own = first + node
                node = 2 * node + (x[np.arange(len(y)), feature[t, own]] > edge[t, own])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            value[t] = -RATE * gs / (hs + LEAF_WEIGHT)
            margin += value[t][node]
        return cls(base, feature, edge, value)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in zip(self.feature, self.edge, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                own = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[own]] > edge[own])
            total += value[node]
        return total


@dataclass
class Isotonic:
    """A rising step function by pooling adjacent violators, read with straight lines between its steps."""

    at: np.ndarray
    level: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(score):
            return cls(np.zeros(1), np.zeros(1))
        points, where = np.unique(score, return_inverse=True)
        weight = np.bincount(where).astype(float)
        blocks: list[list[float]] = []  # mean, weight, first, last
        for k, mean in enumerate(np.bincount(where, y) / weight):
            blocks.append([mean, weight[k], points[k], points[k]])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                mean2, weight2, _, last = blocks.pop()
                own = blocks[-1]
                own[0] = (own[0] * own[1] + mean2 * weight2) / (own[1] + weight2)
                own[1], own[3] = own[1] + weight2, last
        at = np.array([p for b in blocks for p in (b[2], b[3])])
        return cls(at, np.repeat([b[0] for b in blocks], 2))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.level), 0.0, 1.0)


@dataclass
class Model:
    lexica: Lexica
    trees: Trees
    calibration: Isotonic

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Texts may be an iterator: only their features are held together."""
        x = np.array([self.lexica.features(t) for t in texts], float)
        return self.calibration(self.trees.margin(x)) if len(x) else np.zeros(0)


def _training_rows(docs: DataFrame, labels: DataFrame, training_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out third; at most ``training_rows`` of them."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


TERM_COUNTS = "kind string, term string, fold int, c0 long, c1 long"
TERM_ARROW = pa.schema([
    ("kind", pa.string()), ("term", pa.string()), ("fold", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64()),
])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of either label that hold a term, by fold; a task sends what it has counted when it holds many."""
    counts: dict[tuple[str, str, int], list[int]] = {}
    for batch in batches:
        for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, starts = terms(text.as_py() or "")
            for kind, found in (("w", words), ("s", starts)):
                for term in found:
                    counts.setdefault((kind, term, fold), [0, 0])[label] += 1
            if len(counts) > HELD_TERMS:
                yield from _counted(counts)
                counts = {}
    yield from _counted(counts)


def _counted(counts: dict[tuple[str, str, int], list[int]]) -> Iterator[pa.RecordBatch]:
    rows = ((*k, *c) for k, c in counts.items())
    while part := [*islice(rows, 10_000)]:
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TERM_ARROW, strict=True)], schema=TERM_ARROW)


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """A model of ``labels.toxic``, learned only from rows whose crc32(doc_id as text) mod 3 is not 1.

    At most ``training_rows`` labelled rows are used (the smallest by hash of the id), so what the driver gathers is
    bounded: their features, and the terms that enough of them share. Lexica for the calibration folds are learned
    without the fold, so that calibration sees scores of rows that the model did not learn from. Without labels of
    both kinds, every score is the same.
    """
    rows = _training_rows(docs, labels, training_rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATION_FOLDS)).cast("int")
    spark = docs.sparkSession
    gathered = rows.select("doc_id", "text", "toxic", fold.alias("fold"))
    gathered = stored(gathered, "toxicity-training")
    # Term counts per fold, so that any set of folds adds up to its own lexica.
    counted = gathered.select("text", "toxic", "fold").mapInArrow(_count_terms, TERM_COUNTS)
    counted = counted.groupBy("kind", "term", "fold").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    per_term = counted.groupBy("kind", "term").agg(
        F.collect_list(F.struct("fold", "c0", "c1")).alias("folds"), F.sum("c1").alias("all1"), F.sum("c0").alias("all0")
    )
    # Only terms that could enter a lexicon are gathered: frequent enough, and more so among label 1.
    sizes = {(r.fold, r.toxic): r["count"] for r in gathered.groupBy("fold", "toxic").count().collect()}
    n0, n1 = (sum(v for (_, y), v in sizes.items() if y == label) for label in (0, 1))
    likely = per_term.where(F.col("all1") >= LEXICON_ROWS).where(
        (F.col("all1") + 0.5) / (n1 + 1) >= (F.col("all0") + 0.5) / (n0 + 1) * float(np.exp(LEXICON_ODDS / 2))
    )
    found = likely.collect()

    def lexica(without: int | None) -> Lexica:
        kept = [
            (r.kind, r.term, sum(f.c0 for f in r.folds if f.fold != without), sum(f.c1 for f in r.folds if f.fold != without))
            for r in found
        ]
        m0, m1 = (sum(v for (f, y), v in sizes.items() if y == label and f != without) for label in (0, 1))
        return Lexica.learn(kept, m0, m1)

    by_fold = spark.sparkContext.broadcast([lexica(k) for k in range(CALIBRATION_FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                by_fold.value[f].features(t.as_py()) for t, f in zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array(values, pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "fold", "x"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = gathered.mapInArrow(measure, f"doc_id {kind}, toxic int, fold int, x array<double>").toPandas()
    measured = measured.sort_values("doc_id")
    x = np.array(measured["x"].tolist(), float).reshape(len(measured), len(FEATURES))
    y, folds = measured["toxic"].to_numpy(float), measured["fold"].to_numpy()
    outside = np.zeros(len(y))
    for k in range(CALIBRATION_FOLDS):
        outside[folds == k] = Trees.fit(x[folds != k], y[folds != k]).margin(x[folds == k])
    return Model(lexica(None), Trees.fit(x, y), Isotonic.fit(outside, y))


def held_out(doc_id: str) -> bool:
    return zlib.crc32(doc_id.encode()) % 3 == 1


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0) in front of its own columns.

    Every whole text is scored where it is read, without a shuffle; a null text scores like an empty one. Columns of
    ``docs`` that have these ``names`` are replaced; give others to keep them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(*[c for c in docs.columns if c.lower() not in names])
    at = rest.columns.index("text")
    schema = f"`{names[0]}` double, `{names[1]}` int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(t.as_py() for t in batch.column(at))
            added = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*added, *batch.columns], names=[*names, *batch.schema.names])

    return rest.mapInArrow(run, schema)
