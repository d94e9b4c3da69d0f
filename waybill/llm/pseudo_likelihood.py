"""Masked pseudo-likelihood: a window network predicts every word from both of its sides.

Words are counted over all documents. The most frequent ones are symbols of their own, the rest share hashed symbols,
within which every word has its own share by its own count: frequent counts go to all tasks, the others are joined. A network with one hidden layer, trained in numpy, gives the symbol's
probability from the two words on each side; a document's score is the sum of the conditional log-probabilities of all
its words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.decontaminate import words_of

OFFSETS = (-2, -1, 1, 2)
OUT, IN, HIDDEN = 128, 1024, 24
# Symbols of single words: on the output side, and on the input side. Symbol 0 is the edge of a document.
OWN_OUT, OWN_IN = 95, 767
# Counts of so many words go to every task; the others are joined.
HELD = 50_000
CELLS = (1 << 20) - 1
SEED = 42
# Words that are scored, and trained on, at once: as many as stay in a core's cache.
STEP_TOKENS = 2_048
TRAIN_TOKENS = 2_048
RATE = 0.1
# Products are taken by so many rows: larger ones are split among threads, which cost more than they save at this size.
BLOCK = 64
# Texts are scored together until they have so many words: what a call costs is then small beside its words.
GROUP_TOKENS = 16_384
# Logits between plus and minus this stay in the range of single precision without their maximum taken off.
SAFE_LOGIT = 60.0
CACHE_WORDS = 200_000
EDGES = np.zeros(2, np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks count the words they read before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counted.update(words_of(text.as_py()))
                if len(counted) > CACHE_WORDS:
                    yield from _counts(counted)
                    counted.clear()
        yield from _counts(counted)

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(counted: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    if counted:
        columns = [pa.array([*counted], pa.binary()), pa.array([*counted.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])


@dataclass
class Vocabulary:
    """``own``: rank of the most frequent words (from 1); ``held``: counts of those that go to every task; ``total``: sum
    of count + 1 per output symbol, and one more for a word that was not counted; ``counted``: all words, for joins."""

    own: dict[bytes, int]
    held: dict[bytes, int]
    total: list[float]
    counted: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame) -> Vocabulary:
        """The most frequent words and one total per output symbol reach the driver; all counts stay in a table."""
        from waybill.llm.storage import stored

        counted = stored(word_counts(docs), "word-counts")
        top = counted.orderBy(F.desc("n"), "word").limit(HELD).collect()
        held = {bytes(r.word): r.n for r in top}
        made = cls({w: k for k, w in enumerate(held, 1) if k <= OWN_IN}, held, [1.0] * OUT, counted)
        for row in counted.groupBy(_symbol("word").alias("symbol")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
            made.total[row.symbol] += row.n
        for word, k in made.own.items():
            if k <= OWN_OUT:  # words with a symbol of their own do not weigh on the shared ones
                made.total[made.shared(word, OWN_OUT, OUT)] -= held[word] + 1
        return made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counted": None}

    @staticmethod
    def shared(word: bytes, own: int, size: int) -> int:
        return own + 1 + (xxhash.xxh64_intdigest(word, SEED) & CELLS) % (size - own - 1)

    def share(self, out: int, n: int) -> float:
        return math.log((n + 1) / self.total[out])

    def look_up(self, word: bytes) -> tuple[int, int, float]:
        """Input symbol, output symbol, and the word's log-share of its output symbol; NaN if its count is not held."""
        own = self.own.get(word, 0)
        if 0 < own <= OWN_OUT:
            return own, own, 0.0
        out, n = self.shared(word, OWN_OUT, OUT), self.held.get(word)
        return own or self.shared(word, OWN_IN, IN), out, math.nan if n is None else self.share(out, n)


def _symbol(word: str) -> Column:
    """The shared output symbol of a word, as ``Vocabulary.shared`` has it."""
    cell = F.xxhash64(word).bitwiseAND(F.lit(CELLS).cast("long"))
    return (F.lit(OWN_OUT + 1) + cell % F.lit(OUT - OWN_OUT - 1)).cast("int")


class Numbers(dict[bytes, int]):
    """Numbers of words; a word that is looked up for the first time gets the next one."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


class Reader:
    """Texts as symbols, with two edges on each side."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.log_total = np.log(np.array(vocabulary.total))
        self.clear()

    def clear(self) -> None:
        self.known, self.learned = Numbers(), 0
        self.given, self.wanted, self.shares = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def number(self, texts: list[list[bytes]]) -> np.ndarray:
        """Numbers of all words of texts, which are valid until the next call: positions in ``given`` (input symbols),
        ``wanted`` (output symbols) and ``shares`` (log-shares, NaN where the count is not held)."""
        if self.learned > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if len(self.known) > self.learned:
            self._learn()
        return at

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Input symbols between edges, and output symbols, of all words."""
        at = self.number([words_of(text)])
        return np.concatenate([EDGES, self.given[at], EDGES]), self.wanted[at]

    def _learn(self) -> None:
        """What ``Vocabulary.look_up`` says of each new word, for all of them at once."""
        words, start, size = self.known.words[self.learned :], self.learned, len(self.known)
        if size > len(self.shares):  # room is doubled, so that texts with a new word each do not copy all that are known
            more = np.zeros(2 * size - len(self.shares), np.int64)
            self.given, self.wanted = np.concatenate([self.given, more]), np.concatenate([self.wanted, more])
            self.shares = np.concatenate([self.shares, more.astype(float)])
        own, held = self.vocabulary.own, self.vocabulary.held
        rank = np.array([own.get(w, 0) for w in words])
        n = np.array([held.get(w, math.nan) for w in words], float)
        cell = np.array([xxhash.xxh64_intdigest(w, SEED) & CELLS for w in words])
        alone = (rank > 0) & (rank <= OWN_OUT)
        out = np.where(alone, rank, OWN_OUT + 1 + cell % (OUT - OWN_OUT - 1))
        self.given[start:size] = np.where(rank > 0, rank, OWN_IN + 1 + cell % (IN - OWN_IN - 1))
        self.wanted[start:size] = out
        self.shares[start:size] = np.where(alone, 0.0, np.log(n + 1) - self.log_total[out])
        self.learned = size


def _product(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``rows @ matrix``"""
    out, whole = np.empty((len(rows), matrix.shape[1]), np.float32), len(rows) // BLOCK * BLOCK
    np.matmul(rows[:whole].reshape(-1, BLOCK, rows.shape[1]), matrix, out=out[:whole].reshape(-1, BLOCK, matrix.shape[1]))
    np.matmul(rows[whole:], matrix, out=out[whole:])
    return out


def _gram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right``"""
    whole = len(left) // BLOCK * BLOCK
    parts = left[:whole].reshape(-1, BLOCK, left.shape[1]).transpose(0, 2, 1) @ right[:whole].reshape(-1, BLOCK, right.shape[1])
    return parts.sum(axis=0) + left[whole:].T @ right[whole:]


@dataclass
class Network:
    embed: np.ndarray  # (offset, input symbol, hidden)
    bias: np.ndarray
    weight: np.ndarray
    level: np.ndarray

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        shapes = ((len(OFFSETS), IN, HIDDEN), (HIDDEN,), (HIDDEN, OUT), (OUT,))
        return cls(*(rng.normal(0, 0.1 if len(s) > 1 else 0, s).astype(np.float32) for s in shapes))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.bias, self.weight, self.level)])

    @classmethod
    def shaped(cls, flat: np.ndarray) -> Network:
        like, at, found = cls.fresh(), 0, []
        for x in (like.embed, like.bias, like.weight, like.level):
            found.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return cls(*found)

    def _logits(self, around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values, and the logits of all output symbols, less what keeps their powers in range."""
        hidden = self.embed[0][around[0]]
        hidden += self.bias
        for table, symbols in zip(self.embed[1:], around[1:], strict=True):
            hidden += table[symbols]
        np.tanh(hidden, out=hidden)
        logits = _product(hidden, self.weight)
        logits += self.level
        if not self._bound() < SAFE_LOGIT:
            logits -= logits.max(axis=1, keepdims=True)
        return hidden, logits

    def _bound(self) -> float:
        """No logit is further from 0, as hidden values lie between -1 and 1."""
        return float((np.abs(self.weight).sum(axis=0) + np.abs(self.level)).max())

    def forward(self, around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values, and probabilities of all output symbols."""
        hidden, logits = self._logits(around)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return hidden, logits

    def chosen(self, around: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
        """Log-probabilities of the wanted symbols."""
        _, logits = self._logits(around)
        own = logits[np.arange(len(wanted)), wanted]
        np.exp(logits, out=logits)
        return own - np.log(logits.sum(axis=1))


class Trainer:
    """Adagrad over batches of words."""

    def __init__(self, network: Network):
        self.network = network
        self.square = [np.full_like(x, 1e-6) for x in (network.embed, network.bias, network.weight, network.level)]

    def step(self, around: list[np.ndarray], wanted: np.ndarray) -> None:
        net = self.network
        hidden, error = net._logits(around)
        np.exp(error, out=error)
        size = error.sum(axis=1)
        error[np.arange(len(wanted)), wanted] -= size
        size *= len(wanted)
        # The error is left larger by ``size``, which is taken out of what is smaller than it.
        back = _product(error, net.weight.T)
        back /= size[:, None]
        back *= 1 - hidden * hidden
        hidden /= size[:, None]
        self._move(net.weight, self.square[2], _gram(hidden, error))
        self._move(net.level, self.square[3], (1 / size) @ error)
        self._move(net.bias, self.square[1], back.sum(axis=0))
        for table, square, symbols in zip(net.embed, self.square[0], around, strict=True):
            order = np.argsort(symbols.astype(np.int16), kind="stable")  # sixteen bits are sorted by their digits
            ordered = symbols[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            rows = ordered[first]
            change = np.add.reduceat(back[order], first, axis=0)
            square[rows] += change * change
            table[rows] -= RATE * change / np.sqrt(square[rows])

    @staticmethod
    def _move(value: np.ndarray, square: np.ndarray, change: np.ndarray) -> None:
        square += change * change
        value -= RATE * change / np.sqrt(square)


def _windows(texts: Iterator[bytes | None], reader: Reader) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Batches of (symbols at each offset, wanted symbols) over all words."""
    held: list[list[np.ndarray]] = [[] for _ in range(len(OFFSETS) + 1)]
    size = 0
    for text in texts:
        given, wanted = reader(text)
        for at in range(0, len(wanted), TRAIN_TOKENS):
            part = wanted[at : at + TRAIN_TOKENS]
            for k, offset in enumerate(OFFSETS):
                held[k].append(given[2 + offset + at : 2 + offset + at + len(part)])
            held[-1].append(part)
            size += len(part)
            if size >= TRAIN_TOKENS:
                *around, wanted_now = (np.concatenate(x) for x in held)
                yield around, wanted_now
                held, size = [[] for _ in held], 0
    if size:
        *around, wanted_now = (np.concatenate(x) for x in held)
        yield around, wanted_now


WEIGHTS = "salt int, tokens long, weights binary"
WEIGHTS_ARROW = pa.schema([("salt", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])


def train(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """One pass over all words of all documents: every task trains from the same start on its own documents, and the
    networks are averaged by the words they saw. Networks are added up in parts before they reach the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, reader, tokens = Trainer(Network.fresh()), Reader(shared.value), 0
        texts = (t.as_py() for batch in batches for t in batch.column(0))
        for around, wanted in _windows(texts, reader):
            trainer.step(around, wanted)
            tokens += len(wanted)
        if tokens:
            weights = (trainer.network.flat().astype(np.float64) * tokens).astype("<f4").tobytes()
            salt = xxhash.xxh32_intdigest(weights) % 32
            yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([tokens], pa.int64()), pa.array([weights])], schema=WEIGHTS_ARROW)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(blob.as_py(), "<f4").astype(np.float64)
                total = part if total is None else total + part
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.astype("<f4").tobytes()])], schema=WEIGHTS_ARROW
            )

    fitted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(fit, WEIGHTS)
    tokens, total = 0, None
    for row in fitted.repartition("salt").mapInArrow(add, WEIGHTS).toLocalIterator():
        part = np.frombuffer(bytes(row.weights), "<f4").astype(np.float64)
        total = part if total is None else total + part
        tokens += row.tokens
    return Network.shaped(total / tokens) if tokens else Network.fresh()


@dataclass
class Scores:
    """Of some texts: words, sums of log-probabilities without the shares that are not held, and the words which lack
    them: ``rest`` distinct ones per text, in the order of texts, each so many ``times``."""

    sizes: np.ndarray
    totals: np.ndarray
    rest: np.ndarray
    words: list[bytes]
    times: np.ndarray


def score_texts(texts: list[bytes | None], reader: Reader, network: Network) -> Scores:
    split = [words_of(t) for t in texts]
    sizes, at = np.array([len(w) for w in split], np.int64), reader.number(split)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(at)) + 2 * owner + 2  # two edges before, between and behind the texts
    given = np.zeros(len(at) + 2 * len(texts) + 2, np.int64)
    given[place] = reader.given[at]
    # Blocks are filled up with edges, so that a text's score does not depend on the place of its words in a block.
    spare = np.zeros(-len(at) % BLOCK, np.int64)
    place, wanted = np.concatenate([place, spare + 2]), np.concatenate([reader.wanted[at], spare])
    steps = (slice(k, k + STEP_TOKENS) for k in range(0, len(place), STEP_TOKENS))
    found = [np.zeros(0), *(network.chosen([given[place[s] + o] for o in OFFSETS], wanted[s]) for s in steps)]
    share = reader.shares[at]
    lacking = np.isnan(share)
    share[lacking] = 0
    totals = np.bincount(owner, np.concatenate(found)[: len(at)] + share, len(texts))
    room = max(len(reader.known), 1)
    pairs, times = np.unique(owner[lacking] * room + at[lacking], return_counts=True)
    words = [reader.known.words[k] for k in (pairs % room).tolist()]
    return Scores(sizes, totals, np.bincount(pairs // room, minlength=len(texts)), words, times)


def score(text: bytes | None, reader: Reader, network: Network) -> tuple[int, float]:
    """Words of a text, and the sum of their conditional log-probabilities; words whose count is not held lack their share."""
    found = score_texts([text], reader, network)
    return int(found.sizes[0]), float(found.totals[0])


def _groups(column: pa.Array) -> Iterator[list[bytes | None]]:
    """Texts in their order, some at a time."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1] or b"") // 6 + 1
        if size >= GROUP_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rest(found: list[Scores]) -> pa.Array:
    """Per text: the words that lack their share, and how often they occur."""
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([f.rest for f in found]))])
    words = pa.array(chain.from_iterable(f.words for f in found), pa.binary())
    times = pa.array(np.concatenate([f.times for f in found]), pa.int64())
    pairs = pa.StructArray.from_arrays([words, times], names=["word", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def score_documents(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """Per document: doc_id, n_words, pseudo_likelihood (natural log), per_word (null without words).

    Whole texts are scored where they are read, but for the shares of words whose counts are not held by the tasks: those
    words are joined with the counts of all words. A null or empty text has no words and a score of 0. Every input row
    gives one row; columns other than doc_id and text are not read.
    """
    from waybill.llm.storage import stored

    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        reader, row = Reader(words), TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [score_texts(texts, reader, net) for texts in _groups(batch.column(1))]
            n = np.concatenate([f.sizes for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(n)), pa.int64()), batch.column(0), pa.array(n, pa.int64()),
                    pa.array(np.concatenate([f.totals for f in found]), pa.float64()), _rest(found),
                ],
                names=["row", "doc_id", "n_words", "total", "rest"],
            )
            row += len(n)

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kinds = f"row long, doc_id {kind}, n_words long, total double, rest array<struct<word:binary,times:long>>"
    begun = stored(texts.mapInArrow(run, kinds), "scores")
    totals = F.array(*[F.lit(x) for x in vocabulary.total])
    n = F.coalesce("n", F.lit(0)) + 1
    rest = begun.select("row", F.inline("rest")).join(vocabulary.counted, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log(n / F.get(totals, _symbol("word")))).alias("_share"))
    total = F.col("total") + F.coalesce("_share", F.lit(0.0))
    return begun.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_words", total.alias("pseudo_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word")
    )
