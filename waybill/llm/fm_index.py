"""An FM-index over word numbers: backward search through wavelet-matrix ranks, positions from sampled suffixes."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; every separator is a symbol of its own, smaller than all words.

    Only suffixes that share their rank with another are sorted again, so after the first round the work follows the
    repeats inside the shard.
    """
    n = len(symbols)
    breaks = np.flatnonzero(symbols == SEPARATOR)
    first = symbols.astype(np.int64) + len(breaks)
    first[breaks] = np.arange(len(breaks))
    # The first round sorts as many symbols as fit into 62 bits.
    width = max(1, int(first.max(initial=0) + 2).bit_length())
    known = max(1, 62 // width)
    key = first + 1
    for k in range(1, known):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = first[k:] + 1
        key = key << width | ahead
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, key[order])
    while True:
        ordered = rank[order]
        same = ordered[1:] == ordered[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        if not shared.any():
            return order
        at = order[shared]
        ahead = at + known
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        again = np.lexsort((second, rank[at]))
        at, second = at[again], second[again]
        order[shared] = at
        # Ranks are places in the order, so a refined group keeps to the places it had.
        place = np.flatnonzero(shared)
        own = rank[at]
        new = np.r_[True, (own[1:] != own[:-1]) | (second[1:] != second[:-1])]
        rank[at] = np.maximum.accumulate(np.where(new, place, 0))
        known *= 2


def _ranks(order: np.ndarray, ordered_key: np.ndarray) -> np.ndarray:
    """For each suffix the place of the first one with its key."""
    new = np.r_[True, ordered_key[1:] != ordered_key[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


class WaveletMatrix:
    """rank(symbol, place) and access(place) in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for bit in range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1):
            ones = symbols >> bit & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            zeros = len(symbols) - int(count[-1])
            self.levels.append((bit, count, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        # Where each symbol's run begins after the last level.
        self.begin = np.full(alphabet, len(symbols), np.int64)
        if len(symbols):
            first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            self.begin[symbols[first]] = first

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``."""
        place = place.astype(np.int64)
        start = np.zeros_like(place)
        for bit, count, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            c, s = count[place], count[start]
            place = np.where(one, zeros + c, place - c)
            start = np.where(one, zeros + s, start - s)
        return place - start

    def access_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``place`` and its rank there."""
        place = place.astype(np.int64)
        symbol = np.zeros_like(place)
        for bit, count, zeros in self.levels:
            c = count[place]
            one = count[place + 1] > c
            symbol |= one.astype(np.int64) << bit
            place = np.where(one, zeros + c, place - c)
        return symbol, place - self.begin[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        """Index word numbers 1 .. alphabet - 1; ``SEPARATOR`` ends each stretch. ``symbols`` must end with one."""
        n = self.n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], alphabet)
        counts = np.bincount(symbols, minlength=alphabet)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # Sampled suffixes: every ``sample``-th position, and the first of a stretch, which no step may leave.
        sampled = order % sample == 0
        sampled |= symbols[order - 1] == SEPARATOR
        self.sampled = sampled
        self.value = np.where(sampled, order, 0)

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (one per row): their suffix ranges [low, high)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled suffix."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol, rank = self.bwt.access_rank(rows[live])
            rows[live] = self.before[symbol] + rank
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.value[rows] + steps
