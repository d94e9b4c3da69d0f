"""Two-stage suffix sorting: suffixes smaller than their successors are sorted directly, the others follow by bucket scans."""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number that orders as they do; zeros follow the end."""
    words = np.zeros(len(text) + 2 * WORD, np.uint64)
    words[: len(text)] = text
    for width in (1, 2, 4):
        ahead = np.zeros_like(words)
        ahead[:-width] = words[width:]
        words = words << np.uint64(8 * width) | ahead
    return words


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last suffix counts as smaller."""
    n = len(text)
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    # Inside a run of equal bytes the first byte after the run decides.
    decides = np.ones(n, bool)
    decides[:-1] = text[:-1] != text[1:]
    at = np.where(decides, np.arange(n, dtype=np.int32), np.int32(n - 1))
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def with_sources(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """``wanted`` and the suffixes that their places follow from: a larger suffix is placed by its successor."""
    places, none = np.arange(len(wanted), dtype=np.int32), np.int32(-1)
    last_wanted = np.maximum.accumulate(np.where(wanted, places, none))
    last_smaller = np.maximum.accumulate(np.where(smaller, places, none))
    used = last_wanted > none
    used[1:] = last_wanted[1:] > last_smaller[:-1]
    return used


def direct_sort(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the ``depth`` bytes that follow; only those that still share all bytes read so far are read on."""
    if not len(places):
        return places
    key = words[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for at in range(WORD, depth, WORD):
        tied = ~new
        tied[:-1] |= ~new[1:]
        shared = np.flatnonzero(tied)
        if not len(shared):
            break
        group = np.cumsum(new[shared])
        some = places[shared]
        key = words[np.minimum(some + at, len(words) - 1)]
        order = np.lexsort((key, group))
        places[shared], key = some[order], key[order]
        new[shared[1:]] |= key[1:] != key[:-1]
    return places


def two_stage_order(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in ``wanted`` and those they follow from, as their suffixes are ordered by ``depth`` bytes at least.

    A bucket holds the suffixes of one first byte, the larger-than-successor ones before the others. Buckets are scanned
    in order: whoever stands in one names its predecessor's place in its own, or a later, bucket. Runs of the bucket's
    own byte, which would be scanned as they are filled, are unrolled by their length.
    """
    n = len(text)
    smaller = smaller_than_successor(text)
    used = with_sources(wanted, smaller)
    direct = direct_sort(words, np.flatnonzero(used & smaller).astype(np.int32), depth)
    induced = used & ~smaller
    # How many predecessors in a row have the same byte and are induced.
    link = np.zeros(n, bool)
    link[1:] = (text[1:] == text[:-1]) & induced[:-1]
    places = np.arange(n, dtype=np.int32)
    back = places - np.maximum.accumulate(np.where(link, np.int32(0), places))
    del places, link
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    edges = np.searchsorted(text[direct], np.arange(257))
    out = []

    def name_predecessors(places: np.ndarray) -> None:
        earlier = places[places > 0] - 1
        earlier = earlier[induced[earlier] & (text[earlier] != text[earlier + 1])]
        if not len(earlier):
            return
        first = text[earlier]
        order = np.argsort(first, kind="stable")
        first, earlier = first[order], earlier[order]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(first)], strict=True):
            pending[first[a]].append(earlier[a:b])

    for byte in range(256):
        if pending[byte]:
            heads = np.concatenate(pending[byte])
            pending[byte] = []
            runs = back[heads]
            if runs.any():
                step = np.arange(int(runs.sum()) + len(runs)) - np.repeat(np.cumsum(runs + 1) - runs - 1, runs + 1)
                heads = (np.repeat(heads, runs + 1) - step)[np.argsort(step, kind="stable")]
            out.append(heads)
            name_predecessors(heads)
        if edges[byte] < edges[byte + 1]:
            part = direct[edges[byte] : edges[byte + 1]]
            out.append(part)
            name_predecessors(part)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def adjacent_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in ``order`` (the first: 0), ``depth`` at most."""
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, WORD):
        last = len(words) - 1
        apart = words[np.minimum(order[alive - 1] + at, last)] ^ words[np.minimum(order[alive] + at, last)]
        some = apart[apart != 0]
        equal = sum((some < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, WORD))
        shared[alive[apart != 0]] = at + equal
        alive = alive[apart == 0]
        if not len(alive):
            return np.minimum(shared, depth)
    shared[alive] = depth
    return np.minimum(shared, depth)


def repeated_places(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Which of the ``wanted`` places begin ``depth`` bytes that another wanted place begins too.

    ``text`` (bytes above 0, a 0 after each piece) must have ``depth`` bytes of one piece after each wanted place.
    """
    words = words_at(text)
    order = two_stage_order(text, words, wanted, depth)
    order = order[wanted[order]]
    same = adjacent_prefixes(words, order, depth) >= depth
    found = np.zeros(len(text), bool)
    found[order[same]] = True
    found[order[np.flatnonzero(same) - 1]] = True
    return found
