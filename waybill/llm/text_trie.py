"""Compressed tries over whole texts, and routes by prefixes that grow where texts are many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored

# Bytes of the shortest prefix that texts are dealt by, and how many times longer one is that holds too much.
FIRST_BYTES = 16
GROWTH = 8


class Node:
    """A place in the trie: edges by their first byte, and what is kept for the text that ends here."""

    __slots__ = ("edges", "payload")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, int, int, Node]] = {}
        self.payload = None


def shared_length(a: bytes, a_at: int, b: bytes, b_at: int, most: int) -> int:
    """How many bytes agree from the two places on, at most ``most``; the work follows the answer, not ``most``."""
    known, step = 0, 32
    while known < most and a[a_at + known : a_at + min(known + step, most)] == b[b_at + known : b_at + min(known + step, most)]:
        known += step
        step *= 2
    if known >= most:
        return most
    high = min(known + step, most)  # the first ``known`` bytes agree, the first ``high`` do not
    while high - known > 1:
        middle = (known + high) // 2
        if a[a_at + known : a_at + middle] == b[b_at + known : b_at + middle]:
            known = middle
        else:
            high = middle
    return known


class RadixTrie:
    """A trie whose edges are runs of bytes (a text and two places in it, not a copy), so a text is walked once."""

    def __init__(self) -> None:
        self.root = Node()

    def insert(self, text: bytes) -> Node:
        """The node at which ``text`` ends."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = (text, at, size, leaf)
                return leaf
            label, start, end, child = edge
            common = shared_length(label, start, text, at, min(end - start, size - at))
            if common < end - start:
                middle = Node()
                middle.edges[label[start + common]] = (label, start + common, end, child)
                node.edges[text[at]] = (label, start, start + common, middle)
                child = middle
            node, at = child, at + common
        return node

    def terminals(self):
        """What is kept at the ends of texts. The walk keeps its own stack: a trie may be as deep as a text is long."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.payload is not None:
                yield node.payload
            stack.extend(edge[3] for edge in node.edges.values())


def routed(texts: DataFrame, limit_bytes: int) -> DataFrame:
    """``texts`` (with a binary column text) dealt and sorted by ``route``, a prefix of the text.

    A route is the shortest prefix of 16, 128, 1 024, ... bytes below which all texts together have at most
    ``limit_bytes``, or are all the same; equal texts have equal routes. Sizes are summed before they are shuffled.
    Texts whose prefix is short enough leave; each round reads only what lies below prefixes that were too large.
    Neighbouring routes share a partition.
    """
    size = F.length("text")
    total = texts.agg(F.sum(size)).first()[0] or 0
    at, done, rest = FIRST_BYTES, [], texts
    while True:
        rest = rest.withColumn("route", F.substring("text", 1, at))
        cells = rest.groupBy("route").agg(
            F.sum(size).alias("bytes"), F.max(size).alias("longest"),
            (F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several"),
        )
        large = stored(cells.where((F.col("bytes") > limit_bytes) & (F.col("longest") > at) & F.col("several")).select("route"), "prefixes")
        if large.isEmpty():
            done.append(rest)
            break
        done.append(rest.join(large, "route", "left_anti"))
        rest = stored(rest.join(large, "route", "left_semi").drop("route"), "below")
        at *= GROWTH
    out = reduce(DataFrame.unionByName, done)
    return out.repartitionByRange(max(1, -(-total // limit_bytes)), "route").sortWithinPartitions("route")
