"""Connected components of a table of links, with its labels kept in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links lead to.

    Each round hooks the larger of two linked labels under the smaller one and then shortens paths, so the rounds grow
    with the logarithm of the longest chain. Minima are combined before they are shuffled, and joins of a hot label
    are skew joins against a table with one row per label. An empty table gives an empty one. Links with a null end
    are ignored.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(ends.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        # Every label hooks under the smallest label that a link leads to; smaller ones win, so there are no cycles.
        parent = edges.groupBy("a").agg(F.min("b").alias("p"))
        parent = stored(parent, "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hop = parent.join(up, "p", "left")
            parent = stored(hop.select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            moved = not parent.where("moved").isEmpty()
            parent = parent.drop("moved")
            if not moved:
                break
        of_label = parent.select(F.col("a").alias("component"), "p")
        labels = stored(
            labels.join(of_label, "component", "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        of_a, of_b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved_edges = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(
            F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")
        )
        edges = stored(
            moved_edges.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "links",
        )
    return labels
