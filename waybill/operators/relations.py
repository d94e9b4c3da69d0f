"""Edges between records: resolution, scope, text and link pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_relationships(edges: DataFrame, records: DataFrame, collections: DataFrame) -> DataFrame:
    """Each edge with the target's title, whether it was read, and whether its collection is
    among the selected ones. edges: from, field, to, to_collection."""
    known = records.select(F.col("key").alias("to"), F.col("title").alias("to_title"), F.lit(True).alias("_known"))
    selected = collections.select(F.col("key").alias("to_collection"), F.lit(True).alias("_selected"))
    joined = edges.join(known, "to", "left").join(selected, "to_collection", "left")
    return joined.select(
        "from", "field", "to", "to_title",
        F.col("_known").isNotNull().alias("resolved"), F.col("_selected").isNotNull().alias("in_scope"),
    )


def out_of_scope_relations(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Per record and field: how many targets are outside the snapshot, and which.

    cells: record, field_id, targets. The targets of one cell arrive as one row, which bounds the
    text made of them.
    """
    parts = cells.select("record", "field_id", F.posexplode("targets").alias("_pos", "_target"))
    outside = parts.join(records.select(F.col("key").alias("_target")), "_target", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_target"))), lambda s: s["_target"])
    return outside.groupBy("record", "field_id").agg(
        F.count("*").alias("n"), F.array_join(ordered, ", ").alias("targets")
    )


def relation_as_text(
    cells: DataFrame, records: DataFrame, placeholder: str = "(item outside this migration)"
) -> DataFrame:
    """Titles of the related items joined in their order. cells: record, field_id, targets.

    The targets of one cell are bounded by the cell itself, which arrives as one row.
    """
    titles = records.select(F.col("key").alias("_target"), F.col("title").alias("_title"))
    parts = cells.where(F.size("targets") > 0).select(
        "record", "field_id", F.posexplode("targets").alias("_pos", "_target")
    )
    named = parts.join(titles, "_target", "left").withColumn("_title", F.coalesce("_title", F.lit(placeholder)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_title"))), lambda s: s["_title"])
    return named.groupBy("record", "field_id").agg(F.array_join(ordered, ", ").alias("text"))


def link_pairs(edges: DataFrame, planned: DataFrame) -> DataFrame:
    """Undirected pairs, each once, where both ends are planned and differ. edges: from_id, to_id."""
    pair = edges.where(F.col("from_id") != F.col("to_id")).select(
        F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")
    ).distinct()
    key = planned.columns[0]
    return pair.join(planned.select(F.col(key).alias("a")), "a", "left_semi").join(
        planned.select(F.col(key).alias("b")), "b", "left_semi"
    ).select("a", "b")


def dangling_parents(pages: DataFrame) -> DataFrame:
    """Pages whose parent was not read: they become roots."""
    keys = pages.select(F.col("key").alias("parent"))
    return pages.where(F.col("parent").isNotNull()).join(keys, "parent", "left_anti")


def record_bodies(documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents that are the body of a record. bodies has one column, the document key."""
    return documents.join(bodies.select(F.col(bodies.columns[0]).alias("key")), "key", "left_semi")


def standalone_docs(documents: DataFrame, bodies: DataFrame) -> DataFrame:
    return documents.join(bodies.select(F.col(bodies.columns[0]).alias("key")), "key", "left_anti")
