"""What a source and a destination provide, and the checks every implementation must pass."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import graph, quality


class Source(Protocol):
    """Anything that can produce the snapshot tables of ``waybill.schemas``."""

    def discover(self) -> DataFrame:
        """Reachable containers: kind, id, name, path."""

    def inspect(self) -> DataFrame:
        """Row count of each collection and portability of each field."""

    def extract(self) -> DataFrame:
        """All reading happens here, and nothing is written."""

    def normalize(self, raw: DataFrame) -> dict[str, DataFrame]:
        """Snapshot tables; no reading, and the same rows for the same input."""


class Destination(Protocol):
    """Anything that can be planned for and compared with a plan."""

    def inspect(self) -> dict[str, DataFrame]:
        """Lists, statuses, fields, options, members."""

    def plan(self, snapshot: dict[str, DataFrame], facts: dict[str, DataFrame], id_map: DataFrame) -> dict[str, DataFrame]:
        """Plan tables; no reading, and the same rows for the same input."""

    def verify(self, actions: DataFrame, id_map: DataFrame) -> DataFrame:
        """One row per planned item with its checks and status."""


def check_snapshot(snapshot: dict[str, DataFrame]) -> DataFrame:
    """One verdict row per constraint on a snapshot's tables."""
    records, edges = snapshot["records"], snapshot["relationships"].withColumnRenamed("from", "from_key")
    checks = {
        "record keys are unique": quality.repeated_keys(records, ["key"]),
        "every record belongs to a known collection": quality.orphans(records, "collection", snapshot["collections"], "key"),
        "every body points to a document": quality.orphans(records, "body", snapshot["documents"], "key"),
        "every value is keyed by a declared field": quality.undeclared_cells(snapshot["cells"], snapshot["fields"]),
        "relationships start at known records": quality.orphans(edges, "from_key", records, "key"),
    }
    return reduce(DataFrame.unionByName, [quality.verdict(bad, name) for name, bad in checks.items()])


def check_plan(actions: DataFrame, deps: DataFrame, findings: DataFrame) -> DataFrame:
    """One verdict row per constraint on a plan. actions: id, scope, idempotency_key, outcome.
    deps: action_id, depends_on. findings: action_id."""
    checks = {
        "action ids are unique": quality.repeated_keys(actions, ["id"]),
        "dependencies are known": graph.missing_dependencies(actions, deps),
        "the dependency graph has no cycle": graph.cycle_check(actions, deps).where("in_cycle"),
        "idempotency keys are unique within a scope": quality.repeated_keys(actions, ["scope", "idempotency_key"]),
        "every loss is explained by a finding": quality.unexplained_losses(actions, findings),
    }
    return reduce(DataFrame.unionByName, [quality.verdict(bad, name) for name, bad in checks.items()]).orderBy(F.col("ok"))
