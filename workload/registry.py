"""One registry of (name, Spark query, SQL that must agree with it)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.tables import Tables

MODULES = [
    "sources_work", "filters_work", "joins_work", "aggregates_work", "windows_work", "sorts_work",
    "functions_work", "documents_work", "graph_work", "state_work", "quality_work", "streams_work", "whole_work",
]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, sql.strip() if sql else None)
        return run

    return register


def load_all() -> dict[str, Query]:
    for module in MODULES:
        try:
            importlib.import_module(f"workload.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"workload.{module}":
                raise
    return REGISTRY
