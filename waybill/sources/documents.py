"""Structural checks of nested JSON documents, with readable paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.jsontext import kind_of_schema

MODES = ["demo", "live", "empty"]
# Path -> kind; `?` marks a member that may be null or absent together with its parent.
STATE_PATHS = {
    "schemaVersion": "number",
    "mode": "string",
    "generatedAt": "string",
    "plan.planId": "string",
    "plan.hash": "string",
    "run.runId": "string",
    "run.status": "string",
    "run.counts.pending": "number",
    "events": "array",
}


def path_problem(document: Column, path: str, kind: str, root: str = "state") -> Column:
    """Null when the member is there and of its kind; members of a null parent are not required."""
    shape = kind_of_schema(F.schema_of_variant(F.try_variant_get(document, f"$.{path}", "variant")))
    article = "an" if kind in ("array", "object") else "a"
    problem = (
        F.when(shape == "missing", F.lit(f"{root}.{path} is missing"))
        .when(shape != kind, F.lit(f"{root}.{path} must be {article} {kind}"))
    )
    parent = path.rsplit(".", 1)[0]
    if parent == path:
        return problem
    above = F.schema_of_variant(F.try_variant_get(document, f"$.{parent}", "variant"))
    return F.when(~F.coalesce(above == "VOID", F.lit(False)), problem)


def state_document_problem(df: DataFrame, column: str, paths: dict[str, str] | None = None) -> DataFrame:
    """Add the first problem of a saved state document, null when it is sound."""
    parsed = df.withColumn("_doc", F.try_parse_json(column))
    doc = F.col("_doc")
    mode = F.try_variant_get(doc, "$.mode", "string")
    plan = F.schema_of_variant(F.try_variant_get(doc, "$.plan", "variant"))
    version = F.try_variant_get(doc, "$.schemaVersion", "double")
    checks = [
        F.when(doc.isNull(), F.lit("state is not JSON")),
        F.when(version != 1, F.lit("state.schemaVersion must be 1")),
        F.when(~mode.isin(*MODES), F.lit("state.mode is not allowed")),
        *[path_problem(doc, p, k) for p, k in (paths or STATE_PATHS).items()],
        F.when((mode != "empty") & (plan == "VOID"), F.lit('state.plan is null although state.mode is not "empty"')),
    ]
    return parsed.withColumn("problem", F.coalesce(*checks)).drop("_doc")
