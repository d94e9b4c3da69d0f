"""Constraints as one-row verdicts: how many rows break each, and whether it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import cells, quality
from workload.filters_work import payloads
from workload.registry import query
from workload.tables import ACTIONS, EDGES, Tables, with_


def verdict_sql(name: str, violations: str) -> str:
    return f"SELECT '{name}' AS \"check\", n::BIGINT AS violations, n = 0 AS ok FROM ({violations})"


@query(
    "check_unique_keys",
    verdict_sql("keys are unique", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
)
def check_unique_keys(t: Tables) -> DataFrame:
    return quality.verdict(quality.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"]), "keys are unique")


@query(
    "check_known_collection",
    verdict_sql("collections are known", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0)"),
)
def check_known_collection(t: Tables) -> DataFrame:
    known = t.customer.where(F.col("c_custkey") % 40 != 0)
    return quality.verdict(quality.orphans(t.orders, "o_custkey", known, "c_custkey"), "collections are known")


@query(
    "check_body_document",
    verdict_sql("bodies have documents", "SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
)
def check_body_document(t: Tables) -> DataFrame:
    return quality.verdict(quality.orphans(t.labels, "doc_id", t.documents, "doc_id"), "bodies have documents")


@query("check_declared_fields", verdict_sql("values have declared fields", "SELECT count(*) AS n FROM orders"))
def check_declared_fields(t: Tables) -> DataFrame:
    declared = t.fields.where(F.col("field_id") != "price")
    return quality.verdict(quality.undeclared_cells(t.cells, declared), "values have declared fields")


@query(
    "check_relationship_source",
    with_(EDGES) + verdict_sql("edges start at records", "SELECT count(*) AS n FROM edges WHERE from_id % 9 = 0"),
)
def check_relationship_source(t: Tables) -> DataFrame:
    records = t.part.where(F.col("p_partkey") % 9 != 0)
    return quality.verdict(quality.orphans(t.edges, "from_id", records, "p_partkey"), "edges start at records")


@query(
    "check_no_secret",
    verdict_sql("no secret appears", "SELECT count(*) AS n FROM documents WHERE contains(text, 'thereore') OR contains(text, 'enaux')"),
)
def check_no_secret(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text")
    return quality.verdict(quality.contains_values(rows, ["doc_id"], ["thereore", "enaux"]), "no secret appears")


@query(
    "check_action_schema",
    verdict_sql(
        "actions meet the schema",
        "SELECT count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0",
    ),
)
def check_action_schema(t: Tables) -> DataFrame:
    checked = cells.validate_payloads(payloads(t), cells.task_payload_rules())
    return quality.verdict(checked.where(~F.col("valid")), "actions meet the schema")


@query(
    "check_idempotency_keys",
    verdict_sql(
        "keys are unique in a scope",
        "SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_orderstatus, o_custkey HAVING count(*) > 1)",
    ),
)
def check_idempotency_keys(t: Tables) -> DataFrame:
    keyed = t.actions.select("scope", F.col("o_custkey").alias("idempotency_key"))
    return quality.verdict(quality.repeated_keys(keyed, ["scope", "idempotency_key"]), "keys are unique in a scope")


@query(
    "check_loss_explained",
    with_(ACTIONS) + verdict_sql(
        "losses are explained",
        "SELECT count(*) AS n FROM actions WHERE outcome = 'lossy' AND seq NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)",
    ),
)
def check_loss_explained(t: Tables) -> DataFrame:
    found = t.lineitem.where(F.col("l_quantity") > 30).select(F.concat(F.lit("act_"), "l_orderkey").alias("action_id"))
    return quality.verdict(quality.unexplained_losses(t.actions, found), "losses are explained")
