"""Further inputs shared by several queries: mappings, checkpoints, verified items, run states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators import mapping as mp
from waybill.operators import verify as vf
from waybill.session import config_frame
from workload.tables import Tables


# -- option texts and their destination names ------------------------------------------------------------
def options(t: Tables) -> DataFrame:
    """Option texts found in the data, per field, in text order."""
    status = t.orders.select(F.lit("status").alias("field_id"), F.col("o_orderstatus").alias("option")).distinct()
    priority = t.orders.select(F.lit("priority").alias("field_id"), F.col("o_orderpriority").alias("option")).distinct()
    both = status.unionByName(priority)
    group = vocab.lookup(F.col("option"), {"O": "To-do", "F": "Complete", "P": "In progress"})
    return both.withColumn("pos", F.col("option")).withColumn("group", group)


def value_map(t: Tables) -> DataFrame:
    """Configured value map (a few rows of configuration); one entry points nowhere."""
    return config_frame(
        t.spark,
        [
            ("priority", 0, "1-urgent", "Urgent"), ("priority", 1, "2 HIGH", "high"),
            ("priority", 2, "3-MEDIUM", "Normal"), ("priority", 3, "5-LOW", "low"),
            ("priority", 4, "4-NOT SPECIFIED", "whenever"), ("status", 0, "o", "Open"),
            ("status", 1, "F", "CLOSED"),
        ],
        "field_id string, pos int, from string, to string",
    )


def statuses(t: Tables) -> DataFrame:
    """Names the destination knows (its inspection)."""
    return config_frame(
        t.spark,
        [
            ("status", 0, "open", "open"), ("status", 1, "Closed", "closed"),
            ("status", 2, "Doing", "custom"), ("priority", 0, "urgent", "p"),
            ("priority", 1, "High", "p"), ("priority", 2, "normal", "p"), ("priority", 3, "Low", "p"),
        ],
        "field_id string, pos int, name string, type string",
    )


VALUE_LOOKUP = """value_lookup AS (SELECT * FROM (VALUES
  ('priority', '1-URGENT', 'urgent'), ('priority', '2-HIGH', 'High'), ('priority', '3-MEDIUM', 'normal'),
  ('priority', '5-LOW', 'Low'), ('status', 'O', 'open'), ('status', 'F', 'Closed')) v(field_id, option, target))"""

OPTIONS = """options AS (
  SELECT DISTINCT 'status' AS field_id, o_orderstatus AS option FROM orders
  UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders)"""


def mapped_options(t: Tables) -> DataFrame:
    """Each option with its destination name, and the field's target."""
    opts, maps, names = options(t), value_map(t), statuses(t)
    pieces = []
    for field, kind in (("status", "status"), ("priority", "select")):
        of = lambda df, f=field: df.where(F.col("field_id") == f).drop("field_id")
        done = mp.value_map_join(of(opts), "option", of(maps), of(names))
        pieces.append(
            done.select(
                F.lit(field).alias("field_id"), F.lit(kind).alias("kind"), F.lit(field).alias("target_kind"),
                F.lit(None).cast("string").alias("target_type"), "option", "pos", "group", "target", "via",
            )
        )
    return pieces[0].unionByName(pieces[1])


MAPPED_OPTIONS = f"""{OPTIONS}, {VALUE_LOOKUP}, mapped_options AS (
  SELECT field_id, CASE field_id WHEN 'status' THEN 'status' ELSE 'select' END AS kind, field_id AS target_kind,
         NULL::VARCHAR AS target_type, option, target
  FROM options LEFT JOIN value_lookup USING (field_id, option))"""


def mappings(t: Tables) -> DataFrame:
    """One mapping rule per collection and field."""
    fid = F.col("field_id")
    outcome = vocab.lookup(fid, {"status": "lossy", "priority": "lossy", "ordered": "supported", "price": "transformed"})
    target = vocab.lookup(fid, {"status": "status", "priority": "priority", "ordered": "due_date", "price": "description_table"})
    transform = vocab.lookup(fid, {"status": "name_match", "priority": "value_map", "ordered": "epoch_ms", "price": "text"})
    unmapped = F.when(fid == "priority", F.array(F.lit("4-NOT SPECIFIED"))).otherwise(F.array().cast("array<string>"))
    return t.fields.select(
        F.concat_ws("/", "collection", "field_id").alias("id"), "collection", "field_id",
        F.col("name").alias("field_name"), "source_type", "kind", target.alias("target_kind"),
        transform.alias("transform"), F.lit(None).cast("map<string,string>").alias("value_map"),
        unmapped.alias("unmapped"), outcome.alias("outcome"), F.lit("by rule").alias("reason"),
        (fid == "priority").alias("explicit"), "pos",
    )


MAPPINGS = """mappings AS (
  SELECT collection || '/' || field_id AS id, collection, field_id, name AS field_name, kind,
    CASE field_id WHEN 'status' THEN 'status' WHEN 'priority' THEN 'priority' WHEN 'ordered' THEN 'due_date' ELSE 'description_table' END AS target_kind,
    CASE field_id WHEN 'ordered' THEN 'supported' WHEN 'price' THEN 'transformed' ELSE 'lossy' END AS outcome
  FROM fields)"""


# -- checkpoints -----------------------------------------------------------------------------------------
def checkpoints(t: Tables) -> DataFrame:
    """Status per action; a customer is a run."""
    k = F.col("seq")
    status = (
        F.when(F.col("disposition") == "skip", F.lit("skipped")).when(k % 11 == 0, F.lit("failed"))
        .when(k % 13 == 0, F.lit("blocked")).when(k % 17 == 0, F.lit("ambiguous"))
        .when(k % 19 == 0, F.lit("in_flight")).when(k % 23 == 0, F.lit("pending"))
        .otherwise(F.lit("succeeded"))
    )
    failed = status == "failed"
    return t.actions.select(
        F.concat(F.lit("run_"), "o_custkey").alias("run_id"), F.col("id").alias("action_id"), "seq",
        status.alias("status"),
        F.when(status.isin("succeeded", "skipped"), F.concat(F.lit("dst-"), k)).alias("destination_id"),
        F.when(failed, F.lit("HTTP_500")).alias("last_error_code"),
        F.when(failed, F.concat(F.lit("order "), k)).alias("last_error_message"),
    )


CHECKPOINTS = """checkpoints AS (
  SELECT *, CASE WHEN status IN ('succeeded', 'skipped') THEN 'dst-' || seq END AS destination_id,
    CASE WHEN status = 'failed' THEN 'HTTP_500' END AS last_error_code,
    CASE WHEN status = 'failed' THEN 'order ' || seq END AS last_error_message
  FROM (SELECT 'run_' || o_custkey AS run_id, id AS action_id, seq,
    CASE WHEN disposition = 'skip' THEN 'skipped' WHEN seq % 11 = 0 THEN 'failed' WHEN seq % 13 = 0 THEN 'blocked'
         WHEN seq % 17 = 0 THEN 'ambiguous' WHEN seq % 19 = 0 THEN 'in_flight' WHEN seq % 23 = 0 THEN 'pending'
         ELSE 'succeeded' END AS status FROM actions))"""


def transitions(t: Tables) -> DataFrame:
    """The run log as action transitions."""
    event = vocab.lookup(
        F.col("event_type"),
        {"click": "in_flight", "purchase": "succeeded", "error": "failed", "signup": "pending", "view": "in_flight"},
    )
    return t.events.select(
        F.concat(F.lit("run_"), F.col("user_id") % 20).alias("run_id"),
        F.concat(F.lit("act_"), F.col("event_id") % 40).alias("action_id"),
        F.col("event_id").alias("seq"), event.alias("event"),
        F.when(event == "succeeded", F.concat(F.lit("dst-"), "event_id")).alias("destination_id"),
        F.when(event == "failed", F.concat(F.lit("E"), F.col("event_id") % 7)).alias("error_code"),
        F.col("event_id").alias("ts"),
    )


TRANSITIONS = """transitions AS (
  SELECT 'run_' || user_id % 20 AS run_id, 'act_' || event_id % 40 AS action_id, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'in_flight' END AS event,
    CASE WHEN event_type = 'purchase' THEN 'dst-' || event_id END AS destination_id,
    CASE WHEN event_type = 'error' THEN 'E' || event_id % 7 END AS error_code, event_id AS ts
  FROM events)"""


# -- verified items ----------------------------------------------------------------------------------------
RULES = [
    vf.Rule("price", "number", "planned_price", "price", if_absent="unverified"),
    vf.Rule("status", "status", "planned_status", "status_text", normalize=False),
    vf.Rule("priority", "text", "planned_priority", "priority"),
    vf.Rule("ordered", "text", "planned_day", "ordered"),
]


def planned(t: Tables) -> DataFrame:
    return t.orders.select(
        F.concat(F.lit("act_"), "o_orderkey").alias("action_id"),
        F.concat(F.lit("dst-"), "o_orderkey").alias("destination_id"),
        F.concat(F.lit("tpch:order:"), "o_orderkey").alias("source"),
        F.concat(F.lit("dest:list:"), "o_orderstatus").alias("scope"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("planned_price"),
        F.col("o_orderstatus").alias("planned_status"), F.col("o_orderpriority").alias("planned_priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("planned_day"),
    )


def items(t: Tables) -> DataFrame:
    """Every planned order compared with the destination table."""
    held = t.destination.withColumnRenamed("status", "status_text")
    return vf.diff_expected_actual(planned(t), held, RULES).select(
        "action_id", "destination_id", "source", "scope", "seq", "status", "checks"
    )


ITEMS = """items AS (
  SELECT 'act_' || o_orderkey AS action_id, 'dst-' || o_orderkey AS destination_id, 'tpch:order:' || o_orderkey AS source,
    'dest:list:' || o_orderstatus AS scope, o_orderkey AS seq, o_orderkey, o_totalprice, o_orderpriority, d.price, d.priority,
    CASE WHEN d.destination_id IS NULL THEN 'missing'
      WHEN d.price <> o_totalprice OR d.priority <> o_orderpriority THEN 'mismatched'
      WHEN d.price IS NULL THEN 'unverified' ELSE 'verified' END AS status,
    CASE WHEN d.destination_id IS NULL THEN 'existence' ELSE
      array_to_string(list_filter([CASE WHEN d.price IS NULL OR d.price <> o_totalprice THEN 'price' END,
        CASE WHEN d.priority <> o_orderpriority THEN 'priority' END], lambda x: x IS NOT NULL), ',') END AS failing
  FROM orders LEFT JOIN destination d ON d.destination_id = 'dst-' || o_orderkey)"""


def run_status(t: Tables) -> DataFrame:
    """A status and a verification result per run, derived from its events."""
    per = t.log.groupBy("run_id").agg(
        F.count_if(F.col("type") == "action_failed").alias("errors"), F.count("*").alias("n"), F.max("id").alias("last")
    )
    names = ["approved", "applying", "stopped", "failed", "applied", "verifying", "verified", "verification_failed"]
    return per.select(
        "run_id", "errors",
        vocab.lookup(F.col("last") % 9, dict(enumerate(names))).alias("status"),
        vocab.lookup(F.col("n") % 3, {0: "passed", 1: "failed", 2: "incomplete"}).alias("verification"),
    )


RUN_STATUS = """run_status AS (
  SELECT 'run_' || user_id AS run_id, count(*) FILTER (event_type = 'error')::BIGINT AS errors,
    ['approved', 'applying', 'stopped', 'failed', 'applied', 'verifying', 'verified', 'verification_failed'][max(event_id) % 9 + 1] AS status,
    ['passed', 'failed', 'incomplete'][count(*) % 3 + 1] AS verification
  FROM events GROUP BY user_id)"""
