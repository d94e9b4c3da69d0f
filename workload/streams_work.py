"""Streams over the event table, drained to tables. Instants come back as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import dates
from waybill.streaming import runlog, run
from workload.inputs import TRANSITIONS
from workload.registry import query
from workload.tables import LOG, Tables, with_




def log_stream(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return run.read_table_stream(t.spark, t.sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("run_"), "user_id").alias("run_id"), dates.instant(F.col("ts")).alias("ts"),
        F.when(kind == "purchase", F.lit("action_succeeded")).when(kind == "error", F.lit("action_failed"))
        .when(kind == "signup", F.lit("approved")).when(kind == "click", F.lit("in_flight"))
        .otherwise(F.lit("progress")).alias("type"),
        "event_id", "user_id", "event_type",
    )


def ms(column: str):
    return F.unix_millis(F.col(column)).alias(f"{column}_ms")


MARK = "mark AS (SELECT max(ts) - INTERVAL 60 SECOND AS mark FROM events)"


@query(
    "stream_event_counts",
    with_(LOG, MARK) + """
SELECT epoch_ms(date_trunc('minute', ts)) AS start_ms, type, count(*)::BIGINT AS n FROM log, mark
WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= mark GROUP BY ALL""",
)
def stream_event_counts(t: Tables) -> DataFrame:
    counted = run.drain(runlog.event_counts(log_stream(t)), "counts")
    return counted.select(ms("start"), "type", "n")


@query(
    "stream_request_rate",
    with_(MARK) + """
, w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i AS start FROM events, range(6) r(i))
SELECT epoch_ms(start) AS start_ms, count(*)::BIGINT AS requests, count(*) > 15 AS "over" FROM w, mark WHERE start + INTERVAL 1 HOUR <= mark GROUP BY start""",
)
def stream_request_rate(t: Tables) -> DataFrame:
    rate = run.drain(runlog.request_rate(log_stream(t), 15, "1 hour", "10 minutes"), "rate")
    return rate.select(ms("start"), "requests", "over")


@query(
    "stream_activity_sessions",
    with_(MARK) + """
, l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l),
g AS (SELECT user_id, sid, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid)
SELECT 'run_' || user_id AS run_id, epoch_us(a) // 1000 AS start_ms, epoch_us(b) // 1000 AS end_ms, n FROM g, mark WHERE b <= mark""",
)
def stream_activity_sessions(t: Tables) -> DataFrame:
    bursts = run.drain_bursts(log_stream(t), "bursts", "2 hours")
    return bursts.select("run_id", ms("start"), ms("end"), "n")


@query(
    "stream_checkpoint_state",
    with_(TRANSITIONS) + """
, m AS (SELECT run_id, action_id, min(seq) FILTER (event = 'succeeded') AS done, arg_max(event, seq) AS last FROM transitions GROUP BY run_id, action_id)
SELECT t.run_id, t.action_id, CASE WHEN done IS NOT NULL THEN 'succeeded' ELSE any_value(last) END AS status,
  count(*) FILTER (event = 'in_flight' AND (done IS NULL OR seq < done))::BIGINT AS attempts FROM transitions t JOIN m USING (run_id, action_id)
GROUP BY t.run_id, t.action_id, done""",
)
def stream_checkpoint_state(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "purchase", F.lit("succeeded")).when(kind == "error", F.lit("failed"))
        .when(kind == "signup", F.lit("pending")).otherwise(F.lit("in_flight"))
    )
    moves = log_stream(t).select(
        F.concat(F.lit("run_"), F.col("user_id") % 20).alias("run_id"), F.concat(F.lit("act_"), F.col("seq") % 40).alias("action_id"),
        "seq", event.alias("event"),
    )
    final = run.drain_changes(runlog.checkpoint_state(moves), "state", ["run_id", "action_id"])
    return final.select("run_id", "action_id", "status", "attempts")


@query(
    "stream_breaker",
    with_(LOG) + """
, c AS (SELECT *, count(*) FILTER (type = 'action_succeeded') OVER (PARTITION BY run_id ORDER BY id) AS g FROM log),
f AS (SELECT id, run_id, type, count(*) FILTER (type = 'action_failed') OVER (PARTITION BY run_id, g ORDER BY id) AS n FROM c)
SELECT run_id, id AS seq, 3::BIGINT AS failures FROM f WHERE type = 'action_failed' AND n = 3""",
)
def stream_breaker(t: Tables) -> DataFrame:
    return run.drain_breaker(log_stream(t).select("run_id", "seq", "type"), "breaker", 3)


@query(
    "stream_id_map",
    """
WITH m AS (SELECT 'k' || event_id % 500 AS source_key, event_type AS scope, 'dst-' || event_id AS destination_id, ts FROM events),
f AS (SELECT source_key, scope, min({'ts': ts, 'd': destination_id}).d AS destination_id FROM m GROUP BY ALL)
SELECT source_key, scope, destination_id, NULL::VARCHAR AS mapped_to FROM f
UNION ALL SELECT DISTINCT m.source_key, m.scope, m.destination_id, f.destination_id FROM m JOIN f USING (source_key, scope)
WHERE m.destination_id <> f.destination_id""",
)
def stream_id_map(t: Tables) -> DataFrame:
    mapped = log_stream(t).select(
        F.concat(F.lit("k"), F.col("seq") % 500).alias("source_key"), F.col("event_type").alias("scope"), "ts",
        F.concat(F.lit("dst-"), "seq").alias("destination_id"),
    )
    built, conflicts = run.drain_id_map(mapped, "idmap")
    columns = ["source_key", "scope", "destination_id"]
    return built.select(*columns, F.lit(None).cast("string").alias("mapped_to")).unionByName(conflicts.select(*columns, "mapped_to"))


@query(
    "stream_progress",
    with_(LOG) + "SELECT run_id, count(*) FILTER (type = 'action_succeeded')::BIGINT AS done, count(*)::BIGINT AS total FROM log GROUP BY run_id",
)
def stream_progress(t: Tables) -> DataFrame:
    return run.drain_changes(runlog.progress(log_stream(t)), "progress", ["run_id"], "complete")


def adoption_streams(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Clicks as planned writes, purchases as items seen at the destination."""
    key = F.concat(F.lit("u"), "user_id", F.lit("/"), F.col("seq") % 3)
    planned = log_stream(t).where(F.col("event_type") == "click").select(
        key.alias("key"), F.col("ts").alias("planned_at"), F.col("seq").alias("planned")
    )
    seen = log_stream(t).where(F.col("event_type") == "purchase").select(
        key.alias("marker"), F.col("ts").alias("seen_at"), F.col("seq").alias("item_id")
    )
    return planned, seen


@query(
    "stream_adoption",
    """
SELECT 'u' || a.user_id || '/' || a.event_id % 3 AS key, b.event_id AS item_id, a.event_id AS planned FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_id % 3 = b.event_id % 3 AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def stream_adoption(t: Tables) -> DataFrame:
    planned, seen = adoption_streams(t)
    return run.drain(runlog.adoption(planned, seen, 3600), "adoption").select("key", "item_id", "planned")


# A planned write is judged when both streams are known beyond its allowance.
@query(
    "stream_adoption_verdicts",
    """
WITH p AS (SELECT 'u' || user_id || '/' || event_id % 3 AS key, event_id AS planned, ts FROM events WHERE event_type = 'click'),
s AS (SELECT 'u' || user_id || '/' || event_id % 3 AS key, event_id AS item_id, ts FROM events WHERE event_type = 'purchase'),
mark AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM s)) - INTERVAL 1 HOUR AS mark),
f AS (SELECT p.key, planned, p.ts, count(DISTINCT item_id) AS n, min(item_id) AS item_id
  FROM p LEFT JOIN s ON s.key = p.key AND s.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR GROUP BY ALL)
SELECT key, planned, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS verdict,
  CASE n WHEN 1 THEN item_id END AS item_id FROM f, mark WHERE ts + INTERVAL 1 HOUR < mark""",
)
def stream_adoption_verdicts(t: Tables) -> DataFrame:
    planned, seen = adoption_streams(t)
    return run.drain(runlog.adoption_verdicts(planned, seen, 3600), "verdicts").select("key", "planned", "verdict", "item_id")
