from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import state as st
from waybill.sources import sinks, snapshot, targets
from waybill.streaming import run, runlog

KINDS = ["in_flight", "failed", "in_flight", "pending", "in_flight", "succeeded", "in_flight", "failed"]


def files(spark, tmp_path, rows, schema, parts):
    """Rows written as ``parts`` files in order, each of which becomes a micro-batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    )


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("seed", [None, 5])
def test_state_survives_batches(spark, tmp_path, parts, seed):
    """The streamed state equals the batch fold, however the log is cut into batches, and in whatever order it comes."""
    rows = [("r", f"a{i % 3}", i, KINDS[(i * 5 + i // 7) % 8]) for i in range(40)]
    rows += [("q", "late", 1, "in_flight"), ("q", "late", 5, "failed"), ("q", "late", 3, "succeeded"), ("q", "late", 4, "in_flight")]
    if seed:
        random.Random(seed).shuffle(rows)
    schema = "run_id string, action_id string, seq bigint, event string"
    stream = files(spark, tmp_path, rows, schema, parts)
    got = run.drain_changes(runlog.checkpoint_state(stream), "t", ["run_id", "action_id"])
    batch = spark.createDataFrame(rows, schema).withColumns(
        {"destination_id": F.lit("d"), "error_code": F.lit("E"), "ts": F.col("seq")}
    )
    key = lambda df: sorted((r.action_id, r.status, r.attempts) for r in df.collect())
    assert key(got) == key(st.fold_checkpoints(batch))


def plain_alarms(rows, limit):
    out, count = set(), {}
    for run_id, seq, kind in sorted(set(rows)):
        if kind in ("action_failed", "action_succeeded"):
            count[run_id] = count.get(run_id, 0) + 1 if kind == "action_failed" else 0
            if count[run_id] == limit:
                out.add((run_id, seq))
    return out


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("seed", [None, 3])
def test_breaker_does_not_depend_on_batches(spark, tmp_path, parts, seed):
    names = {"F": "action_failed", "S": "action_succeeded", "P": "progress"}
    rows = [("r", i, names[k]) for i, k in enumerate("FFSFFFFFPFFSFFFFF")]
    rows += [("cut", 1, names["F"]), ("cut", 2, names["F"]), ("cut", 3, names["S"]), ("cut", 4, names["F"])]
    rng = random.Random(7)
    rows += [("hot", i * 3, names[rng.choice("FFFFFFS")]) for i in range(200)] + [("calm", 10, names["P"])]
    if seed:
        rows += rows[:20]  # delivered twice
        random.Random(seed).shuffle(rows)
    stream = files(spark, tmp_path, rows, "run_id string, seq bigint, type string", parts)
    marks = run.drain_changes(runlog.breaker_marks(stream, width=16), "b", ["run_id", "stretch"])
    for limit in (3, 5, 20):
        got = runlog.breaker_alarms(marks, limit).collect()
        assert {(r.run_id, r.seq) for r in got} == plain_alarms(rows, limit) and len(got) == len({(r.run_id, r.seq) for r in got})


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_first_mapping_holds_for_good(spark, tmp_path, parts):
    start = dt.datetime(2026, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    rows = [
        ("k", "s", "d1", at(0)), ("k", "s", "d1", at(10)), ("j", "s", "d2", at(600)), ("k", "t", "d3", at(601)), ("k", "s", "d4", at(90_000)),
    ]
    stream = files(spark, tmp_path, rows, "source_key string, scope string, destination_id string, ts timestamp", parts)
    built, conflicts = run.drain_id_map(stream, "m")
    assert sorted(tuple(r) for r in built.select("source_key", "scope", "destination_id").collect()) == [("j", "s", "d2"), ("k", "s", "d1"), ("k", "t", "d3")]
    assert [(r.source_key, r.destination_id, r.mapped_to) for r in conflicts.collect()] == [("k", "d4", "d1")]


# -- files -----------------------------------------------------------------------------------------------
def test_json_items_take_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title":"T",\n "items":[{"id":"1","title":"a","done":true,"extra":1},{"id":"2","title":"b","attachment_url":"u"}]}')
    (tmp_path / "b.json").write_text('{"items":[{"id":"3","title":"c"}]}')
    items = snapshot.scan_json_items(spark, str(tmp_path), "id:string,title:string,done:boolean,notes:string,attachment_url:string", {"done": False})
    got = {r.id: (r.list_title, r.done) for r in items.collect()}
    assert got == {"1": ("T", True), "2": ("T", False), "3": ("Tasks", False)}
    _, found = snapshot.item_records(items, "file", ["attachment_url"])
    assert [(r.entity, r.field) for r in found.collect()] == [("file:item:2", "attachment_url")]


def test_lenient_parse_quarantines_only_bad_items(spark):
    df = spark.createDataFrame([(1, '{"a":1,"z":2}'), (2, "{"), (3, '{"b":1}'), (4, '{"a":"x"}'), (5, None)], "i int, j string")
    good, bad = snapshot.lenient_parse(df, "j", "a int", ["a"])
    assert [(r.i, r.a) for r in good.collect()] == [(1, 1)]
    assert sorted(r.i for r in bad.collect()) == [2, 3, 4, 5]


def test_overlapping_windows_keep_the_last_sighting(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, v string")
    got = snapshot.incremental_windowed_read([make([(1, "a"), (2, "a")]), make([(2, "b"), (3, "b")]), make([(3, "c")])], "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_container_ids(spark):
    wanted = spark.createDataFrame([(0, "db"), (1, "s2"), (2, "s1"), (3, "no")], "pos int, id string")
    sources = spark.createDataFrame([("s1", "one"), ("s2", "two")], "id string, name string")
    databases = spark.createDataFrame([("db", "s1"), ("db", "s2")], "database_id string, source_id string")
    named, unknown = snapshot.resolve_container_ids(wanted, sources, databases)
    assert sorted((r.resolved, r.pos) for r in named.collect()) == [("s1", 0), ("s2", 0)]
    assert [r.id for r in unknown.collect()] == ["no"]


def test_plan_is_written_once_and_exports_never_overwrite(spark, tmp_path):
    tables = {"t": spark.range(3)}
    assert sinks.write_plan_tables("p", tables, str(tmp_path)) is True
    assert sinks.write_plan_tables("p", {"t": spark.range(9)}, str(tmp_path)) is False
    assert spark.read.parquet(str(tmp_path / "p" / "t")).count() == 3
    make = lambda rows: spark.createDataFrame(rows, "key string, content string")
    path = str(tmp_path / "out")
    make([("a", "1"), ("b", "2")]).write.parquet(path)
    planned = make([("a", "1"), ("b", "other"), ("c", "3")])
    sinks.append_new(planned, spark.read.parquet(path), path)
    sinks.append_new(planned, spark.read.parquet(path), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_options_and_paths_of_targets(spark):
    config = '{"options":[{"id":"1","name":"A","orderindex":"2"},{"id":"2","label":"B","orderindex":null},{"id":"3"},{"name":"x"}]}'
    fields = spark.createDataFrame([("f", config), ("g", "{}")], "field_id string, config string")
    assert [(r.option_id, r.name, r.orderindex) for r in targets.field_options(fields).orderBy("pos").collect()] == [("1", "A", 2.0), ("2", "B", None)]
    wanted = spark.createDataFrame([("l1",), ("l2",), ("l3",)], "list_id string")
    lists = spark.createDataFrame([("l1", False), ("l2", True)], "id string, forbidden boolean")
    assert sorted((r.list_id, r.code) for r in targets.unreachable_targets(wanted, lists).collect()) == [
        ("l2", "DEST_LIST_FORBIDDEN"), ("l3", "DEST_LIST_NOT_FOUND"),
    ]


T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def plain_bursts(rows, gap, mark):
    out, held = [], {}
    for run_id, ts in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if run_id in held and ts - held[run_id][1] <= gap:
            held[run_id][1:] = [ts, held[run_id][2] + 1]
        else:
            out += [(run_id, *held[run_id])] if run_id in held else []
            held[run_id] = [ts, ts, 1]
    out += [(run_id, *h) for run_id, h in held.items()]
    return sorted(((r or "", a, b + gap, n) for r, a, b, n in out if b + gap <= mark))


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("seed", [None, 3])
def test_bursts_do_not_depend_on_batches(spark, tmp_path, parts, seed):
    """A run with a third of all events, idle gaps of just the limit, a null run; rows up to the lateness out of order."""
    rng = random.Random(11)
    at = [rng.randrange(0, 40_000) for _ in range(900)]
    rows = [("hot" if k % 3 == 0 else f"r{k % 40}", T0 + dt.timedelta(seconds=s)) for k, s in enumerate(at)]
    rows += [("edge", T0 + dt.timedelta(seconds=s)) for s in (0, 600, 1200, 1801, 1801)]
    rows += [(None, T0 + dt.timedelta(seconds=s)) for s in (5, 6, 5000)]
    shaken = random.Random(seed)
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=shaken.randrange(3000) if seed else 0))
    stream = files(spark, tmp_path, rows, "run_id string, ts timestamp", parts)
    got = run.drain_bursts(stream, "b", "10 minutes", "1 hour").select("run_id", F.unix_micros("start"), F.unix_micros("end"), "n").collect()
    micros = lambda t: round((t - T0).total_seconds() * 10**6) + round(T0.timestamp()) * 10**6
    mark = max(ts for _, ts in rows) - dt.timedelta(hours=1)
    expected = [(r, micros(a), micros(b), n) for r, a, b, n in plain_bursts(rows, dt.timedelta(minutes=10), mark)]
    assert sorted((r[0] or "", r[1], r[2], r[3]) for r in got) == expected and len(expected) > 300


def test_slices_split_a_hot_run(spark):
    """A run with all events is one row of state per slice of time, not one growing session."""
    events = spark.range(20_000).select(F.lit("hot").alias("run_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    slices = runlog.activity_slices(events, "10 minutes")
    assert slices.count() == 2000 and slices.agg(F.max("n")).first()[0] == 10
    assert runlog.bursts_of_slices(slices, "10 minutes").count() == 0  # it never pauses, so it is still open


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_adoption_gives_one_verdict(spark, tmp_path, parts):
    """None, one or several items per planned write, the same for any cut; repeats and items outside the allowance do not count."""
    plans = [("a", 1, 1000), ("b", 2, 1010), ("c", 3, 1020), ("c", 3, 1020), ("d", 4, 1030), ("e", 5, 1040), (None, 6, 1050)]
    items = [
        ("b", "i1", 1040), ("b", "i1", 1045), ("c", "i2", 1000), ("c", "i3", 1075), ("d", "i4", 969), ("e", "i5", 980), ("e", "i6", 1101),
        (None, "i7", 1050),
    ]
    rows = [("p", k, str(n), s) for k, n, s in plans] + [("s", k, n, s) for k, n, s in items]
    rows += [(side, "end", "0", s) for side in "ps" for s in (3000, 6000)]
    rows = sorted(((*r[:3], T0 + dt.timedelta(seconds=r[3])) for r in rows), key=lambda r: r[3])
    stream = files(spark, tmp_path, rows, "side string, key string, name string, ts timestamp", parts)
    planned = stream.where("side = 'p'").select("key", F.col("name").alias("planned"), F.col("ts").alias("planned_at"))
    seen = stream.where("side = 's'").select(F.col("key").alias("marker"), F.col("name").alias("item_id"), F.col("ts").alias("seen_at"))
    got = run.drain(runlog.adoption_verdicts(planned, seen, 60), "v").where("planned <> '0'")
    assert sorted((int(r.planned), r.verdict, r.item_id) for r in got.collect()) == [
        (1, "none", None), (2, "one", "i1"), (3, "several", None), (4, "none", None), (5, "one", "i5"), (6, "none", None),
    ]
