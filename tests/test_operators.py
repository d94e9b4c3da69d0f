from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waybill import vocab
from waybill.operators import (
    cells, documents as docs, findings as fnd, graph, mapping as mp, ordered, quality, relations as rel, runlog, state,
)
from waybill.operators import verify as vf
from waybill.plans import build, seal, summary

FINDING = (
    "seq bigint, code string, outcome string, severity string, category string, message string, entity string, "
    "collection string, field string, count bigint"
)


def finding(seq, code="C", outcome="lossy", severity="warning", category="data", message="m", entity=None, collection=None, field=None, count=None):
    return (seq, code, outcome, severity, category, message, entity, collection, field, count)


# -- findings --------------------------------------------------------------------------------------------
def test_worst_outcome_and_the_skip_quirk(frame):
    rows = [("a", "skipped"), ("a", "supported"), ("b", "unsupported"), ("b", "lossy"), ("c", "failed"), ("c", "unsupported")]
    df = frame(rows, "k string, outcome string")
    assert dict(fnd.worst_outcome(df, ["k"]).collect()) == {"a": "skipped", "b": "unsupported", "c": "failed"}
    assert dict(fnd.item_outcome(df, ["k"]).collect()) == {"a": "skipped", "b": "lossy", "c": "failed"}
    assert fnd.worst_outcome(df.limit(0), []).first()[0] == "supported"


def test_aggregate_keeps_the_first_and_ignores_collection(frame):
    df = frame([finding(2, message="late", collection="x"), finding(1, message="first", collection="y", count=4), finding(3, field="f")], FINDING)
    got = {(r.code, r.field): (r["count"], r.message, r.collection) for r in fnd.aggregate_findings(df).collect()}
    assert got == {("C", None): (5, "first", "y"), ("C", "f"): (1, "m", None)}
    assert fnd.aggregate_findings(df, by_collection=True).count() == 3


def test_routing_finds_the_first_owner_and_drops_repeats(frame):
    actions = frame([("a2", 2, "e1", "execute", "supported"), ("a1", 1, "e1", "execute", "supported"), ("s", 3, "e2", "skip", "skipped")],
                    "id string, seq bigint, source string, disposition string, outcome string")
    found = frame([finding(1, entity="e1"), finding(2, code="D", entity="e1"), finding(3, entity="none"), finding(4, outcome="unsupported", entity="e2")], FINDING)
    carried = frame([("a1", "D", "e1", None, None)], "action_id string, code string, entity string, field string, collection string")
    routed = fnd.route_findings(found, actions, carried)
    assert {(r.seq, r.owner) for r in routed.collect()} == {(1, "a1"), (3, None), (4, "s")}
    assert {(r.id, r.outcome) for r in fnd.merge_action_outcome(actions, routed).collect()} == {("a1", "lossy"), ("a2", "supported"), ("s", "skipped")}


def test_distinct_warnings_count_kinds(frame):
    df = frame([finding(i) for i in range(130)] + [finding(200, field="f"), finding(201, severity="error")], FINDING)
    assert fnd.distinct_warnings(df).first().warnings == 2


def test_shares_text(frame):
    df = frame([(1, 10000), (5, 100), (99, 1000), (1, 3), (0, 5), (1, 0)], "part int, total int")
    got = [r[0] for r in df.select(fnd.percent_text(F.col("part"), F.col("total"))).collect()]
    assert got == ["<0.1%", "5.0%", "9.9%", "33%", "0%", "–"]


# -- ordered scans under skew -------------------------------------------------------------------------------
@pytest.mark.parametrize("width", [3, 7, 1_000_000])
def test_scans_do_not_depend_on_chunks(spark, width):
    """One run holds almost all events; the result equals a plain loop whatever the chunk width."""
    kinds = ["action_failed", "action_failed", "progress", "action_failed", "approved", "action_failed", "action_succeeded"]
    rows = [(i, "hot" if i % 10 else "cold", kinds[(i * i) % 7]) for i in range(120)]
    log = spark.createDataFrame(rows, "id bigint, run_id string, type string")
    want, state_ = {}, {}
    for i, run, kind in rows:
        written, milestone, failures = state_.get(run, (0, -1, 0))
        written += kind == "action_succeeded"
        milestone = i if kind == "approved" else milestone
        failures = 0 if kind == "action_succeeded" else failures + (kind == "action_failed")
        state_[run] = (written, milestone, failures)
        want[i] = state_[run]
    written = dict(runlog.running_written(log, width).select("id", "written").collect())
    milestone = dict(runlog.last_milestone(log, width).select("id", "milestone_id").collect())
    failures = dict(runlog.consecutive_failures(log, width).select("id", "failures").collect())
    assert {i: (written[i], milestone[i], failures[i]) for i in want} == want


def test_global_rank_is_dense_and_total(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    got = ordered.global_rank(df.repartition(7), [F.col("v")]).collect()
    assert sorted((r.v, r["rank"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_merge_adjacent_across_chunks(frame):
    df = frame([("d", i, s, str(i)) for i, s in enumerate("aaabba")], "d string, pos bigint, style string, text string")
    got = ordered.merge_adjacent(df, ["d"], "pos", ["style"], "text", width=2)
    assert [(r.style, r.text) for r in got.orderBy("island").collect()] == [("a", "012"), ("b", "34"), ("a", "5")]


# -- mapping ---------------------------------------------------------------------------------------------
def test_value_map_precedence(frame):
    values = frame([("To Do",), ("In progress",), ("Doing!",), ("Weird",), (None,)], "v string")
    maps = frame([(0, "to-do", "Open"), (1, "TO DO", "closed"), (2, "Weird", "nowhere")], "pos int, `from` string, `to` string")
    names = frame([(0, "open"), (1, "CLOSED"), (2, "doing")], "pos int, name string")
    got = {r.v: (r.target, r.via) for r in mp.value_map_join(values, "v", maps, names).collect()}
    assert got == {"To Do": ("CLOSED", "value_map"), "In progress": (None, None), "Doing!": ("doing", "name_match"), "Weird": (None, None), None: (None, None)}
    assert [r["from"] for r in mp.value_map_validate(maps, names).collect()] == ["Weird"]


def test_suggestion_needs_exactly_one_candidate(frame):
    opts = frame([("A", "To-do"), ("B", "Complete"), ("C", None)], "option string, `group` string")
    one = frame([("open", "open"), ("done", "done")], "name string, type string")
    two = frame([("open", "open"), ("x", "closed"), ("y", "done")], "name string, type string")
    pairs = lambda s: {(r.option, r.suggestion) for r in mp.suggest_status(opts, s).collect()}
    assert pairs(one) == {("A", "open"), ("B", "done")}
    assert pairs(two) == {("A", "open")}


def fields_frame(frame, rows):
    return frame([("c", f"f{i}", n, k, i, to) for i, (n, k, to) in enumerate(rows)], "collection string, field_id string, name string, kind string, pos int, explicit_to string")


def test_targets_are_claimed_once(frame):
    rows = [("When", "date", None), ("Start", "date", None), ("Begin/end", "date", None), ("Deadline", "date", None), ("State", "status", None), ("Phase", "status", None)]
    got = {r.field_id: r.target for r in mp.claim_targets(fields_frame(frame, rows)).collect()}
    assert got == {"f0": None, "f1": "start_date", "f2": "due_date", "f3": None, "f4": "status", "f5": None}


def test_a_lone_date_is_due_and_explicit_claims_win(frame):
    lone = {r.field_id: r.target for r in mp.claim_targets(fields_frame(frame, [("When", "date", None)])).collect()}
    assert lone == {"f0": "due_date"}
    rows = [("Prio", "select", None), ("A", "select", "priority"), ("B", "select", "priority"), ("C", "select", "skip")]
    got = {r.field_id: (r.target, r.explicit, r.conflict) for r in mp.claim_targets(fields_frame(frame, rows)).collect()}
    assert got == {"f0": (None, False, False), "f1": ("priority", True, False), "f2": ("priority", True, True), "f3": (None, False, False)}


def test_users_resolve_in_order(frame):
    users = frame([("k1", "AAAA", "a@x.org"), ("k2", "b", "B@x.org"), ("k3", "c", " C@X.org "), ("k4", "d", None)], "key string, id string, email string")
    entries = frame([(0, "aaaa", 1), (1, "b@X.org", 2), (2, "a@x.org", 3), (3, "zz", 99)], "pos int, source string, target bigint")
    members = frame([(1, None, 0), (2, None, 1), (3, "c@x.org", 2), (4, "c@x.org", 3)], "id bigint, email string, pos int")
    on = {r.key: (r.member_id, r.via) for r in mp.resolve_users(users, entries, members, True).collect()}
    off = {r.key: r.member_id for r in mp.resolve_users(users, entries, members).collect()}
    assert on == {"k1": (1, "explicit"), "k2": (2, "explicit"), "k3": (3, "email"), "k4": (None, None)}
    assert off == {"k1": 1, "k2": 2, "k3": None, "k4": None}
    assert [r.source for r in mp.invalid_user_targets(entries, members).collect()] == ["zz"]


def test_date_slots(frame):
    rows = [
        ("range", "due_date", 0, 10, 20), ("late_start", "due_date", 0, 10, 20), ("late_start", "start_date", 1, 5, None),
        ("early_start", "start_date", 0, 5, None), ("early_start", "due_date", 1, 10, 20),
        ("end_lost", "due_date", 0, 10, None), ("end_lost", "start_date", 1, 5, 6), ("only_start", "start_date", 0, 5, 6),
    ]
    got = {r.record: (r.due_ms, r.start_ms, r.lost) for r in mp.date_slots(frame(rows, "record string, target string, pos int, start_ms bigint, end_ms bigint")).collect()}
    assert got == {
        "range": (20, 10, None), "late_start": (20, 5, None), "early_start": (20, 5, "DATE_RANGE_START_LOST"),
        "end_lost": (10, 5, "DATE_RANGE_END_LOST"), "only_start": (6, 5, None),
    }


def test_payload_json_is_strict(frame):
    good = '{"list_id":"l1","marker":null,"body":{"name":"n","markdown_content":"","notify_all":false,"priority":2}}'
    rows = [
        good, good.replace('"marker"', '"evil":1,"marker"'), good.replace('"notify_all":false', '"notify_all":true,"parent":"x"'),
        good.replace('"l1"', '"../x"'), good.replace('"priority":2', '"priority":2.5,"assignees":[0]'), "{}", "nope",
    ]
    df = frame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [r.failing for r in cells.validate_payload_json(df, "p").orderBy("i").collect()]
    required = ["list_id", "body", "body.name", "body.markdown_content", "body.notify_all"]
    assert got[0] == [] and got[1] == ["(root)"] and got[2] == ["body", "body.notify_all"]
    assert got[3] == ["list_id"] and got[4] == ["body.priority", "body.assignees"]
    assert got[5] == required and set(required) <= set(got[6])


# -- relations and links -----------------------------------------------------------------------------------
def test_links_are_undirected_and_once(frame):
    edges = frame([(1, 2), (2, 1), (1, 1), (1, 3), (1, 2)], "from_id bigint, to_id bigint")
    planned = frame([(1,), (2,)], "k bigint")
    assert [tuple(r) for r in rel.link_pairs(edges, planned).collect()] == [(1, 2)]


# -- graph -----------------------------------------------------------------------------------------------
def test_graph_waves_cycles_and_closures(frame):
    nodes = frame([(c,) for c in "abcdexy"], "id string")
    deps = frame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("e", "x")], "action_id string, depends_on string")
    assert {(r.id, r.level) for r in graph.dependency_levels(nodes, deps).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.id for r in graph.cycle_check(nodes, deps).collect()} == {"x", "y", "e"}
    actions = frame([("a", "failed"), ("b", "pending"), ("c", "succeeded"), ("d", "pending"), ("e", "pending"), ("x", "pending"), ("y", "pending")], "id string, status string")
    assert {r.id for r in graph.blocked_closure(actions, deps).collect()} == {"b"}
    gone = frame([("a", "gone"), ("b", "a")], "action_id string, depends_on string")
    assert {(r.id, r.level) for r in graph.dependency_levels(nodes.where("id in ('a', 'b')"), gone).collect()} == {("a", 0), ("b", 1)}
    assert graph.cycle_check(nodes, gone).count() == 0 and graph.missing_dependencies(nodes, gone).count() == 1


def test_deep_trees_and_cycles_lose_no_page(frame):
    schema = "key string, parent string, title string, pos bigint"
    chain = [(f"p{k:03}", f"p{k - 1:03}" if k else None, "t", 0) for k in range(67)]
    rest = [("x", "y", "t", 0), ("y", "x", "t", 0), ("z", "y", "t", 0), ("orphan", "nowhere", "t", 1)]
    flat = {r.key: r.depth for r in graph.flatten_pages(frame(chain + rest, schema)).collect()}
    assert flat == {f"p{k:03}": k for k in range(67)} | {"x": None, "y": None, "z": None, "orphan": 0}
    order = [r.key for r in graph.tree_emit_order(frame(chain[:3] + rest, schema)).orderBy("position").collect()]
    assert order == ["p000", "p001", "p002", "orphan", "x", "y", "z"]


def test_crawl_stops_at_the_limit_and_names_the_rest(frame):
    roots = frame([("r", 0)], "key string, pos bigint")
    links = frame([("r", "a", 0), ("r", "b", 1), ("a", "r", 0), ("a", "c", 1), ("b", "c", 0), ("b", "d", 1)], "parent string, key string, pos bigint")
    read, left = graph.crawl_tree(roots, links, max_pages=3)
    assert [r.key for r in read.orderBy("path").collect()] == ["r", "a", "b"]
    assert {r.key for r in left.collect()} == {"c", "d"}
    everything, none = graph.crawl_tree(roots, links, max_pages=10)
    assert {r.key for r in everything.collect()} == {"r", "a", "b", "c", "d"} and none.count() == 0


# -- state -----------------------------------------------------------------------------------------------
def test_success_is_final(frame):
    rows = [
        (1, "in_flight", None, None), (2, "failed", None, "E1"), (3, "in_flight", None, None), (4, "succeeded", "d1", None),
        (5, "in_flight", None, None), (6, "failed", None, "E2"), (7, "pending", None, None),
    ]
    df = frame([("r", "done", *r, r[0]) for r in rows] + [("r", "open", *r, r[0]) for r in rows[:3]], "run_id string, action_id string, seq bigint, event string, destination_id string, error_code string, ts bigint")
    got = {r.action_id: r for r in state.fold_checkpoints(df).collect()}
    done, open_ = got["done"], got["open"]
    assert (done.status, done.attempts, done.destination_id, done.in_flight_since, done.last_error_code) == ("succeeded", 2, "d1", None, None)
    assert (open_.status, open_.attempts, open_.in_flight_since, open_.last_error_code) == ("in_flight", 2, 1, "E1")


def test_id_map_conflicts(frame):
    held = frame([("k", "s", "d1")], "source_key string, scope string, destination_id string")
    new = frame([("k", "s", "d1"), ("k", "s", "d2"), ("k", "t", "d2")], "source_key string, scope string, destination_id string")
    assert [r.result for r in state.id_map_upsert(new, held).orderBy("scope", "destination_id").collect()] == ["same", "conflict", "insert"]
    assert state.id_map_conflicts(new, held).count() == 1


# -- verification ------------------------------------------------------------------------------------------
def test_every_kind_of_check(frame):
    schema = (
        "destination_id string, name string, status string, prio int, due bigint, who array<bigint>, tags array<string>, cf string, cfd bigint, md string, box boolean"
    )
    same = ("x", "Náme ", "In Progress", 2, 1782864000000, [1, 2], ["A b"], "o1", 5, "a\n\n\n\nb", True)
    planned = frame([same, ("gone", *same[1:]), ("diff", *same[1:])], schema)
    actual = frame(
        [("x", " Náme", "in-progress", "high", 1782900000000, [2, 1], ["a-B", "other"], "7", 5, "a\r\n\r\nb  ", True),
         ("diff", "Other", "done", "4", 1782950400000, [1], ["z"], "9", 6, None, False)],
        "destination_id string, aname string, astatus string, aprio string, adue bigint, awho array<bigint>, atags array<string>, acf string, acfd bigint, amd string, abox boolean",
    ).withColumn("opts", F.array(F.struct(F.lit("o1").alias("id"), F.lit("7").alias("orderindex"))))
    rules = [
        vf.Rule("name", "name", "name", "aname"), vf.Rule("status", "status", "status", "astatus"), vf.Rule("priority", "priority", "prio", "aprio"),
        vf.Rule("due", "day", "due", "adue"), vf.Rule("who", "id_set", "who", "awho"), vf.Rule("tags", "tags", "tags", "atags"),
        vf.Rule("cf", "option", "cf", "acf", options="opts"), vf.Rule("cfd", "custom_date", "cfd", "acfd"),
        vf.Rule("md", "markdown", "md", "amd", if_absent="unverified"), vf.Rule("box", "checkbox", "box", "abox"),
    ]
    got = {r.destination_id: r for r in vf.diff_expected_actual(planned, actual, rules).collect()}
    assert got["x"].status == "verified" and len(got["x"].checks) == len(rules)
    assert got["gone"].status == "missing" and [c.field for c in got["gone"].checks] == ["existence"]
    verdicts = {c.field: c.status for c in got["diff"].checks}
    assert verdicts == {
        "name": "mismatched", "status": "mismatched", "priority": "mismatched", "due": "mismatched", "who": "mismatched", "tags": "mismatched",
        "cf": "mismatched", "cfd": "unverified", "md": "unverified", "box": "mismatched",
    }


def test_text_difference_names_the_line(frame):
    planned = frame([("x", "a\nb\nc")], "destination_id string, md string")
    actual = frame([("x", "a\nZ\nc")], "destination_id string, amd string")
    check = vf.diff_expected_actual(planned, actual, [vf.Rule("md", "markdown", "md", "amd")]).first().checks[0]
    assert (check.expected, check.actual) == ("from line 2: b", "from line 2: Z")


def test_reconcile_verdicts(frame):
    attempts = frame([(n, "t", n, 1_000_000) for n in ("one", "two", "none", "early", "edge")], "action_id string, target string, match_key string, since_ms bigint")
    items = [("one", 1_000_001), ("two", 1_000_001), ("two", 1_000_002), ("early", 900_000), ("edge", 940_000), ("edge", 939_999)]
    candidates = frame([("t", k, f"i{i}", ms) for i, (k, ms) in enumerate(items)], "target string, match_key string, item_id string, created_ms bigint")
    got = {r.action_id: (r.status, r.destination_id) for r in vf.reconcile_matches(attempts, candidates).collect()}
    assert got == {"one": ("found", "i0"), "two": ("undecidable", None), "none": ("not_found", None), "early": ("not_found", None), "edge": ("found", "i4")}


# -- documents -------------------------------------------------------------------------------------------
def page(spark, *blocks):
    """Blocks as (id, parent, type, payload) to one rendered page."""
    order: dict = {}
    rows, paths = [], {None: []}
    for block_id, parent, kind, payload in blocks:
        pos = order.get(parent, 0)
        order[parent] = pos + 1
        paths[block_id] = paths[parent] + [pos]
        rows.append(("d", block_id, parent, pos, paths[block_id], len(paths[block_id]) - 1, kind, payload, "ok"))
    schema = "doc string, block_id string, parent_id string, pos int, path array<int>, depth int, type string, payload string, status string"
    return docs.normalize_blocks(spark.createDataFrame(rows, schema), "sys", "https://h.example/")


def rich(text):
    return '{"rich_text":[{"type":"text","plain_text":"%s"}]}' % text


def rendered(spark, *blocks):
    return docs.render_documents(page(spark, *blocks)).first().markdown


def test_lists_number_and_nest(spark):
    got = rendered(
        spark, ("a", None, "numbered_list_item", rich("one")), ("b", None, "numbered_list_item", rich("two")), ("c", "b", "bulleted_list_item", rich("in")),
        ("d", "c", "paragraph", rich("deep")), ("e", None, "paragraph", rich("p")), ("f", None, "numbered_list_item", rich("again")),
    )
    assert got == "1. one\n2. two\n    - in\n        deep\n\np\n\n1. again"


def test_quotes_callouts_tables_and_code(spark):
    got = rendered(
        spark, ("q", None, "quote", rich("a\\nb")), ("c", None, "callout", '{"rich_text":[{"plain_text":"note"}],"icon":{"type":"emoji","emoji":"💡"}}'),
        ("k", "c", "to_do", '{"rich_text":[{"plain_text":"do"}],"checked":true}'), ("t", None, "table", '{"has_column_header":true,"has_row_header":true}'),
        ("r1", "t", "table_row", '{"cells":[[{"plain_text":"h|1"}],[{"plain_text":"h2"}]]}'), ("r2", "t", "table_row", '{"cells":[[{"plain_text":"x"}]]}'),
        ("x", None, "code", '{"rich_text":[{"plain_text":"a ``` b"}],"language":"C++"}'), ("d", None, "divider", "{}"),
    )
    assert got == (
        "> a  \n> b\n\n> 💡 note\n>\n> - [x] do\n\n| **h\\|1** | h2 |\n| --- | --- |\n| **x** |  |\n\n````c++\na ``` b\n````\n\n---"
    )


def test_media_links_and_placeholders(spark):
    got = rendered(
        spark, ("i", None, "image", '{"type":"external","external":{"url":"https://h.example/p.png"},"caption":[{"plain_text":"cap"}]}'),
        ("f", None, "file", '{"type":"file","name":"plan.pdf"}'), ("b", None, "bookmark", '{"url":"https://h.example/x"}'), ("e", None, "embed", '{"url":"ftp://x"}'),
        ("p", None, "child_page", '{"title":"Sub"}'), ("db", None, "child_database", '{"title":"T"}'), ("q", None, "equation", '{"expression":"x^2"}'),
        ("tc", None, "table_of_contents", "{}"), ("u", None, "mystery", "{}"), ("h", None, "heading_4", rich("H")), ("to", None, "toggle", rich("T")),
        ("tk", "to", "paragraph", rich("inside")),
    )
    assert got == (
        "![cap](https://h.example/p.png)\n\n*cap*\n\n*[File not migrated: \"plan.pdf\" (hosted by the source)]*\n\n[https://h.example/x](https://h.example/x)\n\n"
        "*[Unsupported block: embed]*\n\n[Sub](https://h.example/p)\n\n*[Inline database \"T\" not migrated]*\n\n```latex\nx^2\n```\n\n*[Unsupported block: mystery]*\n\n"
        "### H\n\n**T**\n\ninside"
    )


def test_block_findings_count_per_code_and_field(spark):
    blocks = page(
        spark, ("h", None, "heading_4", rich("H")), ("k", "h", "paragraph", rich("k")), ("u", None, "mystery", "{}"), ("u2", None, "mystery", "{}"),
        ("p", None, "paragraph", '{"rich_text":[{"plain_text":"a","annotations":{"underline":true,"color":"red"}},{"type":"mention","plain_text":"@x","mention":{"type":"user","user":{"id":"1"}}}]}'),
        ("f", None, "pdf", '{"type":"file"}'), ("c", None, "column_list", "{}"), ("s", None, "synced_block", "{}"),
    )
    got = {(r.code, r.field): r["count"] for r in docs.block_findings(blocks).collect()}
    assert got == {
        ("BLOCK_HEADING_LEVEL_FLATTENED", "heading_4"): 1, ("BLOCK_NESTING_FLATTENED", "heading_4"): 1, ("BLOCK_UNSUPPORTED", "mystery"): 2,
        ("FORMAT_UNDERLINE_DROPPED", None): 1, ("FORMAT_COLOR_DROPPED", None): 1, ("MENTION_USER_AS_TEXT", None): 1,
        ("ATTACHMENT_HOSTED_NOT_MIGRATED", "pdf"): 1, ("BLOCK_COLUMNS_FLATTENED", "column_list"): 1, ("BLOCK_SYNCED_COPIED", "synced_block"): 1,
    }


# -- plans -----------------------------------------------------------------------------------------------
def test_seal_ignores_order_and_sees_every_change(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("j"))
    one = lambda t: seal.seal_plan([seal.table_hash(t, F.col("j"), "t")]).first().hash
    base = one(df)
    assert one(df.repartition(7).orderBy(F.rand())) == base
    assert one(df.where("j <> '17'")) != base
    assert one(df.unionByName(df.limit(1))) != base
    recorded = spark.createDataFrame([("plan_" + base[:12], base), ("plan_x", base)], "plan_id string, hash string")
    intact = seal.verify_integrity(recorded.limit(1), [seal.table_hash(df, F.col("j"), "t")]).first()
    assert (intact.hash_ok, intact.id_ok, intact.intact) == (True, True, True)
    tampered = seal.verify_integrity(recorded.limit(1), [seal.table_hash(df.limit(499), F.col("j"), "t")]).first()
    assert not tampered.intact


def test_task_body_leaves_blank_parts_out(frame):
    records = frame([("k1", "https://h.example/(1)", "2026"), ("k2", None, None)], "key string, url string, created_at string")
    pages = frame([("k1", " \n"), ("k2", "Body")], "key string, markdown string")
    rows = frame([("k1", 1, "B", "x|y\nz"), ("k1", 0, "A", "1")], "record string, pos int, label string, markdown string")
    got = {r.key: r.markdown for r in build.task_body(records, pages, rows).collect()}
    assert got["k1"] == (
        "**Properties**\n\n| Property | Value |\n| --- | --- |\n| A | 1 |\n| B | x\\|y z |\n\n---\n\n"
        "_Migrated, created 2026._ [Original](https://h.example/%281%29)\n\n`waybill-key:k1`"
    )
    assert got["k2"] == "Body\n\n---\n\n_Migrated._\n\n`waybill-key:k2`"


def test_lines_of_a_body_are_written_before_rows_are_gathered(frame):
    records = frame([("k1", None, None)], "key string, url string, created_at string")
    pages = frame([("k1", "Body")], "key string, markdown string")
    rows = frame([("k1", 1, "B", "x")], "record string, pos int, label string, markdown string")
    plan = build.task_body(records, pages, rows)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("| Property | Value |") == 1 and plan.count("_Migrated") == 1


def test_rows_of_one_position_keep_the_order_of_their_texts(frame):
    records = frame([("k", None, None), ("none", None, None)], "key string, url string, created_at string")
    pages = frame([], "key string, markdown string")
    cells = [
        (0, "Due date", "a"), (0, "Due", "c"), (0, "|z", ""), (0, "a", "|x"), (0, "a", "b"), (0, "a", " y"), (None, "last", "f"),
        (None, "first", None), (0, "Due", None),
    ]
    rows = frame([("k", *c) for c in cells], "record string, pos int, label string, markdown string")
    got = {r.key: r.markdown for r in build.task_body(records, pages, rows).collect()}
    lines = [x for x in got["k"].split("\n") if x.startswith("| ")][2:]
    assert lines == ["| last | f |", "| Due | c |", "| Due date | a |", "| a | y |", "| a | b |", "| a | \\|x |", "| \\|z |  |"]
    assert got["none"] == "_Migrated._\n\n`waybill-key:none`"


def test_table_cells(column):
    texts = {
        "plain": "plain", "a b": "a b", "": "", None: None, "x": "x", "|": "\\|", "a|b": "a\\|b", " a": "a", "a\u3000": "a", "\ufeffa|": "a\\|",
        "a\r\n\nb": "a b", "\na\r\n": "a", "a\rb": "a\rb", "é": "é", "é ": "é", "a\x7f": "a\x7f", "\u2003": "", "~!": "~!", "a\xa0b": "a\xa0b",
    }
    assert column(build.table_cell, list(texts)) == list(texts.values())


def test_markers(column):
    got = column(lambda x: mp.markers_in(x, "waybill-key:"), ["`waybill-key:a:b:1` waybill-key:c", "none", "waybill-key:"])
    assert got == [["a:b:1", "c"], [], []]


def test_vocabulary_is_consistent():
    assert sorted(vocab.OUTCOMES) == sorted(vocab.OUTCOMES_BY_RANK) == sorted(vocab.FINDING_GROUP_ORDER)
    assert set(docs.BLOCK_KINDS.values()) >= set(docs.LIST_KINDS)


def test_leak_scan_and_constraints(frame):
    df = frame([(1, "by robin", "x"), (2, "robins", "sk-" + "a" * 20)], "id int, a string, b string")
    got = {(r.id, r.path, r.leak) for r in quality.leak_scan(df, ["id"], {"robin": "person"}).collect()}
    assert got == {(1, "a", "person"), (2, "b", "API key")}
    assert quality.verdict(quality.repeated_keys(df, ["id"]), "unique").first().ok


def test_summary_rows_need_no_join(frame):
    actions = frame([("execute", "lossy", 2), ("skip", "skipped", 0)], "disposition string, outcome string, estimated_requests int")
    got = summary.estimate_requests(actions, 90).first()
    assert (got.write_requests, got.minutes) == (2, 0.0)


def test_buckets_of_the_seal_take_one_shuffle(frame):
    from waybill.plans.seal import table_hash

    rows = frame([(k % 700,) for k in range(1_000)], "k int")
    hashed = table_hash(rows, F.col("k").cast("string"), "t")
    # By hash, by its first digits, and the fold of all: bucket hashes once moved again.
    assert hashed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 3
    again = table_hash(rows.repartition(5), F.col("k").cast("string"), "t")
    assert hashed.collect() == again.collect() and hashed.collect() != table_hash(rows.where("k > 0"), F.col("k").cast("string"), "t").collect()


def test_findings_are_routed_in_one_shuffle(spark, frame):
    """Null fields are equal, null codes are not, and what other actions carry drops nothing."""
    columns = "seq bigint, code string, entity string, field string, collection string"
    found = frame([(1, "D", "e", None, "c"), (2, "D", "e", "f", "c"), (3, None, "e", None, "c"), (4, "B", "e", None, "c"), (5, "D", None, None, "c")], columns)
    actions = frame([("late", 2, "e"), ("first", 1, "e"), ("free", 3, None)], "id string, seq bigint, source string")
    carried = frame([("first", "D", "e", None, "c"), ("first", None, "e", None, "c"), ("late", "B", "e", None, "c"), ("free", "D", None, None, "c"), ("x", "D", "only", None, "c")],
                    "action_id string, code string, entity string, field string, collection string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routed = fnd.route_findings(found, actions, carried)
        # The findings by entity, the owners by entity (grouped, then apart).
        assert routed._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
        assert routed.columns == ["entity", "seq", "code", "field", "collection", "owner"]
        assert {(r.seq, r.owner) for r in routed.collect()} == {(2, "first"), (3, "first"), (4, "first"), (5, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
