"""No value of a record is lost on the way into the plan."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from waybill.functions.dates import DATE_SHAPE
from waybill.plans.migrate import Options, draft_cells, plan_migration
from waybill.schemas import SCHEMAS


def table(spark, name, rows, columns):
    full = spark.createDataFrame([], SCHEMAS[name])
    given = spark.createDataFrame(rows, ", ".join(f"{c} {full.schema[c].dataType.simpleString()}" for c in columns))
    return full.unionByName(given, allowMissingColumns=True)


def test_people_tags_relations_and_date_ranges_are_kept_or_told(spark, frame):
    fields = [
        ("c", "t", "Name", "title", 0), ("c", "o", "Owner", "person", 1), ("c", "g", "Tags", "multiSelect", 2), ("c", "r", "Blocks", "relation", 3),
        ("c", "d", "Due", "date", 4), ("c", "s", "Start", "date", 5), ("c", "x", "Odd", "unsupported", 6),
    ]
    day = lambda a, b=None: (a, b, None)
    cells = [
        ("k1", "c", "o", "person", None, None, None, [("u", "u", "Ann", "a@x.org", "person")]), ("k1", "c", "g", "multiSelect", ["a", "b"], None, None, None),
        ("k1", "c", "r", "relation", None, None, ["k2", "gone"], None), ("k1", "c", "d", "date", None, day("2026-01-02", "2026-01-05"), None, None),
        ("k1", "c", "s", "date", None, day("2026-01-01"), None, None), ("k2", "c", "d", "date", None, day("2026-01-02"), None, None),
    ]
    snapshot = {
        "collections": table(spark, "collections", [("c", "sys", "c", "C")], ["key", "system", "id", "name"]),
        "fields": table(spark, "fields", fields, ["collection", "field_id", "name", "kind", "pos"]),
        "records": table(spark, "records", [("k1", "c", "One"), ("k2", "c", "Two")], ["key", "collection", "title"]),
        "cells": table(spark, "cells", cells, ["record", "collection", "field_id", "kind", "names", "date", "targets", "users"]),
    }
    plan = plan_migration(
        snapshot, frame([("L", "open", 0)], "list_id string, name string, pos int"), frame([(0, "C", "L", "List")], "pos int, source string, list_id string, name string"),
        frame([], "collection string, name string, `to` string"), frame([], "collection string, field_name string, `from` string, `to` string, pos int"),
        frame([], "source_key string, scope string, destination_id string"),
    )
    told = {(r.code, r.field) for r in plan["findings"].where("entity = 'k1'").collect()}
    assert ("DATE_RANGE_START_LOST", "Due") in told
    assert {("FIELD_PRESERVED_AS_TEXT", f) for f in ("Owner", "Tags", "Blocks")} <= told
    body = json.loads(plan["actions"].where("source = 'k1'").first().payload)["body"]
    for text in ("Ann", "a, b", "Two, (item outside this migration)"):
        assert text in body["markdown_content"]
    assert body["due_date"] and body["start_date"]
    counted = {r.field_name: (r.cells, r.placed, r.text_rows, r.lost) for r in plan["accounting"].collect()}
    assert counted == {"Owner": (1, 0, 1, 0), "Tags": (1, 0, 1, 0), "Blocks": (1, 0, 1, 0), "Due": (2, 2, 0, 0), "Start": (1, 1, 0, 0)}


def test_only_cells_that_become_instants_are_read_as_dates(spark, frame):
    rules = frame(
        [("c", "d", "Due", 0, "due_date", False), ("c", "s", "State", 1, "status", False), ("c", "n", "Note", 2, "description_table", False)],
        "collection string, field_id string, field_name string, pos int, target_kind string, skip boolean",
    ).withColumns({"list_id": F.lit("L"), "kind": F.lit("x"), "explicit": F.lit(False), "conflict": F.lit(False)})
    day = lambda a: (a, None, None)
    cells = table(
        spark, "cells",
        [("k1", "c", "d", "date", None, None, day("2026-01-02")), ("k2", "c", "d", "date", None, None, day("soon")), ("k3", "c", "d", "date", None, None, None),
         ("k1", "c", "s", "status", None, "Open", None), ("k2", "c", "s", "status", None, "odd", None), ("k1", "c", "n", "text", "a", None, day("2026-01-02"))],
        ["record", "collection", "field_id", "kind", "text", "name", "date"],
    )
    statuses = frame([("L", "open", 0)], "list_id string, name string, pos int")
    drafts = draft_cells(cells, rules, statuses, frame([], "collection string, field_name string, `from` string, `to` string, pos int"), Options())
    got = {(r.record, r.field_name): (r.kept_as, r.codes, r.status, r.start_ms is not None, r.row and r.row.markdown) for r in drafts.collect()}
    assert got == {
        ("k1", "Due"): ("value", [], None, True, None), ("k2", "Due"): ("row", ["DATE_UNPARSEABLE"], None, False, "soon"),
        ("k3", "Due"): (None, [], None, False, None), ("k1", "State"): ("value", [], "open", False, None),
        ("k2", "State"): ("row", ["STATUS_VALUE_UNMAPPED"], None, False, "odd"), ("k1", "Note"): ("row", ["FIELD_PRESERVED_AS_TEXT"], None, False, "a"),
    }
    union = drafts._jdf.queryExecution().analyzed()
    parts = [union.children().apply(i).toString() for i in range(union.children().size())]
    assert [DATE_SHAPE in part for part in parts] == [False, True]
