from __future__ import annotations

from waybill import contracts


def test_snapshot_constraints(frame):
    snapshot = {
        "collections": frame([("c",)], "key string"),
        "records": frame([("r", "c", "d"), ("r", "c", None), ("s", "x", "nope")], "key string, collection string, body string"),
        "documents": frame([("d",)], "key string"),
        "fields": frame([("c", "f")], "collection string, field_id string"),
        "cells": frame([("r", "c", "f"), ("r", "c", "g")], "record string, collection string, field_id string"),
        "relationships": frame([("r", "s"), ("z", "r")], "`from` string, `to` string"),
    }
    got = {r["check"]: r.violations for r in contracts.check_snapshot(snapshot).collect()}
    assert list(got.values()) == [1, 1, 1, 1, 1]


def test_plan_constraints(frame):
    actions = frame([("a", "s", "k", "lossy"), ("b", "s", "k", "supported"), ("c", "t", "k", "unsupported")], "id string, scope string, idempotency_key string, outcome string")
    deps = frame([("b", "a"), ("c", "gone")], "action_id string, depends_on string")
    findings = frame([("a",)], "action_id string")
    got = {r["check"]: (r.violations, r.ok) for r in contracts.check_plan(actions, deps, findings).collect()}
    assert got == {
        "action ids are unique": (0, True), "dependencies are known": (1, False),
        # What is not in the plan blocks nothing; the missing dependency is a finding of its own.
        "the dependency graph has no cycle": (0, True),
        "idempotency keys are unique within a scope": (1, False), "every loss is explained by a finding": (1, False),
    }
