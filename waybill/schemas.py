"""Declared schemas of the model's tables. Nothing is ever inferred by sampling."""

from __future__ import annotations

OPTION = "struct<id:string,name:string,color:string,`group`:string>"
USER = "struct<key:string,id:string,name:string,email:string,type:string>"
SPAN = (
    "struct<text:string,bold:boolean,italic:boolean,strikethrough:boolean,underline:boolean,"
    "code:boolean,color:string,href:string,mention_kind:string,mention_target:string,"
    "equation:string>"
)

SCHEMAS: dict[str, str] = {
    "workspace": "system string, id string, name string, url string",
    "collections": (
        "key string, system string, id string, name string, record_count bigint, "
        "incomplete boolean"
    ),
    "fields": (
        "collection string, field_id string, name string, kind string, source_type string, "
        f"pos int, options array<{OPTION}>, read_only boolean, "
        "relation struct<target_collection:string,target_in_scope:boolean,dual:boolean>"
    ),
    "records": (
        "key string, collection string, title string, url string, created_at string, "
        "updated_at string, archived boolean, body string"
    ),
    "cells": (
        "record string, collection string, field_id string, kind string, text string, "
        "number double, name string, names array<string>, flag boolean, "
        "date struct<start:string,end:string,time_zone:string>, "
        f"users array<{USER}>, targets array<string>, truncated boolean, complete boolean"
    ),
    "relationships": (
        "field string, field_name string, `from` string, `to` string, to_title string, "
        "resolved boolean, in_scope boolean"
    ),
    "documents": (
        "key string, title string, parent string, url string, has_icon boolean, has_cover boolean"
    ),
    "blocks": (
        "doc string, block_id string, parent_id string, path array<int>, depth int, kind string, "
        "source_type string, level int, checked boolean, language string, url string, "
        f"hosting string, target string, title string, spans array<{SPAN}>"
    ),
    "attachments": (
        "key string, name string, hosting string, url string, owner string, field string"
    ),
    "users": "key string, id string, name string, email string, type string",
    "findings": (
        "seq bigint, code string, outcome string, severity string, category string, "
        "message string, entity string, collection string, field string, count bigint"
    ),
    "mappings": (
        "id string, collection string, field_id string, field_name string, kind string, "
        "target_kind string, transform string, value_map map<string,string>, "
        "unmapped array<string>, outcome string, reason string, explicit boolean"
    ),
    "actions": (
        "id string, seq bigint, kind string, label string, source string, "
        "idempotency_key string, scope string, disposition string, skip_reason string, "
        "existing_destination_id string, outcome string, estimated_requests int, payload string"
    ),
    "action_deps": "action_id string, depends_on string",
    "checkpoints": (
        "run_id string, action_id string, status string, attempts int, destination_id string, "
        "last_error_code string, last_error_message string, in_flight_since string, "
        "updated_at string"
    ),
    "id_map": (
        "source_key string, scope string, destination_id string, run_id string, "
        "created_at string"
    ),
    "events": "id bigint, run_id string, ts timestamp, level string, type string, message string",
    "checks": (
        "action_id string, destination_id string, field string, status string, expected string, "
        "actual string, note string"
    ),
}
