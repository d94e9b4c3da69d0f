"""Fixed values of the data model. They must equal the migrated model's own values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes in rank order: position = rank, the worst is last.
OUTCOMES_BY_RANK = ["supported", "skipped", "transformed", "lossy", "unsupported", "failed"]
# Outcomes in the order tallies show them.
OUTCOMES = ["supported", "transformed", "lossy", "unsupported", "skipped", "failed"]
# Outcomes in the order finding groups are shown.
FINDING_GROUP_ORDER = ["unsupported", "lossy", "transformed", "failed", "skipped", "supported"]
SEVERITIES = ["info", "warning", "error"]
# Verification statuses in rank order, the worst is last.
CHECK_STATUSES_BY_RANK = ["verified", "unverified", "mismatched", "missing"]
ACTION_STATUSES = [
    "pending", "in_flight", "succeeded", "failed", "ambiguous", "blocked", "skipped",
]
FINDING_CATEGORIES = [
    "field_type", "block_type", "formatting", "relation", "attachment", "user_mapping",
    "permission", "destination", "scope", "data", "source_feature",
]

# Source property type -> normalized field kind; anything else is `unsupported`.
FIELD_KINDS = {
    "title": "title",
    "rich_text": "text",
    "number": "number",
    "select": "select",
    "multi_select": "multiSelect",
    "status": "status",
    "date": "date",
    "checkbox": "checkbox",
    "url": "url",
    "email": "email",
    "phone_number": "phone",
    "people": "person",
    "files": "files",
    "relation": "relation",
    "formula": "computed",
    "rollup": "computed",
    "created_time": "timestamp",
    "last_edited_time": "timestamp",
    "created_by": "userStamp",
    "last_edited_by": "userStamp",
    "unique_id": "uniqueId",
}
READ_ONLY_TYPES = [
    "formula", "rollup", "created_time", "last_edited_time", "created_by", "last_edited_by",
    "unique_id",
]

# Which field kinds each single-valued target accepts.
TARGET_KINDS = {
    "status": ["status", "select"],
    "priority": ["select", "status"],
    "due_date": ["date"],
    "start_date": ["date"],
    "assignees": ["person"],
    "tags": ["multiSelect", "select"],
}
# Which custom-field types each field kind may be stored in.
CUSTOM_FIELD_TYPES = {
    "title": ["short_text", "text"],
    "text": ["text", "short_text"],
    "number": ["number", "currency"],
    "select": ["drop_down", "short_text", "text"],
    "status": ["drop_down", "short_text", "text"],
    "multiSelect": ["labels"],
    "date": ["date"],
    "checkbox": ["checkbox"],
    "url": ["url", "short_text", "text"],
    "email": ["email", "short_text", "text"],
    "phone": ["phone", "short_text", "text"],
}
# Status group -> destination status types meaning the same.
STATUS_GROUP_TYPES = {
    "to do": ["open"],
    "in progress": ["custom", "active"],
    "complete": ["closed", "done"],
}
PRIORITY_NAMES = {"urgent": 1, "high": 2, "normal": 3, "medium": 3, "low": 4}

OUTCOME_LABELS = {
    "supported": "Preserved",
    "transformed": "Transformed",
    "lossy": "Requires review",
    "unsupported": "Unsupported",
    "skipped": "Skipped",
    "failed": "Failed",
}
OUTCOME_PLAIN = {
    "supported": "Moves as-is",
    "transformed": "Changes shape",
    "lossy": "Loses detail",
    "unsupported": "Cannot move",
    "skipped": "Intentionally not migrated",
    "failed": "Write or check failed",
}
TARGET_LABELS = {
    "name": "Task name",
    "description": "Task description",
    "status": "Status",
    "priority": "Priority",
    "due_date": "Due date",
    "start_date": "Start date",
    "assignees": "Assignees",
    "tags": "Tags",
    "custom_field": "Custom field",
    "link": "Linked task",
    "provenance": "Provenance footer",
    "description_table": "Description table",
    "dropped": "Dropped (not migrated)",
}
TRANSFORM_LABELS = {
    "direct": "Direct copy",
    "value_map": "Value map",
    "epoch_ms": "Date to epoch ms",
    "markdown": "Markdown",
    "user_map": "User map",
    "name_match": "Match by name",
    "snapshot": "Snapshot of value",
    "text": "As text",
    "none": "None",
}
MILESTONE_TYPES = ["approved", "run_started", "run_stopped", "run_finished", "verification"]

CLOCK_SKEW_SECONDS = 60
BREAKER_LIMIT = 5
PROPERTY_ITEM_CAP = 25


def lookup(column: Column, table: dict, default: Column | None = None) -> Column:
    """A small fixed table as one CASE expression (stays inside code generation)."""
    items = list(table.items())
    case = F.when(column == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        case = case.when(column == key, F.lit(value))
    return case if default is None else case.otherwise(default)


def rank_in(column: Column, order: list[str]) -> Column:
    """Position of a value in a fixed order, 0-based; null when it is not listed."""
    return lookup(column, {value: i for i, value in enumerate(order)})


def outcome_rank(column: Column) -> Column:
    return rank_in(column, OUTCOMES_BY_RANK)


def outcome_at(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(OUTCOMES_BY_RANK)))


def check_rank(column: Column) -> Column:
    return rank_in(column, CHECK_STATUSES_BY_RANK)


def check_status_at(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(CHECK_STATUSES_BY_RANK)))
