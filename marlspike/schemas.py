"""Types of the engine's entities."""

from __future__ import annotations

from pyspark.sql import types as T

# The states and kinds that records may have.
MEMORY_TYPES = ["decision", "constraint", "lesson", "issue", "task-summary", "preference", "fact", "reference"]
MEMORY_STATUSES = ["active", "pending", "stale", "conflicted", "superseded", "rejected", "deleted"]
SCOPE_LEVELS = ["user", "workspace", "project", "module", "task"]
CANDIDATE_STATUSES = ["pending", "accepted", "rejected", "superseded"]
TASK_STATUSES = ["in_progress", "completed", "cancelled"]
RELATION_TYPES = ["IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS"]


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


SOURCES = "path string, content string, content_hash string, size_bytes long, kind string"
CHUNKS = "id string, path string, chunk_no int, start_line int, end_line int, content string"
SYMBOLS = "id string, path string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, content_hash string"
RELATIONS = "id string, path string, from_id string, from_name string, to_name string, relation_type string, start_line int, evidence string"
MEMORIES = "id string, type string, title string, content string, reason string, status string, confidence double, scope array<string>, source_kind string, source_ref string, supersedes_id string, created_at timestamp, updated_at timestamp"
USER_MEMORIES = "id string, type string, title string, content string, reason string, status string, confidence double, scope_level string, project_id string, scope_ref string, source_kind string, supersedes_id string, created_at timestamp, updated_at timestamp"
BINDINGS = "id string, memory_id string, source_kind string, source_path string, source_hash string, start_line int, end_line int, excerpt string, excerpt_hash string"
CANDIDATES = "id string, type string, title string, content string, confidence double, scope array<string>, source_kind string, source_ref string, path string, fingerprint string, status string, created_at timestamp"
CHECKPOINT = "struct<summary:string,completed:array<string>,next:array<string>,changedFiles:array<string>,verification:array<struct<command:string,status:string,summary:string>>,blockers:array<string>,risks:array<string>>"
TASKS = f"id string, goal string, status string, checkpoint {CHECKPOINT}, created_at timestamp, updated_at timestamp"
RUNS = "id string, started_at timestamp, status string, scanned long, indexed long, skipped long, removed long, errors array<struct<path:string,message:string>>"
VCS_STATE = "key string, value string, captured_at timestamp"
