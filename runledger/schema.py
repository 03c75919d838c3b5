"""The canonical event log: one row an event, payload fields projected into one struct."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = (
    "task_started", "request_built", "api_attempt_started", "generation_checkpoint", "api_completed", "api_failed",
    "tool_started", "tool_completed", "tool_failed", "task_finished", "task_aborted", "raw_reference", "adapter_note",
)
CALL_EVENTS = EVENT_TYPES[1:9]
ATTEMPT_EVENTS = EVENT_TYPES[2:6]
TERMINAL_EVENTS = ("task_finished", "task_aborted")

USAGE = T.StructType([T.StructField(f"{c}_tokens", T.LongType()) for c in ("input", "output", "total")])
PAYLOAD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("task_id", "run_id", "condition_id", "prediction_context_id", "model_id", "agent_id", "reasoning_effort")]
    + [T.StructField(c, T.LongType()) for c in ("task_tokens", "max_steps", "request_tokens_local", "context_window", "request_message_count", "request_content_chars")]
    + [T.StructField("usage", USAGE)]
    + [T.StructField(c, T.StringType()) for c in ("tool_name", "tool_type", "action_hash", "action_name", "action", "outcome", "reason")]
    + [T.StructField("generated_tokens_so_far", T.LongType())]
)
EVENT = T.StructType(
    [
        T.StructField("schema_version", T.LongType()), T.StructField("event_id", T.StringType()), T.StructField("trajectory_id", T.StringType()), T.StructField("event_seq", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("logical_call_id", T.StringType()), T.StructField("attempt_id", T.StringType()),
        T.StructField("raw_ref", T.StringType()), T.StructField("payload", PAYLOAD),
    ]
)

POSITIONS = ("task_launch", "task_pre", "task_update", "call_pre", "generation_update")
STATUSES = ("observed", "censored", "missing", "invalid")
