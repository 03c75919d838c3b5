"""Suffix labels with a status: observed, censored, missing or invalid; a label is never guessed as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Reasons of aborted tasks.
OBSERVED_ABORTS = ("agent_stop", "completed_failure", "natural_failure")
CENSORING_ABORTS = ("timeout", "max_turns", "token_cap", "context_limit", "provider_ambiguous", "provider_error", "auth_failure", "logging_incomplete")


def label(value: Column, status: Column, reason: Column) -> Column:
    """A label struct; a negative observed value is invalid."""
    negative = (status == "observed") & (value < 0)
    return F.struct(
        F.when((status == "observed") & ~negative, value).cast("long").alias("value"), F.when(negative, "invalid").otherwise(status).alias("status"), F.when(negative, "negative_label").otherwise(reason).alias("reason")
    )


def termination(events: DataFrame) -> DataFrame:
    """(trajectory_id, termination_status, termination_reason) from the last event of each run."""
    last = events.groupBy("trajectory_id").agg(F.max_by(F.struct("event_type", "payload.reason"), "event_seq").alias("last"))
    return last.select("trajectory_id", *terminated(F.col("last.event_type"), F.col("last.reason")))


def terminated(kind: Column, reason: Column) -> tuple[Column, Column]:
    """(termination_status, termination_reason) of a run by the type and reason of its last event."""
    reason = F.trim(F.coalesce(reason, F.lit("")))
    observed = (kind == "task_finished") | ((kind == "task_aborted") & reason.isin(*OBSERVED_ABORTS))
    why = F.when(observed, "").when(kind != "task_aborted", "missing_termination").when(reason == "", "unknown_abort_reason").otherwise(reason)
    return F.when(observed, "observed").otherwise("censored").alias("termination_status"), why.alias("termination_reason")


def call_ledgers(events: DataFrame) -> DataFrame:
    """One row a call: billable output and total over all attempts, the last successful output, the first status that applies."""
    kind, usage = F.col("event_type"), F.col("payload.usage")
    terminal = kind.isin("api_completed", "api_failed")
    given = F.coalesce(usage["input_tokens"].isNotNull() & usage["output_tokens"].isNotNull(), F.lit(False))
    off = F.coalesce(usage["total_tokens"] != usage["input_tokens"] + usage["output_tokens"], F.lit(False))
    started = F.collect_set(F.when(kind == "api_attempt_started", F.col("attempt_id")))
    ended = F.collect_set(F.when(terminal, F.col("attempt_id")))
    calls = events.where("logical_call_id IS NOT NULL").groupBy("trajectory_id", "logical_call_id").agg(
        F.max(F.when(kind == "request_built", F.struct("event_seq", F.col("event_id").alias("point_event_id"), F.col("payload.request_tokens_local").alias("local")))).alias("request"),
        F.size(F.array_except(started, ended)).alias("dangling"), F.count_if(terminal).alias("terminals"), F.count_if(terminal & ~given).alias("unknown"), F.count_if(terminal & off).alias("mismatched"),
        F.sum(F.when(terminal, usage["output_tokens"])).alias("output"), F.sum(F.when(terminal, usage["input_tokens"] + usage["output_tokens"])).alias("total"),
        F.max_by(usage["output_tokens"], F.when(kind == "api_completed", F.col("event_seq"))).alias("final"), F.count_if(kind == "api_completed").alias("completed"),
    ).where("request IS NOT NULL")
    return call_labels(calls)


def call_labels(calls: DataFrame, *keep: str) -> DataFrame:
    """Labels of calls by what was counted of their attempts (``call_ledgers``); the columns of ``keep`` stay."""
    status = F.when(F.col("dangling") > 0, "censored").when((F.col("terminals") == 0) | (F.col("unknown") > 0), "missing").when(F.col("mismatched") > 0, "invalid").otherwise("observed")
    reason = F.when(F.col("dangling") > 0, "unterminated_api_attempt").when(F.col("terminals") == 0, "missing_call_terminal").when(F.col("unknown") > 0, "missing_usage").when(F.col("mismatched") > 0, "usage_total_mismatch").otherwise("")
    calls = calls.withColumn("status", status).withColumn("reason", reason)
    none = (F.col("status") == "observed") & (F.col("completed") == 0)
    local = F.col("request.local")
    unsized = (F.col("status") == "observed") & local.isNull()
    return calls.select(
        "trajectory_id", "logical_call_id", F.col("request.event_seq").alias("event_seq"), F.col("request.point_event_id").alias("point_event_id"), local.alias("request_tokens_local"),
        label(F.col("total"), F.col("status"), F.col("reason")).alias("call_billable_total"), label(F.col("output"), F.col("status"), F.col("reason")).alias("call_billable_output"),
        label(F.col("final"), F.when(none, "missing").otherwise(F.col("status")), F.when(none, "no_successful_response").otherwise(F.col("reason"))).alias("final_response_output"),
        label(F.col("total") - local, F.when(unsized, "missing").otherwise(F.col("status")), F.when(unsized, "missing_request_tokens_local").otherwise(F.col("reason"))).alias("call_unknown_billable"), *keep,
    )


def suffix_labels(events: DataFrame) -> DataFrame:
    """call_ledgers with the tokens of the rest of the run: the first blocking status of the suffix wins, a censored run above all."""
    return rest_labels(call_ledgers(events).join(termination(events), "trajectory_id"))


def rest_labels(calls: DataFrame) -> DataFrame:
    """``suffix_labels`` of calls that have their labels and how their run ended."""
    suffix = W.partitionBy("trajectory_id").orderBy("event_seq").rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.col("call_billable_total")
    calls = calls.withColumn("blocked", F.first(F.when(total["status"] != "observed", F.struct(total["status"].alias("status"), total["reason"].alias("reason"))), ignorenulls=True).over(suffix)).withColumn("rest", F.sum(total["value"]).over(suffix))
    ended = F.col("termination_status") != "observed"
    status = F.when(ended, F.col("termination_status")).otherwise(F.coalesce(F.col("blocked.status"), F.lit("observed")))
    reason = F.when(ended, F.col("termination_reason")).otherwise(F.coalesce(F.col("blocked.reason"), F.lit("")))
    unsized = (status == "observed") & F.col("request_tokens_local").isNull()
    remaining = label(F.col("rest"), status, reason)
    unknown = label(F.col("rest") - F.col("request_tokens_local"), F.when(unsized, "missing").otherwise(status), F.when(unsized, "missing_request_tokens_local").otherwise(reason))
    return calls.withColumn("task_provider_accounted_remaining", remaining).withColumn("task_unknown_remaining", unknown).drop("blocked", "rest")


def task_aggregate_labels(events: DataFrame) -> DataFrame:
    """One label a run from the usage of its terminal event."""
    last = events.groupBy("trajectory_id").agg(F.max_by("payload.usage", "event_seq").alias("usage"), F.min_by("event_id", "event_seq").alias("point_event_id"))
    at = last.join(termination(events), "trajectory_id")
    known = F.coalesce(F.col("usage.input_tokens").isNotNull() & F.col("usage.output_tokens").isNotNull(), F.lit(False))
    off = F.coalesce(F.col("usage.total_tokens") != F.col("usage.input_tokens") + F.col("usage.output_tokens"), F.lit(False))
    ended = F.col("termination_status") != "observed"
    status = F.when(ended, F.col("termination_status")).when(~known, "missing").when(off, "invalid").otherwise("observed")
    reason = F.when(ended, F.col("termination_reason")).when(~known, "missing_task_usage").when(off, "usage_total_mismatch").otherwise("")
    return at.select("trajectory_id", "point_event_id", label(F.col("usage.input_tokens") + F.col("usage.output_tokens"), status, reason).alias("total_accounted_tokens"))


def generation_labels(events: DataFrame) -> DataFrame:
    """One label a generation checkpoint: output still to come in its call, from its own attempt's terminal on."""
    usage = F.col("payload.usage")
    points = events.where("event_type = 'generation_checkpoint'").select("trajectory_id", "logical_call_id", "attempt_id", F.col("event_id").alias("point_event_id"), F.col("event_seq").alias("at"), F.col("payload.generated_tokens_so_far").alias("generated"))
    ends = events.where("event_type IN ('api_completed', 'api_failed')").select("trajectory_id", "logical_call_id", F.col("attempt_id").alias("ended"), "event_seq", usage.alias("usage"))
    after = points.join(ends, ["trajectory_id", "logical_call_id"], "left").withColumn("after", F.col("event_seq") > F.col("at"))
    own = F.min(F.when(F.col("after") & (F.col("ended") == F.col("attempt_id")), F.col("event_seq"))).over(W.partitionBy("point_event_id"))
    counted = F.coalesce(F.col("after") & (F.col("event_seq") >= F.col("own")), F.lit(False))
    known = F.coalesce(F.col("usage.input_tokens").isNotNull() & F.col("usage.output_tokens").isNotNull(), F.lit(False))
    off = F.coalesce(F.col("usage.total_tokens") != F.col("usage.input_tokens") + F.col("usage.output_tokens"), F.lit(False))
    sums = after.withColumn("own", own).groupBy("trajectory_id", "logical_call_id", "attempt_id", "point_event_id", "generated").agg(
        F.max("own").alias("own"), F.count_if(counted & ~known).alias("unknown"), F.count_if(counted & off).alias("off"), F.sum(F.when(counted, F.col("usage.output_tokens"))).alias("output")
    )
    status = F.when(F.col("generated").isNull(), "missing").when(F.col("own").isNull(), "censored").when(F.col("unknown") > 0, "missing").when(F.col("off") > 0, "invalid").otherwise("observed")
    reason = F.when(F.col("generated").isNull(), "missing_generated_tokens").when(F.col("own").isNull(), "unterminated_api_attempt").when(F.col("unknown") > 0, "missing_usage").when(F.col("off") > 0, "usage_total_mismatch").otherwise("")
    return sums.select("trajectory_id", "logical_call_id", "attempt_id", "point_event_id", label(F.col("output") - F.col("generated"), status, reason).alias("remaining_output"))
