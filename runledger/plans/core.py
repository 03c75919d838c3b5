"""Queries on labels, features, points, weights and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import audit, features, labels, points, splits, validate
from runledger.plans import base
from runledger.plans.base import ATTEMPTS, CELL, HISTORY, LABELS, SALT, rounded
from runledger.sources import mapping
from runledger.sources.tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("WITH" + ATTEMPTS + ", n AS (SELECT 2 AS k UNION ALL SELECT 0) SELECT event_type, count(*) AS n FROM (SELECT 'task_started' AS event_type FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'task_finished' ELSE 'task_aborted' END FROM orders UNION ALL SELECT 'request_built' FROM calls UNION ALL SELECT 'api_attempt_started' FROM att UNION ALL SELECT CASE WHEN failed THEN 'api_failed' ELSE 'api_completed' END FROM att WHERE NOT dangling UNION ALL SELECT CASE WHEN tool_failed THEN 'tool_failed' ELSE 'tool_completed' END FROM att WHERE NOT dangling) GROUP BY ALL")
def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH" + ATTEMPTS + """ SELECT trajectory_id, 'call-' || call_no AS logical_call_id, status, reason, CASE WHEN status = 'observed' THEN known_in + known_out END AS total, CASE WHEN status = 'observed' THEN known_out END AS output,
  CASE WHEN status = 'observed' AND completed > 0 THEN final_out END AS final_output, CASE WHEN status = 'observed' AND completed = 0 THEN 'missing' ELSE status END AS final_status,
  CASE WHEN status = 'observed' AND local IS NULL THEN 'missing' WHEN status = 'observed' AND known_in + known_out - local < 0 THEN 'invalid' ELSE status END AS unknown_status FROM ledger""")
def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = labels.call_ledgers(mapping.events(spark, sf_dir))
    return at.select("trajectory_id", "logical_call_id", F.col("call_billable_total.status").alias("status"), F.col("call_billable_total.reason").alias("reason"), F.col("call_billable_total.value").alias("total"), F.col("call_billable_output.value").alias("output"), F.col("final_response_output.value").alias("final_output"), F.col("final_response_output.status").alias("final_status"), F.col("call_unknown_billable.status").alias("unknown_status"))


@query("WITH" + LABELS + """ SELECT trajectory_id, 'call-' || call_no AS logical_call_id, remaining, rest_status AS status, rest_reason AS reason, CASE WHEN unk_status = 'observed' THEN rest - local END AS unknown_remaining, unk_status AS unknown_status FROM labels0""")
def suffix_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = labels.suffix_labels(mapping.events(spark, sf_dir))
    r, u = "task_provider_accounted_remaining", "task_unknown_remaining"
    return at.select("trajectory_id", "logical_call_id", F.col(f"{r}.value").alias("remaining"), F.col(f"{r}.status").alias("status"), F.col(f"{r}.reason").alias("reason"), F.col(f"{u}.value").alias("unknown_remaining"), F.col(f"{u}.status").alias("unknown_status"))


@query("SELECT o_orderkey::VARCHAR AS trajectory_id, CASE WHEN o_orderstatus = 'O' THEN 'censored' ELSE 'observed' END AS termination_status, CASE WHEN o_orderstatus = 'O' THEN 'max_turns' ELSE '' END AS termination_reason FROM orders")
def task_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.termination(mapping.events(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS trajectory_id, CASE WHEN o_orderstatus = 'O' THEN 'censored' ELSE 'missing' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'max_turns' ELSE 'missing_task_usage' END AS reason FROM orders")
def task_aggregate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.task_aggregate_labels(mapping.events(spark, sf_dir)).select("trajectory_id", F.col("total_accounted_tokens.status").alias("status"), F.col("total_accounted_tokens.reason").alias("reason"))


@query("WITH" + HISTORY + """ SELECT trajectory_id, 'call-' || call_no AS logical_call_id, coalesce(completed_api_attempts, 0)::BIGINT AS completed_api_attempts, coalesce(failed_api_attempts, 0)::BIGINT AS failed_api_attempts, coalesce(completed_tool_calls, 0)::BIGINT AS completed_tool_calls, coalesce(failed_tool_calls, 0)::BIGINT AS failed_tool_calls,
  coalesce(known_usage_attempts, 0)::BIGINT AS known_usage_attempts, coalesce(missing_usage_attempts, 0)::BIGINT AS missing_usage_attempts, ordinal AS request_count, ordinal - 1 AS completed_call_count, coalesce(cumulative_in, 0)::BIGINT AS cumulative_provider_input_tokens, coalesce(cumulative_out, 0)::BIGINT AS cumulative_provider_output_tokens FROM hist""")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.snapshots(mapping.events(spark, sf_dir)).select("trajectory_id", "logical_call_id", *(F.col(c).cast("long").alias(c) for c in (*features.COUNTERS, "completed_call_count")))


@query("WITH" + HISTORY + """, acts AS (SELECT trajectory_id, call_no, attempt_no, list(p_brand) OVER (PARTITION BY trajectory_id ORDER BY call_no, attempt_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM att WHERE NOT dangling),
  rep AS (SELECT h.trajectory_id, h.call_no, arg_max(len(l) - len(list_distinct(l)), (a.call_no, a.attempt_no)) AS repeats FROM hist h LEFT JOIN acts a ON a.trajectory_id = h.trajectory_id AND a.call_no < h.call_no GROUP BY ALL)
  SELECT trajectory_id, 'call-' || call_no AS logical_call_id, last_call_output_tokens, round(recent_generated_mean_3, 6) AS recent_generated_mean_3, last_tool_type, last_round_tool_error_count::BIGINT AS last_round_tool_error_count, consecutive_error_rounds::BIGINT AS consecutive_error_rounds,
  coalesce(repeats, 0)::BIGINT AS repeated_action_count_3, local AS current_request_tokens_local, request_delta_tokens, round(local / 50.0, 6) AS context_utilization FROM hist JOIN rep USING (trajectory_id, call_no)""")
def closed_call_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = features.snapshots(mapping.events(spark, sf_dir))
    return rounded(at.select("trajectory_id", "logical_call_id", "last_call_output_tokens", "recent_generated_mean_3", "last_tool_type", "last_round_tool_error_count", "consecutive_error_rounds", "repeated_action_count_3", "current_request_tokens_local", "request_delta_tokens", "context_utilization"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS chars FROM conversations), w AS (SELECT *, count(*) OVER p AS n, coalesce(sum(chars) OVER p, 0) AS c, count(*) FILTER (role = 'user') OVER p AS u, count(*) FILTER (role = 'assistant') OVER p AS a FROM t WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT conv_id, turn, n::BIGINT AS request_message_count, c::BIGINT AS request_content_chars, u::BIGINT AS user_messages, a::BIGINT AS assistant_messages FROM w WHERE role = 'assistant'""")
def request_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.request_shape(mapping.table(spark, sf_dir, "conversations"))


@query("WITH" + LABELS + """ SELECT position, target, count(*) AS n FROM (
  SELECT 'call_pre' AS position, unnest(['call_billable_total', 'call_billable_output', 'call_unknown_billable', 'final_response_output']) AS target FROM ledger
  UNION ALL SELECT CASE WHEN ordinal = 1 THEN 'task_pre' ELSE 'task_update' END, unnest(['task_provider_accounted_remaining', 'task_unknown_remaining']) FROM ledger) GROUP BY ALL""")
def point_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.points(features.snapshots(mapping.events(spark, sf_dir))).groupBy("position", "target").agg(F.count("*").alias("n"))


@query("WITH" + LABELS + """ SELECT CASE WHEN ordinal = 1 THEN 'task_pre' ELSE 'task_update' END AS position, rest_status AS label_status, rest_reason AS label_reason, count(*) AS n, sum(remaining)::BIGINT AS tokens FROM labels0 GROUP BY ALL""")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.all_rows(spark, sf_dir).where("target = 'task_provider_accounted_remaining'")
    return rows.groupBy("position", "label_status", "label_reason").agg(F.count("*").alias("n"), F.sum("label_value").alias("tokens"))


@query("WITH" + CELL + " SELECT trajectory_id, task_id, condition_id, 'call-' || call_no AS logical_call_id, remaining AS label_value, round(weight, 9) AS weight FROM cell")
def weighted_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base.cell(spark, sf_dir).select("trajectory_id", "task_id", "condition_id", "logical_call_id", "label_value", "weight"), 9)


@query("WITH" + CELL + " SELECT condition_id, count(*) AS n_points, count(DISTINCT task_id) AS n_tasks, round(sum(weight), 6) AS weight_sum FROM cell GROUP BY ALL")
def cell_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task weighs 1: the weights of a condition add up to its tasks."""
    at = base.cell(spark, sf_dir)
    return rounded(at.groupBy("condition_id").agg(F.count("*").alias("n_points"), F.count_distinct("task_id").alias("n_tasks"), F.sum("weight").alias("weight_sum")))


@query("WITH" + LABELS + """, obs AS (SELECT task_id, trajectory_id, condition_id, count(*) FILTER (ordinal > 1 AND rest_status = 'observed') AS k, count(*) FILTER (ordinal > 1) AS u FROM labels0 GROUP BY ALL)
  SELECT condition_id, count(*) FILTER (k > 0) AS scored_runs, count(DISTINCT CASE WHEN k > 0 THEN task_id END)::DOUBLE AS weight_sum FROM obs GROUP BY ALL""")
def lifecycle_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.all_rows(spark, sf_dir, history=False).where("target = 'task_provider_accounted_remaining'")
    rows = kept(rows.select("condition_id", "target", "task_id", "trajectory_id", "position", "label_status"), "rows")
    at = points.lifecycle_weights(rows)
    return rounded(at.groupBy("condition_id").agg(F.count_distinct(F.when(F.col("lifecycle_weight") > 0, F.col("trajectory_id"))).alias("scored_runs"), F.sum("lifecycle_weight").alias("weight_sum")))


@query("WITH" + HISTORY + """, s AS (SELECT trajectory_id, call_no, coalesce(cumulative_in, 0) + coalesce(cumulative_out, 0) AS spent, coalesce(missing_usage_attempts, 0) AS miss FROM hist)
  SELECT trajectory_id, 'call-' || call_no AS logical_call_id, CASE WHEN miss > lag(miss) OVER w THEN NULL ELSE spent - lag(spent) OVER w END::BIGINT AS visible_spend FROM s WINDOW w AS (PARTITION BY trajectory_id ORDER BY call_no)""")
def spend_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = features.snapshots(mapping.events(spark, sf_dir)).withColumn("target", F.lit("t")).withColumn("point_id", F.col("source_event_id"))
    return points.visible_spend(snaps).select("trajectory_id", "logical_call_id", F.col("visible_spend").cast("long").alias("visible_spend"))


@query("WITH RECURSIVE" + HISTORY + """, s AS (SELECT trajectory_id, ordinal, call_no, coalesce(cumulative_in, 0) + coalesce(cumulative_out, 0) AS spent, coalesce(missing_usage_attempts, 0) AS miss FROM hist),
  d AS (SELECT trajectory_id, ordinal, call_no, CASE WHEN miss > lag(miss) OVER w THEN 0 ELSE coalesce(spent - lag(spent) OVER w, 0) END::BIGINT AS delta FROM s WINDOW w AS (PARTITION BY trajectory_id ORDER BY ordinal)),
  chain AS (SELECT trajectory_id, ordinal, 150000::BIGINT AS carried FROM d WHERE ordinal = 1 UNION ALL SELECT d.trajectory_id, d.ordinal, greatest(0, c.carried - d.delta)::BIGINT FROM chain c JOIN d ON d.trajectory_id = c.trajectory_id AND d.ordinal = c.ordinal + 1)
  SELECT trajectory_id, ordinal AS request_count, carried FROM chain""")
def carried_deduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mechanical update of a forecast of 150,000 tokens, in closed form; the SQL walks the chain."""
    snaps = features.snapshots(mapping.events(spark, sf_dir)).withColumn("target", F.lit("t")).withColumn("point_id", F.col("source_event_id")).withColumn("start", F.lit(150_000).cast("long"))
    return points.carried_forecast(points.visible_spend(snaps), "start").select("trajectory_id", F.col("request_count").cast("long").alias("request_count"), F.col("carried").cast("long").alias("carried"))


@query(f"""WITH t AS (SELECT DISTINCT o_custkey::VARCHAR AS task_id FROM orders), h AS (SELECT task_id, sha256('{SALT}' || chr(0) || task_id) AS h FROM t),
  b AS (SELECT task_id, (list_reduce([0::HUGEINT] || [('0x' || substr(h, i * 4 + 1, 4))::HUGEINT FOR i IN range(16)], lambda a, x: (a * 65536 + x) % 10000))::BIGINT AS bucket FROM h) SELECT task_id, bucket, bucket < 2000 AS in_holdout FROM b""")
def task_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(base.tasks(spark, sf_dir), SALT)


@query(f"""WITH t AS (SELECT DISTINCT o_custkey::VARCHAR AS task_id FROM orders), r AS (SELECT task_id, row_number() OVER (ORDER BY sha256('{SALT}' || chr(0) || task_id), task_id) - 1 AS rank FROM t) SELECT task_id, rank, rank % 5 AS fold FROM r""")
def task_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ranked_folds(base.tasks(spark, sf_dir), SALT, 5).select("task_id", F.col("rank").cast("long").alias("rank"), F.col("fold").cast("long").alias("fold"))


@query(f"""WITH t AS (SELECT DISTINCT o_custkey::VARCHAR AS task_id FROM orders), r AS (SELECT task_id, (row_number() OVER (ORDER BY sha256('{SALT}' || chr(0) || task_id), task_id) - 1) % 5 AS fold FROM t),
  x AS (SELECT task_id, k AS test_fold, ((fold - k) % 5 + 5) % 5 AS a FROM r, (SELECT unnest(range(5)) AS k)) SELECT test_fold, CASE a WHEN 0 THEN 'test' WHEN 1 THEN 'calibration' WHEN 2 THEN 'validation' ELSE 'train' END AS role, count(*) AS n, min(task_id) AS first_task FROM x GROUP BY ALL""")
def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = splits.ranked_folds(base.tasks(spark, sf_dir), SALT, 5).select("task_id", "fold")
    return splits.roles(folds, 5).groupBy(F.col("test_fold").cast("long").alias("test_fold"), "role").agg(F.count("*").alias("n"), F.min("task_id").alias("first_task"))


@query(f"""WITH m AS (SELECT DISTINCT o_custkey::VARCHAR AS task_id, o_orderpriority AS g FROM orders), s AS (SELECT task_id, string_agg(g, '|' ORDER BY g) AS signature FROM m GROUP BY ALL),
  r AS (SELECT task_id, signature, row_number() OVER (PARTITION BY signature ORDER BY sha256('{SALT}' || chr(0) || task_id), task_id) - 1 AS rank, sha256('{SALT}' || chr(0) || signature) AS h FROM s)
  SELECT task_id, signature, ((rank + list_reduce([0::HUGEINT] || [('0x' || substr(h, i * 4 + 1, 4))::HUGEINT FOR i IN range(16)], lambda a, x: (a * 65536 + x) % 5)) % 5)::BIGINT AS fold FROM r""")
def balanced_task_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = mapping.runs(spark, sf_dir).select("task_id", F.col("condition_id").alias("group_id")).distinct()
    return splits.balanced_folds(members, SALT, 5).withColumn("fold", F.col("fold").cast("long"))


@query(f"""WITH t AS (SELECT DISTINCT o_custkey::VARCHAR AS task_id FROM orders), h AS (SELECT task_id, sha256('{SALT}' || chr(0) || task_id) AS h FROM t),
  dev AS (SELECT task_id FROM h WHERE list_reduce([0::HUGEINT] || [('0x' || substr(h, i * 4 + 1, 4))::HUGEINT FOR i IN range(16)], lambda a, x: (a * 65536 + x) % 10000) >= 2000),
  o AS (SELECT seed, task_id, (row_number() OVER (PARTITION BY seed ORDER BY sha256('{SALT}:' || seed || ':outer' || chr(0) || task_id), task_id) - 1) % 5 AS outer_fold FROM dev, (SELECT unnest([1, 2, 3]) AS seed)),
  x AS (SELECT *, ((outer_fold - test_fold) % 5 + 5) % 5 AS ahead FROM o, (SELECT unnest(range(5)) AS test_fold))
  SELECT seed::BIGINT AS seed, task_id, test_fold, outer_fold, (row_number() OVER (PARTITION BY seed, test_fold ORDER BY sha256('{SALT}:' || seed || ':inner' || chr(0) || task_id), task_id) - 1) % 5 AS inner_fold FROM x WHERE ahead > 2""")
def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.rounded(splits.nested_protocol(base.tasks(spark, sf_dir), SALT, (1, 2, 3)))


@query("WITH" + ATTEMPTS + """, n AS (SELECT trajectory_id::BIGINT % 7 AS m, st, count(*) AS calls, sum(attempts)::BIGINT AS attempts, sum(terminals)::BIGINT AS terminals FROM calls GROUP BY trajectory_id, st), o AS (SELECT o_orderkey % 7 AS m, count(*) AS runs FROM orders GROUP BY ALL),
  v AS (SELECT 'no_start' AS violation, runs AS n FROM o WHERE m = 1 UNION ALL SELECT unnest(['end_not_last', 'several_ends']), runs FROM o WHERE m = 2 UNION ALL SELECT 'event_id_repeated', 2 * runs FROM o WHERE m = 3
    UNION ALL SELECT unnest(['before_request', 'call_not_contiguous']), attempts + 2 * terminals FROM n WHERE m = 4 UNION ALL SELECT unnest(['attempt_started_twice', 'sequence_not_increasing']), attempts FROM n WHERE m = 5
    UNION ALL SELECT 'new_call_while_attempt_open', calls - 1 FROM n WHERE m = 5 UNION ALL SELECT 'finished_while_attempt_open', 1 FROM n WHERE m = 5 AND st = 'F' UNION ALL SELECT 'outside_attempt', terminals FROM n WHERE m = 6)
  SELECT violation, sum(n)::BIGINT AS n FROM v GROUP BY ALL HAVING sum(n) > 0""")
def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with faults planted by the remainder of their number: no start, a second end, an end with the start's id, no
    requests, attempts started twice, attempts never started. Those with remainder 0 break no rule."""
    events = mapping.events(spark, sf_dir)
    m, kind = F.pmod(F.col("trajectory_id").cast("long"), F.lit(7)), F.col("event_type")
    end, start = kind.isin("task_finished", "task_aborted"), kind == "api_attempt_started"
    left = events.where(~((m == 1) & (kind == "task_started")) & ~((m == 4) & (kind == "request_built")) & ~((m == 6) & start))
    left = left.withColumn("event_id", F.when((m == 3) & end, F.concat("trajectory_id", F.lit("-0"))).otherwise(F.col("event_id")))
    ends = events.where((m == 2) & end).withColumn("event_seq", F.lit(1_000_000).cast("long")).withColumn("event_id", F.concat("event_id", F.lit("-again")))
    twice = events.where((m == 5) & start).withColumn("event_id", F.concat("event_id", F.lit("-again")))
    return validate.violations(left.unionByName(ends).unionByName(twice)).groupBy("violation").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, event_id % 8 AS m FROM events) SELECT problem, count(*) AS n, count(DISTINCT user_id) AS trajectories FROM (
  SELECT user_id, unnest(CASE m WHEN 0 THEN [] WHEN 1 THEN ['schema_version'] WHEN 2 THEN ['event_type'] WHEN 3 THEN ['event_seq'] WHEN 4 THEN ['occurred_at'] WHEN 5 THEN ['logical_call_id'] WHEN 6 THEN ['attempt_id'] ELSE ['event_id'] END) AS problem FROM e) GROUP BY ALL""")
def rejected_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click events written as canonical ones, with one fault each by the remainder of their number; those with remainder 0 pass."""
    raw, m, long = mapping.table(spark, sf_dir, "events"), F.col("event_id") % 8, lambda n: F.lit(n).cast("long")
    rows = raw.select(
        F.when(m == 1, long(0)).otherwise(long(1)).alias("schema_version"), F.when(m == 7, " ").otherwise(F.col("event_id").cast("string")).alias("event_id"), F.col("user_id").cast("string").alias("trajectory_id"), F.when(m == 3, long(-1)).otherwise(F.col("event_id")).alias("event_seq"),
        F.when(m == 2, F.col("event_type")).when(m == 6, "api_completed").otherwise("tool_completed").alias("event_type"), F.when(m != 4, F.col("ts").cast("timestamp")).alias("occurred_at"), F.when(m != 5, "call").alias("logical_call_id"), F.lit(None).cast("string").alias("attempt_id"),
    )
    bad = validate.row_problems(rows).select("trajectory_id", F.explode("problems").alias("problem"))
    return bad.groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("trajectory_id").alias("trajectories"))
