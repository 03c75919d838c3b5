"""What the registered queries share: the mapped events, supervised rows and scored forecasts, and the same as SQL.

The SQL is written from the attempts' side, independently of the event windows that it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import features, forecast, labels, points, splits
from runledger.sources import mapping
from runledger.sources.tables import kept

SALT = "runledger"
FOLDS = 5

ATTEMPTS = """
att AS (
  SELECT l_orderkey::VARCHAR AS trajectory_id, o_custkey::VARCHAR AS task_id, o_orderpriority AS condition_id, o_orderstatus AS st,
    l_linenumber::BIGINT AS call_no, attempt_no, l_discount < 0.095 AS known, floor(l_extendedprice)::BIGINT AS i0, l_quantity::BIGINT AS o0,
    (l_tax >= 0.075 AND l_discount < 0.005) AND l_discount < 0.095 AS off, l_returnflag = 'R' AS failed, l_linestatus = 'O' AND l_quantity > 40 AS tool_failed,
    o_orderstatus = 'O' AND row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, attempt_no DESC) = 1 AS dangling,
    CASE WHEN p_size % 10 <> 0 THEN p_size::BIGINT END AS p_size, p_type, p_brand
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS attempt_no FROM lineitem) l
  JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
calls AS (
  SELECT trajectory_id, any_value(task_id) AS task_id, any_value(condition_id) AS condition_id, any_value(st) AS st, call_no, max(CASE WHEN attempt_no = 1 THEN p_size END) AS local,
    count(*) AS attempts, count(*) FILTER (NOT dangling) AS terminals, bool_or(dangling) AS dangling, count(*) FILTER (NOT dangling AND NOT known) AS unknown, count(*) FILTER (NOT dangling AND off) AS mismatched,
    count(*) FILTER (NOT dangling AND NOT failed) AS completed, count(*) FILTER (NOT dangling AND failed) AS failures, count(*) FILTER (NOT dangling AND tool_failed) AS tool_failures,
    count(*) FILTER (NOT dangling AND NOT tool_failed) AS tool_completed, coalesce(sum(i0) FILTER (NOT dangling AND known), 0)::BIGINT AS known_in, coalesce(sum(o0) FILTER (NOT dangling AND known), 0)::BIGINT AS known_out,
    arg_max(CASE WHEN known THEN o0 END, attempt_no) FILTER (NOT dangling AND NOT failed) AS final_out, arg_max(p_type, attempt_no) FILTER (NOT dangling) AS tool_type
  FROM att GROUP BY trajectory_id, call_no),
ledger AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY call_no) AS ordinal,
    CASE WHEN dangling THEN 'censored' WHEN terminals = 0 OR unknown > 0 THEN 'missing' WHEN mismatched > 0 THEN 'invalid' ELSE 'observed' END AS status,
    CASE WHEN dangling THEN 'unterminated_api_attempt' WHEN terminals = 0 THEN 'missing_call_terminal' WHEN unknown > 0 THEN 'missing_usage' WHEN mismatched > 0 THEN 'usage_total_mismatch' ELSE '' END AS reason
  FROM calls)"""

LABELS = (
    ATTEMPTS
    + """,
suffix AS (
  SELECT *, sum(CASE WHEN status = 'observed' THEN known_in + known_out END) OVER s AS rest, arg_min(CASE WHEN status <> 'observed' THEN status END, CASE WHEN status <> 'observed' THEN call_no END) OVER s AS bad_status,
    arg_min(CASE WHEN status <> 'observed' THEN reason END, CASE WHEN status <> 'observed' THEN call_no END) OVER s AS bad_reason
  FROM ledger WINDOW s AS (PARTITION BY trajectory_id ORDER BY call_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rest0 AS (
  SELECT *, CASE WHEN st = 'O' THEN 'censored' ELSE coalesce(bad_status, 'observed') END AS rest_status, CASE WHEN st = 'O' THEN 'max_turns' ELSE coalesce(bad_reason, '') END AS rest_reason FROM suffix),
labels0 AS (
  SELECT *, CASE WHEN rest_status = 'observed' THEN rest END AS remaining, CASE WHEN rest_status = 'observed' AND local IS NULL THEN 'missing' WHEN rest_status = 'observed' AND rest - local < 0 THEN 'invalid' ELSE rest_status END AS unk_status FROM rest0)"""
)

HISTORY = (
    LABELS
    + """,
hist AS (
  SELECT trajectory_id, call_no, ordinal, local,
    sum(completed) OVER b AS completed_api_attempts, sum(failures) OVER b AS failed_api_attempts, sum(tool_completed) OVER b AS completed_tool_calls, sum(tool_failures) OVER b AS failed_tool_calls,
    sum(terminals - unknown) OVER b AS known_usage_attempts, sum(unknown) OVER b AS missing_usage_attempts, sum(known_in) OVER b AS cumulative_in, sum(known_out) OVER b AS cumulative_out,
    lag(CASE WHEN NOT dangling AND terminals > 0 AND unknown = 0 THEN known_out END) OVER o AS last_call_output_tokens,
    CASE WHEN count(*) OVER t = count(CASE WHEN NOT dangling AND terminals > 0 AND unknown = 0 THEN 1 END) OVER t AND count(*) OVER t > 0 THEN avg(known_out) OVER t END AS recent_generated_mean_3,
    lag(tool_type) OVER o AS last_tool_type, coalesce(lag(tool_failures) OVER o, 0) AS last_round_tool_error_count,
    ordinal - 1 - coalesce(max(CASE WHEN failures = 0 AND tool_failures = 0 THEN ordinal END) OVER b, 0) AS consecutive_error_rounds,
    local - lag(local) OVER o AS request_delta_tokens
  FROM ledger WINDOW o AS (PARTITION BY trajectory_id ORDER BY call_no), b AS (PARTITION BY trajectory_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY trajectory_id ORDER BY call_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
)

#: Observed update rows on the remaining tokens of the task, with weights: the cell that forecasts are made for.
CELL = (
    HISTORY
    + """,
upd AS (SELECT * FROM labels0 WHERE ordinal > 1 AND rest_status = 'observed'),
cell AS (
  SELECT u.trajectory_id, u.task_id, u.condition_id, u.call_no, u.ordinal, u.local, u.remaining, 1.0 / (r.runs * p.points) AS weight
  FROM upd u JOIN (SELECT condition_id, task_id, count(DISTINCT trajectory_id) AS runs FROM upd GROUP BY ALL) r USING (condition_id, task_id)
  JOIN (SELECT trajectory_id, count(*) AS points FROM upd GROUP BY ALL) p USING (trajectory_id))"""
)

_FOLDED = """,
fold AS (SELECT task_id, (row_number() OVER (ORDER BY sha256('{salt}' || chr(0) || task_id), task_id) - 1) % {k} AS fold FROM (SELECT DISTINCT task_id FROM orders_t)),
seen AS (SELECT c.*, f.fold, t.k AS test_fold, ((f.fold - t.k) % {k} + {k}) % {k} AS ahead FROM cell c JOIN fold f USING (task_id), (SELECT unnest(range({k})) AS k) t),
cum AS (SELECT condition_id, test_fold, remaining, sum(w) OVER (PARTITION BY condition_id, test_fold ORDER BY remaining) AS c, sum(w) OVER (PARTITION BY condition_id, test_fold) AS t
  FROM (SELECT condition_id, test_fold, remaining, sum(weight) AS w FROM seen WHERE ahead NOT IN (0, 1, 2) GROUP BY ALL)),
par AS (SELECT condition_id, test_fold, min(remaining) FILTER (c >= (0.05 - 1e-12) * t) AS lo, min(remaining) FILTER (c >= (0.5 - 1e-12) * t) AS mid, coalesce(min(remaining) FILTER (c >= (0.95 - 1e-12) * t), max(remaining)) AS hi FROM cum GROUP BY ALL),
conf AS (SELECT condition_id, test_fold, score, row_number() OVER (PARTITION BY condition_id, test_fold ORDER BY score, task_id) AS r, count(*) OVER (PARTITION BY condition_id, test_fold) AS n
  FROM (SELECT condition_id, test_fold, task_id, max(greatest(lo - remaining, remaining - hi, 0)) AS score FROM seen JOIN par USING (condition_id, test_fold) WHERE ahead = 1 GROUP BY ALL)),
expa AS (SELECT condition_id, test_fold, score AS expansion FROM conf WHERE r = least(n, greatest(1, ceil((n + 1) * 0.9)))),
scored AS (SELECT s.trajectory_id, s.task_id, s.condition_id, s.call_no, s.ordinal, s.weight, s.fold, s.remaining::DOUBLE AS truth, greatest(0, lo - expansion)::DOUBLE AS lower, mid::DOUBLE AS point, greatest(mid, hi + expansion)::DOUBLE AS upper,
    lo::DOUBLE AS raw_lower, hi::DOUBLE AS raw_upper FROM seen s JOIN par USING (condition_id, test_fold) JOIN expa USING (condition_id, test_fold) WHERE ahead = 0)"""
SCORED = CELL + ",\norders_t AS (SELECT o_custkey::VARCHAR AS task_id FROM orders)" + _FOLDED.format(salt=SALT, k=FOLDS)


def labelled(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``labels.suffix_labels`` of the mapped events, counted in the attempts; with the columns ``keep`` of the run."""
    calls = mapping.calls(spark, sf_dir).withColumns(dict(zip(("termination_status", "termination_reason"), labels.terminated(F.col("terminal"), F.col("reason")))))
    return labels.rest_labels(labels.call_labels(calls, "termination_status", "termination_reason", *keep))


def requests(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``features.snapshots`` of every request of the mapped events, counted in the attempts; with the columns ``keep`` of the run."""
    return features.of_calls(mapping.calls(spark, sf_dir)).select(*features.SEEN, *features.PAST, *keep)


def _labelled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` and ``labelled`` in one row, with the run's task and condition: runs are shuffled once, nothing is joined."""
    ends = dict(zip(("termination_status", "termination_reason"), labels.terminated(F.col("terminal"), F.col("reason"))))
    calls = features.of_calls(mapping.calls(spark, sf_dir)).withColumns(ends)
    own = [c for c in (*features.SEEN, *features.PAST) if c not in ("trajectory_id", "logical_call_id")]
    return labels.rest_labels(labels.call_labels(calls, *ends, *own, "task_id", "condition_id"))


def all_rows(spark: SparkSession, sf_dir: str, history: bool = True) -> DataFrame:
    """Supervised rows of all runs: points, labels and features, without ``history`` the running counters alone."""
    return points.rows_of(_labelled_requests(spark, sf_dir), features.SEEN + (features.PAST if history else ()))


def cell(spark: SparkSession, sf_dir: str, history: bool = False) -> DataFrame:
    """Weighted observed rows of task_update on the remaining tokens, all conditions; all features with ``history``, else
    the number and size of the request."""
    cell = ("task_update", "task_provider_accounted_remaining")
    if history:
        rows = all_rows(spark, sf_dir).where((F.col("position") == cell[0]) & (F.col("target") == cell[1]))
    else:
        rows = points.request_cell(None, labelled(spark, sf_dir, "task_id", "condition_id"), *cell)
    return points.weighted(kept(points.eligible(rows), "cell"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.runs(spark, sf_dir).select("task_id").distinct()


def scored(spark: SparkSession, sf_dir: str, fit=forecast.fit_empirical) -> DataFrame:
    """Cross-validated, calibrated forecasts of the cell."""
    folds = splits.ranked_folds(tasks(spark, sf_dir), SALT, FOLDS)
    narrow = ("point_id", "trajectory_id", "task_id", "condition_id", "logical_call_id", "cutoff_event_seq", "label_value", "weight")
    return kept(forecast.cross_validated(cell(spark, sf_dir).select(*narrow), folds, FOLDS, fit=fit), "scored")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparing sums taken in different orders; integers as longs."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes))
