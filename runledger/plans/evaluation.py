"""Queries on forecasts, calibration, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.operators import compare, crossfit, forecast, metrics, points, splits
from runledger.plans import base
from runledger.plans.base import CELL, HISTORY, SCORED, rounded
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


_STEP = "(SELECT condition_id, min(v) FILTER (c >= ({q} - 1e-12) * t) AS x FROM (SELECT condition_id, v, sum(w) OVER (PARTITION BY condition_id ORDER BY v) AS c, sum(w) OVER (PARTITION BY condition_id) AS t FROM (SELECT condition_id, {v} AS v, sum(weight) AS w FROM scored GROUP BY ALL)) GROUP BY ALL)"


_LAUNCH_SQL = f""",
  lch AS (SELECT * FROM labels0 WHERE ordinal = 1 AND rest_status = 'observed'), lw AS (SELECT l.*, 1.0 / r.runs AS weight FROM lch l JOIN (SELECT condition_id, task_id, count(DISTINCT trajectory_id) AS runs FROM lch GROUP BY ALL) r USING (condition_id, task_id)),
  fold AS (SELECT task_id, (row_number() OVER (ORDER BY sha256('{base.SALT}' || chr(0) || task_id), task_id) - 1) % {base.FOLDS} AS fold FROM (SELECT DISTINCT o_custkey::VARCHAR AS task_id FROM orders)),
  seen AS (SELECT w.*, t.k AS test_fold, ((f.fold - t.k) % {base.FOLDS} + {base.FOLDS}) % {base.FOLDS} AS ahead FROM lw w JOIN fold f USING (task_id), (SELECT unnest(range({base.FOLDS})) AS k) t),
  par AS (SELECT condition_id, test_fold, min(remaining) FILTER (c >= (0.5 - 1e-12) * t) AS mid FROM (SELECT condition_id, test_fold, remaining, sum(w) OVER (PARTITION BY condition_id, test_fold ORDER BY remaining) AS c, sum(w) OVER (PARTITION BY condition_id, test_fold) AS t
    FROM (SELECT condition_id, test_fold, remaining, sum(weight) AS w FROM seen WHERE ahead NOT IN (0, 1, 2) GROUP BY ALL)) GROUP BY ALL)"""


@query("WITH" + CELL + """, cum AS (SELECT condition_id, remaining, sum(w) OVER (PARTITION BY condition_id ORDER BY remaining) AS c, sum(w) OVER (PARTITION BY condition_id) AS t FROM (SELECT condition_id, remaining, sum(weight) AS w FROM cell GROUP BY ALL))
  SELECT condition_id, min(remaining) FILTER (c >= (0.05 - 1e-12) * t)::DOUBLE AS lower, min(remaining) FILTER (c >= (0.5 - 1e-12) * t)::DOUBLE AS point, min(remaining) FILTER (c >= (0.95 - 1e-12) * t)::DOUBLE AS upper FROM cum GROUP BY ALL""")
def empirical_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.fit_empirical(base.cell(spark, sf_dir), ["condition_id"])


@query("WITH" + CELL + """, o AS (SELECT * FROM cell WHERE local IS NOT NULL), m AS (SELECT condition_id, sum(weight * local) / sum(weight) AS mx, sum(weight * remaining) / sum(weight) AS my FROM o GROUP BY ALL),
  l AS (SELECT condition_id, sum(weight * (local - mx) * (remaining - my)) / sum(weight * (local - mx) * (local - mx)) AS slope, any_value(my) AS my, any_value(mx) AS mx FROM o JOIN m USING (condition_id) GROUP BY ALL)
  SELECT condition_id, round(slope, 3) AS slope, round(my - slope * mx, 1) AS intercept FROM l""")
def length_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = forecast.fit_line(base.cell(spark, sf_dir), "current_request_tokens_local", ["condition_id"])
    return fitted.select("condition_id", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"))


_PLAIN = "(SELECT condition_id, min(v) FILTER (c >= (0.05 - 1e-12) * t) AS low, min(v) FILTER (c >= (0.95 - 1e-12) * t) AS high FROM (SELECT condition_id, v, sum(w) OVER (PARTITION BY condition_id ORDER BY v) AS c, sum(w) OVER (PARTITION BY condition_id) AS t FROM (SELECT condition_id, round(v, 6) AS v, sum(weight) AS w FROM e GROUP BY ALL)) GROUP BY ALL)"


@query("WITH" + CELL + """, o AS (SELECT * FROM cell WHERE local IS NOT NULL), m AS (SELECT condition_id, sum(weight * local) / sum(weight) AS mx, sum(weight * remaining) / sum(weight) AS my FROM o GROUP BY ALL),
  l AS (SELECT condition_id, sum(weight * (local - mx) * (remaining - my)) / sum(weight * (local - mx) * (local - mx)) AS slope, any_value(my) AS my, any_value(mx) AS mx FROM o JOIN m USING (condition_id) GROUP BY ALL),
  e AS (SELECT o.*, my + slope * (local - mx) AS said, remaining - (my + slope * (local - mx)) AS v FROM o JOIN l USING (condition_id))
  SELECT trajectory_id, 'call-' || call_no AS logical_call_id, round(greatest(0, least(said + low, greatest(0, said))), 1) AS lower, round(greatest(0, said), 1) AS point, round(greatest(said + high, greatest(0, said)), 1) AS upper FROM e JOIN """ + _PLAIN + """ q USING (condition_id)""")
def length_line_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = points.eligible(base.cell(spark, sf_dir), features=("current_request_tokens_local",))
    params = forecast.fit_line(cell, "current_request_tokens_local", ["condition_id"])
    return rounded(forecast.predict_line(cell, params, "current_request_tokens_local", ["condition_id"]).select("trajectory_id", "logical_call_id", "lower", "point", "upper"), 1)


@query("WITH" + CELL + """, e AS (SELECT *, ordinal * 20000.0::DOUBLE AS said, (remaining - ordinal * 20000.0)::DOUBLE AS v FROM cell)
  SELECT trajectory_id, 'call-' || call_no AS logical_call_id, round(least(greatest(0, said + low), said), 3) AS lower, said AS point, round(greatest(said + high, said), 3) AS upper FROM e JOIN """ + _PLAIN + """ q USING (condition_id)""")
def external_estimate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate from outside (calls so far times 20,000 tokens) with residual quantiles."""
    cell = base.cell(spark, sf_dir).withColumn("estimate", F.col("request_count") * 20_000.0)
    return rounded(forecast.predict_bands(cell, forecast.fit_residual_bands(cell, "estimate", ["condition_id"]), "estimate", ["condition_id"]).select("trajectory_id", "logical_call_id", "lower", "point", "upper"), 3)


@query("WITH" + SCORED + " SELECT trajectory_id, 'call-' || call_no AS logical_call_id, round(lower, 3) AS lower, round(point, 3) AS point, round(upper, 3) AS upper, round(raw_lower, 3) AS raw_lower, round(raw_upper, 3) AS raw_upper FROM scored")
def cross_validated_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base.scored(spark, sf_dir).select("trajectory_id", "logical_call_id", "lower", "point", "upper", "raw_lower", "raw_upper"), 3)


@query("WITH" + SCORED + f""" SELECT s.condition_id, count(*) AS n_points, count(DISTINCT task_id) AS n_tasks, count(DISTINCT trajectory_id) AS n_trajectories, round(sum(weight), 6) AS weight_sum, round(sum(weight * abs(point - truth)) / sum(weight), 4) AS mae,
  round(sum(weight * abs(point - truth)) / sum(weight * abs(truth)), 6) AS wape, round(sum(weight * (point - truth)) / sum(weight), 4) AS mean_bias, round(sum(weight * (point < truth)::INT) / sum(weight), 6) AS underestimation_rate,
  round(sum(weight * (truth BETWEEN lower AND upper)::INT) / sum(weight), 6) AS coverage, round(sum(weight * (upper < truth)::INT) / sum(weight), 6) AS interval_below_truth_rate, round(sum(weight * (lower > truth)::INT) / sum(weight), 6) AS interval_above_truth_rate,
  round(sum(weight * greatest(0, upper - truth)) / sum(weight), 4) AS mean_extra_reserved_tokens, round(sum(weight * (upper - lower + 20 * greatest(0, lower - truth) + 20 * greatest(0, truth - upper))) / sum(weight), 4) AS interval_score,
  round(sum(weight * (upper - lower) / greatest(abs(truth), 1)) / sum(weight), 4) AS normalized_interval_width, round(any_value(a.x), 4) AS median_ae, round(any_value(b.x), 4) AS p90_ae, round(any_value(c.x), 4) AS median_interval_width, round(any_value(d.x), 6) AS task_simultaneous_coverage,
  round(any_value(e.x), 6) AS pearson, round(sum(weight * (upper < truth)::INT) / sum(weight), 6) AS target_exceeds_upper_rate
  FROM scored s JOIN {_STEP.format(q=0.5, v='abs(point - truth)')} a USING (condition_id) JOIN {_STEP.format(q=0.9, v='abs(point - truth)')} b USING (condition_id) JOIN {_STEP.format(q=0.5, v='upper - lower')} c USING (condition_id)
  JOIN (SELECT condition_id, avg(ok::DOUBLE) AS x FROM (SELECT condition_id, task_id, min((truth BETWEEN lower AND upper)::INT) AS ok FROM scored GROUP BY ALL) GROUP BY ALL) d USING (condition_id)
  JOIN (SELECT condition_id, sum(weight * (truth - mt) * (point - mp)) / sqrt(sum(weight * (truth - mt) ** 2) * sum(weight * (point - mp) ** 2)) AS x FROM scored JOIN (SELECT condition_id, sum(weight * truth) / sum(weight) AS mt, sum(weight * point) / sum(weight) AS mp FROM scored GROUP BY ALL) USING (condition_id) GROUP BY ALL) e USING (condition_id) GROUP BY s.condition_id""")
def metric_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.suite(base.scored(spark, sf_dir), ["condition_id"])
    tokens = ("mae", "mean_bias", "mean_extra_reserved_tokens", "interval_score", "normalized_interval_width", "median_ae", "p90_ae", "median_interval_width")
    return out.select(*(F.round(c, 4 if c in tokens else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("WITH" + SCORED + """ SELECT condition_id, task_id, count(*) AS n_points, round(sum(weight), 6) AS weight_sum, round(sum(weight * abs(point - truth)) / sum(weight), 4) AS mae, round(sum(weight * (truth BETWEEN lower AND upper)::INT) / sum(weight), 6) AS coverage,
  round(sum(weight * (upper - lower + 20 * greatest(0, lower - truth) + 20 * greatest(0, truth - upper))) / sum(weight), 4) AS interval_score FROM scored GROUP BY ALL""")
def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_task(base.scored(spark, sf_dir), ["condition_id"])
    return out.select("condition_id", "task_id", "n_points", F.round("weight_sum", 6).alias("weight_sum"), F.round("mae", 4).alias("mae"), F.round("coverage", 6).alias("coverage"), F.round("interval_score", 4).alias("interval_score"))


@query("WITH" + SCORED + """, b AS (SELECT *, unnest([50000, 100000, 200000]) AS budget_tokens FROM scored) SELECT budget_tokens, count(*) AS n_points, round(sum(weight * (truth > budget_tokens)::INT) / sum(weight), 6) AS actual_overrun_rate, round(sum(weight * (point > budget_tokens)::INT) / sum(weight), 6) AS predicted_overrun_rate,
  round(sum(weight * ((truth > budget_tokens) = (point > budget_tokens))::INT) / sum(weight), 6) AS accuracy, round(coalesce(sum(weight) FILTER (truth > budget_tokens AND point > budget_tokens) / nullif(sum(weight) FILTER (point > budget_tokens), 0), 0), 6) AS precision,
  round(coalesce(sum(weight) FILTER (truth > budget_tokens AND point > budget_tokens) / nullif(sum(weight) FILTER (truth > budget_tokens), 0), 0), 6) AS recall, round(sum(weight * (lower <= budget_tokens AND upper > budget_tokens)::INT) / sum(weight), 6) AS interval_uncertain_rate,
  round(coalesce(sum(weight * (truth - budget_tokens)) FILTER (truth > budget_tokens AND point <= budget_tokens), 0) / sum(weight), 3) AS mean_missed_overrun_tokens FROM b GROUP BY ALL""")
def budget_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.budgets(base.scored(spark, sf_dir), (50_000, 100_000, 200_000))
    return out.select(F.col("budget_tokens").cast("long").alias("budget_tokens"), "n_points", *(F.round(c, 6).alias(c) for c in ("actual_overrun_rate", "predicted_overrun_rate", "accuracy", "precision", "recall", "interval_uncertain_rate")), F.round("mean_missed_overrun_tokens", 3).alias("mean_missed_overrun_tokens"))


@query("WITH" + SCORED + """, n AS (SELECT *, row_number() OVER (PARTITION BY condition_id, trajectory_id ORDER BY call_no) AS i, count(*) OVER (PARTITION BY condition_id, trajectory_id) AS k FROM scored),
  r AS (SELECT condition_id, task_id, count(DISTINCT trajectory_id) AS runs FROM scored GROUP BY ALL), p AS (SELECT unnest(['p25', 'p50', 'p75']) AS checkpoint, unnest([0.25, 0.5, 0.75]) AS f)
  SELECT checkpoint, n.condition_id, count(*) AS n_points, round(sum(abs(point - truth) / runs) / sum(1.0 / runs), 4) AS mae FROM n JOIN r USING (condition_id, task_id) JOIN p ON i = greatest(1, ceil(f * k)) GROUP BY ALL""")
def progress_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = metrics.progress(base.scored(spark, sf_dir), by=["condition_id"])
    return at.groupBy("checkpoint", "condition_id").agg(F.count("*").alias("n_points"), F.round(metrics.weighted_mean(F.abs(F.col("point") - F.col("truth"))), 4).alias("mae"))


@query("WITH" + CELL + """, t AS (SELECT condition_id, task_id, trajectory_id, max(remaining) AS total FROM cell GROUP BY ALL), k AS (SELECT condition_id, task_id, var_pop(total) AS v, quantile_cont(total, 0.75) - quantile_cont(total, 0.25) AS q, max(total) - min(total) AS r FROM t GROUP BY ALL HAVING count(*) >= 2)
  SELECT condition_id, count(*) AS n_tasks, round(avg(v), 0) AS variance_mean, round(median(q), 3) AS iqr_median, round(avg(r), 3) AS range_mean, max(r)::DOUBLE AS range_max FROM k GROUP BY ALL""")
def run_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = base.cell(spark, sf_dir).groupBy("condition_id", "task_id", "trajectory_id").agg(F.max("label_value").alias("total"))
    out = metrics.run_dispersion(totals, ["condition_id"])
    return out.select("condition_id", "n_tasks", F.round("variance_mean", 0).alias("variance_mean"), F.round("iqr_median", 3).alias("iqr_median"), F.round("range_mean", 3).alias("range_mean"), F.col("range_max").cast("double").alias("range_max"))


@query("WITH" + SCORED + """ SELECT condition_id, round(sum(weight * greatest(0.05 * (truth - lower), -0.95 * (truth - lower))) / sum(weight), 4) AS pinball_lower, round(sum(weight * greatest(0.5 * (truth - point), -0.5 * (truth - point))) / sum(weight), 4) AS pinball_point,
  round(sum(weight * greatest(0.95 * (truth - upper), -0.05 * (truth - upper))) / sum(weight), 4) AS pinball_upper FROM scored GROUP BY ALL""")
def pinball_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pinball(base.scored(spark, sf_dir), {"lower": 0.05, "point": 0.5, "upper": 0.95}, ["condition_id"]), 4)


@query("WITH" + SCORED + """, p AS (SELECT task_id, weight, abs(point - truth) AS c, abs(100000 - truth) AS r FROM scored), t AS (SELECT task_id, sum(weight) AS w, sum(weight * c) AS c, sum(weight * r) AS r FROM p GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS place, count(*) OVER () AS n FROM t), d AS (SELECT b, ('0x' || substr(md5('seed|' || b || '|' || place), 1, 8))::BIGINT % n AS pick FROM n, (SELECT unnest(range(1, 201)) AS b)),
  s AS (SELECT b, (sum(n.c) - sum(n.r)) / sum(n.w) AS delta FROM d JOIN n ON n.place = d.pick GROUP BY ALL)
  SELECT (SELECT count(*) FROM t) AS n_tasks, (SELECT round(sum(c) / sum(w), 4) FROM t) AS candidate_mae, (SELECT round(sum(r) / sum(w), 4) FROM t) AS reference_mae, round(quantile_cont(delta, 0.025), 4) AS ci_low, round(quantile_cont(delta, 0.975), 4) AS ci_high, avg((delta < 0)::INT)::DOUBLE AS win_probability FROM s""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-validated forecasts against a flat guess of 100,000 tokens, 200 replicates."""
    candidate = base.scored(spark, sf_dir)
    pairs = compare.paired_errors(candidate, candidate.withColumn("point", F.lit(100_000.0)))
    return rounded(compare.paired_bootstrap(pairs, 200, "seed").select("n_tasks", "candidate_mae", "reference_mae", "ci_low", "ci_high", "win_probability"), 4)


@query("WITH m AS (SELECT o_custkey::VARCHAR AS task_id, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY ALL) SELECT count(*) AS n_tasks, min(task_id) AS first_task, max(task_id) AS last_task FROM m WHERE k = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def tasks_in_all_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.in_all_conditions(mapping.runs(spark, sf_dir)).agg(F.count_distinct("task_id").alias("n_tasks"), F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task"))


@query("WITH" + SCORED + """, m AS (SELECT *, unnest([0.9, 1.0, 1.1]) AS f FROM scored) SELECT trajectory_id, 'call-' || call_no AS logical_call_id, round(avg(lower * f), 3) AS lower, round(avg(point * f), 3) AS point, round(avg(upper * f), 3) AS upper FROM m GROUP BY ALL""")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members: the forecasts times 0.9, 1 and 1.1."""
    one = base.scored(spark, sf_dir).select("point_id", "trajectory_id", "logical_call_id", "lower", "point", "upper", F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1))).alias("member"))
    members = one.select("point_id", "trajectory_id", "logical_call_id", "member", *((F.col(c) * F.col("member")).alias(c) for c in ("lower", "point", "upper")))
    return rounded(forecast.ensemble(members, 3, ["trajectory_id", "logical_call_id"]).drop("point_id"), 3)


@query("WITH" + SCORED + """, a AS (SELECT condition_id, fold AS seed, sum(weight * abs(point - truth)) / sum(weight) AS mae, sum(weight * (truth BETWEEN lower AND upper)::INT) / sum(weight) AS coverage FROM scored GROUP BY ALL),
  u AS (SELECT condition_id, 'mae' AS metric, mae AS value FROM a UNION ALL SELECT condition_id, 'coverage', coverage FROM a) SELECT condition_id, metric, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_pop(value), 4) AS deviation FROM u GROUP BY ALL""")
def across_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold as a repetition: mean, range and deviation of the metrics."""
    s = base.scored(spark, sf_dir)
    by = s.groupBy("condition_id", F.col("fold").alias("seed")).agg(metrics.weighted_mean(F.abs(F.col("point") - F.col("truth"))).alias("mae"), metrics.weighted_mean(F.col("truth").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))
    return rounded(metrics.across_seeds(by, ["mae", "coverage"], ["condition_id"]), 4)


@query("WITH RECURSIVE" + HISTORY + _LAUNCH_SQL + """, s AS (SELECT trajectory_id, ordinal, call_no, coalesce(cumulative_in, 0) + coalesce(cumulative_out, 0) AS spent, coalesce(missing_usage_attempts, 0) AS miss FROM hist),
  d AS (SELECT trajectory_id, ordinal, call_no, CASE WHEN miss > lag(miss) OVER w THEN 0 ELSE coalesce(spent - lag(spent) OVER w, 0) END::BIGINT AS delta FROM s WINDOW w AS (PARTITION BY trajectory_id ORDER BY ordinal)),
  chain AS (SELECT d.trajectory_id, d.ordinal, d.call_no, p.mid AS carried FROM d JOIN (SELECT DISTINCT trajectory_id, task_id, condition_id FROM ledger) r USING (trajectory_id) JOIN fold f USING (task_id) JOIN par p ON p.condition_id = r.condition_id AND p.test_fold = f.fold WHERE d.ordinal = 1
    UNION ALL SELECT d.trajectory_id, d.ordinal, d.call_no, greatest(0, c.carried - d.delta)::BIGINT FROM chain c JOIN d ON d.trajectory_id = c.trajectory_id AND d.ordinal = c.ordinal + 1)
  SELECT trajectory_id, 'call-' || call_no AS logical_call_id, carried::DOUBLE AS carried FROM chain""")
def carried_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The launch forecast of each run carried through its updates less what was spent. A run's start is the median of
    its condition's launches among the training tasks of the fold that its own task is tested in."""
    rows = kept(base.all_rows(spark, sf_dir, history=False).where("target = 'task_provider_accounted_remaining'"), "rows")
    folds = splits.ranked_folds(base.tasks(spark, sf_dir), base.SALT, base.FOLDS).select("task_id", "fold")
    launches = points.weighted(points.eligible(rows, "task_pre")).join(folds, "task_id")
    start = forecast.fit_empirical(splits.roles(launches, base.FOLDS).where("role = 'train'"), ["condition_id", "test_fold"]).select("condition_id", F.col("test_fold").alias("fold"), F.col("point").alias("start"))
    at = rows.join(folds, "task_id").join(start, ["condition_id", "fold"])
    return points.carried_forecast(points.visible_spend(at), "start").select("trajectory_id", "logical_call_id", F.col("carried").cast("double").alias("carried"))


_CROSSFIT = f""",
  inn AS (SELECT task_id, test_fold, (row_number() OVER (PARTITION BY test_fold ORDER BY sha256('{base.SALT}:inner' || chr(0) || task_id), task_id) - 1) % 5 AS inner_fold FROM (SELECT task_id, k AS test_fold, ((fold - k) % {base.FOLDS} + {base.FOLDS}) % {base.FOLDS} AS ahead FROM fold, (SELECT unnest(range({base.FOLDS})) AS k)) WHERE ahead > 2),
  comp AS (SELECT condition_id, test_fold, k AS component, remaining, sum(weight) AS w FROM lw JOIN inn USING (task_id), (SELECT unnest(range(5)) AS k) WHERE k <> inner_fold GROUP BY ALL),
  run AS (SELECT condition_id, test_fold, component, remaining, sum(w) OVER (PARTITION BY condition_id, test_fold, component ORDER BY remaining) AS c, sum(w) OVER (PARTITION BY condition_id, test_fold, component) AS t FROM comp),
  q AS (SELECT condition_id, test_fold, component, min(remaining) FILTER (c >= (0.05 - 1e-12) * t) AS lo, min(remaining) FILTER (c >= (0.5 - 1e-12) * t) AS mid, coalesce(min(remaining) FILTER (c >= (0.95 - 1e-12) * t), max(remaining)) AS hi FROM run GROUP BY ALL),
  z AS (SELECT l.trajectory_id, l.task_id, l.condition_id, k AS test_fold, CASE ((f.fold - k) % {base.FOLDS} + {base.FOLDS}) % {base.FOLDS} WHEN 0 THEN 'test' WHEN 1 THEN 'calibration' WHEN 2 THEN 'validation' ELSE 'train' END AS role, count(*) AS producers, avg(lo)::DOUBLE AS lower, avg(mid)::DOUBLE AS point, avg(hi)::DOUBLE AS upper
    FROM (FROM labels0 WHERE ordinal = 1) l JOIN fold f USING (task_id) CROSS JOIN (SELECT unnest(range({base.FOLDS})) AS k) LEFT JOIN inn i ON i.task_id = l.task_id AND i.test_fold = k JOIN q ON q.condition_id = l.condition_id AND q.test_fold = k AND (i.inner_fold IS NULL OR i.inner_fold = q.component) GROUP BY ALL)"""


#: What carrying a forecast through a run's rows reads.
_CARRIED = (
    "trajectory_id", "point_id", "cutoff_event_seq", "task_id", "condition_id", "position", "target", "label_value", "label_status",
    "cumulative_provider_input_tokens", "cumulative_provider_output_tokens", "missing_usage_attempts",
)


def _seeds(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = kept(splits.ranked_folds(base.tasks(spark, sf_dir), base.SALT, base.FOLDS), "folds")
    launches = rows.where("position = 'task_pre'").select("trajectory_id", "task_id", "condition_id")
    return crossfit.seeds(launches, points.weighted(points.eligible(rows, "task_pre")).select("task_id", "condition_id", "label_value", "weight"), folds, base.FOLDS, base.SALT)


@query("WITH" + HISTORY + _LAUNCH_SQL + _CROSSFIT + " SELECT trajectory_id, test_fold::BIGINT AS test_fold, role, producers, round(lower, 3) AS lower, round(point, 3) AS point, round(upper, 3) AS upper FROM z")
def crossfit_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start forecasts of all runs: of one component for training tasks, of all five for the others."""
    launches = base.all_rows(spark, sf_dir, history=False).where("position = 'task_pre' AND target = 'task_provider_accounted_remaining'")
    rows = kept(launches.select("trajectory_id", "task_id", "condition_id", "position", "target", "label_value", "label_status"), "launches")
    return rounded(_seeds(rows, spark, sf_dir).select("trajectory_id", "test_fold", "role", "producers", "lower", "point", "upper"), 3)


@query("WITH RECURSIVE" + CELL + _LAUNCH_SQL + _CROSSFIT + """, s AS (SELECT trajectory_id, ordinal, call_no, coalesce(cumulative_in, 0) + coalesce(cumulative_out, 0) AS spent, coalesce(missing_usage_attempts, 0) AS miss FROM hist),
  d AS (SELECT trajectory_id, ordinal, call_no, CASE WHEN miss > lag(miss) OVER w THEN 0 ELSE coalesce(spent - lag(spent) OVER w, 0) END::BIGINT AS delta FROM s WINDOW w AS (PARTITION BY trajectory_id ORDER BY ordinal)),
  chain AS (SELECT trajectory_id, condition_id, task_id, test_fold, role, ordinal, call_no, lower, point, upper FROM d JOIN z USING (trajectory_id) WHERE ordinal = 1 AND role IN ('test', 'calibration')
    UNION ALL SELECT c.trajectory_id, c.condition_id, c.task_id, c.test_fold, c.role, d.ordinal, d.call_no, greatest(0, c.lower - d.delta), greatest(0, c.point - d.delta), greatest(0, c.upper - d.delta) FROM chain c JOIN d ON d.trajectory_id = c.trajectory_id AND d.ordinal = c.ordinal + 1),
  hit AS (SELECT h.*, u.remaining, u.weight FROM chain h JOIN cell u USING (trajectory_id, call_no)),
  sc AS (SELECT condition_id, test_fold, task_id, max(greatest(lower - remaining, remaining - upper, 0)) AS score FROM hit WHERE role = 'calibration' GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY condition_id, test_fold ORDER BY score) AS r, count(*) OVER (PARTITION BY condition_id, test_fold) AS n FROM sc),
  ex AS (SELECT condition_id, test_fold, score AS e FROM rk WHERE r = least(n, greatest(1, ceil((n + 1) * 0.9)))), b AS (SELECT a.condition_id, weight, remaining AS truth, greatest(0, lower - e) AS lower, point, greatest(point, upper + e) AS upper FROM hit a JOIN ex USING (condition_id, test_fold) WHERE role = 'test')
  SELECT condition_id, count(*) AS n_points, round(sum(weight * abs(point - truth)) / sum(weight), 3) AS mae, round(sum(weight * (truth BETWEEN lower AND upper)::INT) / sum(weight), 3) AS coverage, round(sum(weight * (upper - lower)) / sum(weight), 3) AS mean_width FROM b GROUP BY ALL""")
def crossfit_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted starts carried through the updates, calibrated and scored, by condition."""
    rows = kept(base.all_rows(spark, sf_dir, history=False).where("target = 'task_provider_accounted_remaining'").select(*_CARRIED), "rows")
    weights = points.run_weights(points.eligible(rows, "task_update"))
    out = crossfit.lifecycle(rows, weights, _seeds(rows, spark, sf_dir))
    inside = F.col("truth").between(F.col("lower"), F.col("upper")).cast("double")
    return rounded(out.groupBy("condition_id").agg(F.count("*").alias("n_points"), metrics.weighted_mean(F.abs(F.col("point") - F.col("truth"))).alias("mae"), metrics.weighted_mean(inside).alias("coverage"), metrics.weighted_mean(F.col("upper") - F.col("lower")).alias("mean_width")), 3)


@query("WITH" + SCORED + """, c AS (SELECT condition_id, 'empirical' AS candidate_id, sum(weight * abs(point - truth)) / sum(weight) AS mae FROM scored GROUP BY ALL UNION ALL SELECT condition_id, 'flat', sum(weight * abs(100000 - truth)) / sum(weight) FROM scored GROUP BY ALL)
  SELECT condition_id, arg_min(candidate_id, mae) AS best_candidate, round(min(mae), 4) AS best_mae FROM c GROUP BY ALL""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.scored(spark, sf_dir)
    both = s.withColumn("candidate_id", F.lit("empirical")).unionByName(s.withColumn("point", F.lit(100_000.0)).withColumn("candidate_id", F.lit("flat")))
    results = both.groupBy("condition_id", "candidate_id").agg(metrics.weighted_mean(F.abs(F.col("point") - F.col("truth"))).alias("mae"))
    return rounded(compare.best_candidate(results, ["condition_id"]), 4)
