"""The weighted metric suite over scored forecasts (task_id, trajectory_id, point_id, lower, point, upper, truth, weight).

Three quantile rules live side by side and are never swapped: the weighted lower step, type-7 linear
(``percentile``) and nearest rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.sources.tables import kept


def weighted_mean(x: Column, w: str = "weight") -> Column:
    return F.sum(x * F.col(w)) / F.sum(w)


def interval_score(alpha: float) -> Column:
    below, above = F.col("lower") - F.col("truth"), F.col("truth") - F.col("upper")
    return F.col("upper") - F.col("lower") + F.when(below > 0, 2 / alpha * below).when(above > 0, 2 / alpha * above).otherwise(0.0)


#: Share of a group's weight that sums of doubles in another order may be off by: a running weight that misses by less has reached.
ROUNDING = 1e-12


def reached(summed: DataFrame, wanted: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """For each group of summed (by, _v, _w; distinct _v) the first value at which the running weight reaches
    ``wanted``, columns over the group's whole weight ``_t``; the largest value where none does.

    Values are dealt to ranges in their order and written once: sums over ranges tell which range holds each value, and
    only those ranges are sorted, so that no task sorts a whole group. The written place is what all steps agree on;
    approximate cuts may differ each time that they are computed.
    """
    by, names = list(by), list(wanted)
    dealt = kept(summed.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    group = W.partitionBy(*(by or (F.lit(0),)))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_w").alias("_s"), F.max("_v").alias("_last"))
    sums = sums.withColumns({"_t": F.sum("_s").over(group), "_top": F.max("_last").over(group), "_upto": F.sum("_s").over(group.orderBy("_range"))}).withColumn("_before", F.col("_upto") - F.col("_s"))
    sums = sums.withColumns({f"_g{i}": x - ROUNDING * F.col("_t") for i, x in enumerate(wanted.values())})
    hit = [((F.col("_before") < F.col(f"_g{i}")) & (F.col("_upto") >= F.col(f"_g{i}"))).alias(f"_h{i}") for i in range(len(names))]
    hits = sums.select(*by, "_range", "_before", "_last", *(f"_g{i}" for i in range(len(names))), *hit).where(" OR ".join(f"_h{i}" for i in range(len(names))))
    inside = W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = dealt.join(hits, [*by, "_range"]).withColumn("_c", F.col("_before") + F.sum("_w").over(inside))
    first = [F.min(F.when(F.col(f"_h{i}") & ((F.col("_c") >= F.col(f"_g{i}")) | (F.col("_v") == F.col("_last"))), F.col("_v"))).alias(n) for i, n in enumerate(names)]
    found, tops = at.groupBy(*by).agg(*first), sums.groupBy(*by).agg(F.max("_top").alias("_top"))
    both = tops.join(found, by, "left") if by else tops.crossJoin(found)
    return both.select(*by, *(F.coalesce(n, "_top").alias(n) for n in names))


def step_quantile(df: DataFrame, value: Column, qs: dict[str, float], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Weighted lower-step quantiles: the first value at which the running weight reaches q of the whole."""
    weight = F.col("weight") if weight is None else weight
    summed = df.select(*by, value.alias("_v"), weight.alias("_w")).groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))
    return reached(summed, {name: q * F.col("_t") for name, q in qs.items()}, by)


def suite(scored: DataFrame, by: Sequence[str] = (), alpha: float = 0.10) -> DataFrame:
    """All sum-type metrics of each group in one aggregation, then Pearson, quantiles and task coverage joined on."""
    error, bias = F.abs(F.col("point") - F.col("truth")), F.col("point") - F.col("truth")
    covered = (F.col("lower") <= F.col("truth")) & (F.col("truth") <= F.col("upper"))
    num = lambda c: c.cast("double")
    width = F.col("upper") - F.col("lower")
    truth = F.col("truth").cast("double")
    infinite = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.when(infinite(F.col("weight").cast("double")) | (F.col("weight") <= 0) | infinite(truth), F.raise_error(F.lit("weights must be positive and truths finite")).cast("double"))
    base = scored.withColumn("weight", F.coalesce(bad, F.col("weight"))).withColumn("covered", covered)
    absolute = F.sum(F.col("weight") * F.abs("truth"))
    sums = base.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.count_distinct("task_id").alias("n_tasks"), F.count_distinct("trajectory_id").alias("n_trajectories"), F.sum("weight").alias("weight_sum"),
        weighted_mean(error).alias("mae"), F.when(absolute > 0, F.sum(F.col("weight") * error) / absolute).otherwise(0.0).alias("wape"), weighted_mean(bias).alias("mean_bias"),
        weighted_mean(num(F.col("point") < F.col("truth"))).alias("underestimation_rate"), weighted_mean(num(covered)).alias("coverage"),
        weighted_mean(num(F.col("upper") < F.col("truth"))).alias("interval_below_truth_rate"), weighted_mean(num(F.col("lower") > F.col("truth"))).alias("interval_above_truth_rate"),
        weighted_mean(F.greatest(F.lit(0.0), F.col("upper") - F.col("truth"))).alias("mean_extra_reserved_tokens"), weighted_mean(interval_score(alpha)).alias("interval_score"),
        weighted_mean(width / F.greatest(F.abs("truth"), F.lit(1.0))).alias("normalized_interval_width"),
    )
    return _with_rest(base, sums, list(by), error, width)


def _with_rest(base: DataFrame, sums: DataFrame, by: list[str], error: Column, width: Column) -> DataFrame:
    errors = step_quantile(base, error, {"median_ae": 0.5, "p90_ae": 0.9}, by)
    widths = step_quantile(base, width, {"median_interval_width": 0.5}, by)
    tasks = base.groupBy(*by, "task_id").agg(F.bool_and("covered").alias("all")).groupBy(*by).agg(F.avg(F.col("all").cast("double")).alias("task_simultaneous_coverage"))
    out = sums
    for part in (errors, widths, tasks, pearson(base, by)):
        out = out.join(part, by) if by else out.crossJoin(part)  # without groups each part is one row
    return out.withColumn("target_exceeds_upper_rate", F.col("interval_below_truth_rate"))


def pearson(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted correlation of point and truth, 0 where one of them doesn't vary; two passes, so no cancellation."""
    means = scored.groupBy(*by).agg(weighted_mean(F.col("truth")).alias("_mt"), weighted_mean(F.col("point")).alias("_mp"))
    at = scored.join(means, list(by)) if by else scored.crossJoin(means)
    dt, dp, w = F.col("truth") - F.col("_mt"), F.col("point") - F.col("_mp"), F.col("weight")
    out = at.groupBy(*by).agg(F.sum(w * dt * dp).alias("_c"), F.sum(w * dt * dt).alias("_t"), F.sum(w * dp * dp).alias("_p"))
    return out.select(*by, F.when((F.col("_t") > 0) & (F.col("_p") > 0), F.col("_c") / F.sqrt(F.col("_t") * F.col("_p"))).otherwise(0.0).alias("pearson"))


def per_task(scored: DataFrame, by: Sequence[str] = (), alpha: float = 0.10) -> DataFrame:
    error = F.abs(F.col("point") - F.col("truth"))
    covered = ((F.col("lower") <= F.col("truth")) & (F.col("truth") <= F.col("upper"))).cast("double")
    return scored.groupBy(*by, "task_id").agg(F.count("*").alias("n_points"), F.sum("weight").alias("weight_sum"), weighted_mean(error).alias("mae"), weighted_mean(covered).alias("coverage"), weighted_mean(interval_score(alpha)).alias("interval_score"))


def budgets(scored: DataFrame, thresholds: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Decision metrics of each remaining-token budget."""
    at = scored.withColumn("budget_tokens", F.explode(F.array(*map(F.lit, thresholds))))
    actual, said = F.col("truth") > F.col("budget_tokens"), F.col("point") > F.col("budget_tokens")
    over, within = F.col("lower") > F.col("budget_tokens"), F.col("upper") <= F.col("budget_tokens")
    part = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0))
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    every = F.sum("weight")
    return at.groupBy(*by, "budget_tokens").agg(
        F.count("*").alias("n_points"), every.alias("weight_sum"), (part(actual) / every).alias("actual_overrun_rate"), (part(said) / every).alias("predicted_overrun_rate"),
        (part(actual == said) / every).alias("accuracy"), share(part(actual & said), part(said)).alias("precision"), share(part(actual & said), part(actual)).alias("recall"),
        share(part(actual & ~said), part(actual)).alias("false_negative_rate"), share(part(~actual & said), part(~actual)).alias("false_positive_rate"),
        (part(over) / every).alias("interval_definite_overrun_rate"), (part(within) / every).alias("interval_definite_within_rate"), (part(~over & ~within) / every).alias("interval_uncertain_rate"),
        (F.sum(F.when(actual & ~said, F.col("weight") * (F.col("truth") - F.col("budget_tokens"))).otherwise(0.0)) / every).alias("mean_missed_overrun_tokens"),
    )


def progress(scored: DataFrame, shares: Sequence[tuple[str, float]] = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)), by: Sequence[str] = ()) -> DataFrame:
    """The point at the ceil(f * n)-th boundary of each run, weight 1 / runs of the task."""
    w = W.partitionBy(*by, "trajectory_id")
    at = scored.withColumn("_i", F.row_number().over(w.orderBy("cutoff_event_seq", "point_id"))).withColumn("_n", F.count("*").over(w))
    at = at.withColumn("s", F.explode(F.array(*(F.struct(F.lit(n).alias("checkpoint"), F.lit(f).alias("share")) for n, f in shares)))).where(F.col("_i") == F.greatest(F.lit(1), F.ceil(F.col("s.share") * F.col("_n"))))
    runs = scored.select(*by, "task_id", "trajectory_id").distinct().groupBy(*by, "task_id").agg(F.count("*").alias("_runs"))
    return at.join(runs, [*by, "task_id"]).withColumn("checkpoint", F.col("s.checkpoint")).withColumn("weight", 1 / F.col("_runs")).drop("_i", "_n", "s", "_runs")


def run_dispersion(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the runs of a task (total a run): population variance, type-7 IQR and range, over tasks with two runs or more."""
    task = totals.groupBy(*by, "task_id").agg(F.count("*").alias("runs"), F.var_pop("total").alias("variance"), (F.percentile("total", 0.75) - F.percentile("total", 0.25)).alias("iqr"), (F.max("total") - F.min("total")).alias("range")).where("runs >= 2")
    stats = [f(c).alias(f"{c}_{n}") for c in ("variance", "iqr", "range") for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)), ("max", F.max))]
    return task.groupBy(*by).agg(F.count("*").alias("n_tasks"), *stats)


def across_seeds(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, least, most and population deviation of each metric over seeds, one row a metric."""
    long = results.unpivot([*by, "seed"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_pop("value").alias("deviation"))


def pinball(scored: DataFrame, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Weighted pinball loss of forecast columns at their quantiles."""
    def loss(c: str, q: float) -> Column:
        e = F.col("truth") - F.col(c)
        return weighted_mean(F.greatest(q * e, (q - 1) * e)).alias(f"pinball_{c}")

    return scored.groupBy(*by).agg(*(loss(c, q) for c, q in quantiles.items()))


def raw_suite(scored: DataFrame, by: Sequence[str] = (), alpha: float = 0.10) -> DataFrame:
    """The interval metrics of the forecasts before calibration (raw_lower, raw_point, raw_upper), made valid first, as
    raw_*, and how often the raw triple crosses. All rows have it or none, else the query fails; with none all are null."""
    raw = ("raw_lower", "raw_point", "raw_upper")
    has = F.coalesce(*(F.col(c).isNotNull() for c in raw[:1]))
    n = scored.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(has).alias("_k"))
    n = n.withColumn("_k", F.when((F.col("_k") > 0) & (F.col("_k") < F.col("_n")), F.raise_error(F.lit("raw forecasts must be there for all rows or for none")).cast("long")).otherwise(F.col("_k")))
    at = scored.where(has).withColumn("crossing", ((F.col("raw_lower") > F.col("raw_point")) | (F.col("raw_point") > F.col("raw_upper"))).cast("double"))
    point = F.greatest(F.lit(0.0), F.col("raw_point"))
    at = at.withColumns({"point": point, "lower": F.least(F.greatest(F.lit(0.0), F.col("raw_lower")), point), "upper": F.greatest(F.col("raw_upper"), point)})
    full = suite(at, by, alpha)
    names = ("coverage", "interval_below_truth_rate", "interval_above_truth_rate", "target_exceeds_upper_rate", "mean_extra_reserved_tokens", "task_simultaneous_coverage", "interval_score", "median_interval_width", "normalized_interval_width")
    full = full.select(*by, *(F.col(c).alias(f"raw_{c}") for c in names))
    crossing = at.groupBy(*by).agg(weighted_mean(F.col("crossing")).alias("quantile_crossing_rate"))
    out = n.join(full, list(by), "left").join(crossing, list(by), "left") if by else n.crossJoin(full).crossJoin(crossing)
    return out.where("_k >= 0").drop("_n", "_k")


def latency(predictions: DataFrame, milliseconds: str, by: Sequence[str] = (), overhead: Sequence[str] = ()) -> DataFrame:
    """The true median and the step 95th percentile of prediction times, and the tokens that predicting itself took."""
    own = predictions.where(F.col(milliseconds).isNotNull())
    p95 = step_quantile(own, F.col(milliseconds), {"latency_p95_ms": 0.95}, by, F.lit(1.0))
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in overhead), F.lit(0)) if overhead else F.lit(0)
    sums = own.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(milliseconds, 0.5).alias("latency_p50_ms"), F.sum(tokens).cast("long").alias("prediction_overhead_tokens"))
    return sums.join(p95, list(by)) if by else sums.crossJoin(p95)


def termination_strata(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs by how their updates end: steps (task_id, trajectory_id, label_status, label_reason), one row an update of a
    run; a run without updates has one row whose status is null.

    A run with a censored update is in the stratum of its censoring reasons, else one with an observed update is
    ``observed_termination``, else its reasons for missing labels name the stratum. Nothing censored is scored.
    """
    reasons = lambda status: F.array_join(F.array_sort(F.collect_set(F.when(F.col("label_status") == status, F.coalesce(F.nullif("label_reason", F.lit("")), F.lit("unspecified"))))), "+")
    runs = steps.groupBy(*by, "task_id", "trajectory_id").agg(reasons("censored").alias("_c"), reasons("missing").alias("_m"), F.count_if(F.col("label_status") == "observed").alias("_o"), F.count("label_status").alias("_n"))
    stratum = F.when(F.col("_c") != "", F.concat(F.lit("censored:"), "_c")).when(F.col("_o") > 0, "observed_termination").otherwise(F.concat(F.lit("unscored_missing:"), F.coalesce(F.nullif("_m", F.lit("")), F.lit("unspecified"))))
    return runs.groupBy(*by, stratum.alias("stratum")).agg(F.count("*").alias("n_sequences"), F.count_distinct("task_id").alias("n_tasks"), F.sum("_n").alias("n_update_boundaries"), F.sum("_o").alias("n_scored"), F.sum(F.col("_n") - F.col("_o")).alias("n_context_only"))
