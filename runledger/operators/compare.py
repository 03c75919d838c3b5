"""Paired comparisons clustered by task, with reproducible hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.operators.metrics import interval_score
from runledger.sources.tables import kept


def draw(seed: str, n):
    """Draw i of replicate b out of n: 32 bits of md5(seed|b|i) modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long"), n)


def _numbered(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """tasks (one row a task_id and group) with their place in order of task_id, from 0, and the group's size ``n``.

    Places are counted in ranges of task_id, written once, so that no task numbers a whole group.
    """
    by = list(by)
    dealt = kept(tasks.repartitionByRange("task_id").withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_k"))
    group = W.partitionBy(*(by or (F.lit(0),)))
    sizes = sizes.withColumn("_before", F.sum("_k").over(group.orderBy("_range")) - F.col("_k")).withColumn("n", F.sum("_k").over(group)).drop("_k")
    place = F.row_number().over(W.partitionBy(*by, "_range").orderBy("task_id")) - 1 + F.col("_before")
    return dealt.join(sizes, [*by, "_range"]).withColumn("place", place).drop("_range", "_before")


def paired_bootstrap(paired: DataFrame, replicates: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Bootstrap of the weighted MAE difference (candidate - reference), resampling tasks.

    paired (task_id, weight, candidate, reference: absolute errors of both). Draws are dealt out by
    (replicate, draw), joined to the numbered task sums and summed by replicate, so no group holds more
    than one replicate's tasks. Returns means, the type-7 95 % interval and the share of replicates won.
    """
    tasks = paired.groupBy(*by, "task_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("candidate")).alias("c"), F.sum(F.col("weight") * F.col("reference")).alias("r"))
    sums = _resampled(tasks, ("w", "c", "r"), replicates, seed, by)
    sums = sums.withColumn("delta", (F.col("c") - F.col("r")) / F.col("w"))
    boot = sums.groupBy(*by).agg(F.percentile("delta", 0.025).alias("ci_low"), F.percentile("delta", 0.975).alias("ci_high"), F.avg((F.col("delta") < 0).cast("double")).alias("win_probability"), F.count("*").alias("replicates"))
    full = tasks.groupBy(*by).agg((F.sum("c") / F.sum("w")).alias("candidate_mae"), (F.sum("r") / F.sum("w")).alias("reference_mae"), F.count("*").alias("n_tasks"))
    out = full.join(boot, list(by)) if by else full.crossJoin(boot)
    return out.withColumn("delta", F.col("candidate_mae") - F.col("reference_mae"))


def same_cohort(candidate: DataFrame, reference: DataFrame, key: str = "point_id") -> DataFrame:
    """What one side has and the other lacks, as (key, side): empty for equal cohorts."""
    one, two = candidate.select(key), reference.select(key)
    return one.exceptAll(two).withColumn("side", F.lit("candidate")).unionByName(two.exceptAll(one).withColumn("side", F.lit("reference")))


def paired_errors(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Both sides' absolute errors point by point; a point, truth or weight that one side lacks fails the query."""
    c = candidate.select("point_id", "task_id", F.col("weight"), F.col("truth"), F.abs(F.col("point") - F.col("truth")).alias("candidate"))
    r = reference.select("point_id", F.col("weight").alias("_w"), F.col("truth").alias("_t"), F.abs(F.col("point") - F.col("truth")).alias("reference"))
    both = c.join(r, "point_id", "full_outer")
    bad = ~(F.col("weight").eqNullSafe(F.col("_w")) & F.col("truth").eqNullSafe(F.col("_t")))
    return both.withColumn("candidate", F.when(bad, F.raise_error(F.concat(F.lit("cohorts differ at "), F.col("point_id"))).cast("double")).otherwise(F.col("candidate"))).select("task_id", "weight", "candidate", "reference")


def in_all_conditions(rows: DataFrame) -> DataFrame:
    """The rows of tasks that every condition has (relational division)."""
    n = rows.select("condition_id").distinct().agg(F.count("*").alias("n"))
    tasks = rows.select("task_id", "condition_id").distinct().groupBy("task_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("task_id")
    return rows.join(tasks, "task_id", "left_semi")


def best_candidate(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The candidate with the least mean MAE over seeds, ties by id."""
    mean = results.groupBy(*by, "candidate_id").agg(F.avg("mae").alias("mae"))
    return mean.groupBy(*by).agg(F.min(F.struct("mae", "candidate_id")).alias("b")).select(*by, F.col("b.candidate_id").alias("best_candidate"), F.col("b.mae").alias("best_mae"))


def may_replace(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether the upper end of the difference's interval is below 0 under every seed."""
    return intervals.groupBy(*by).agg(F.bool_and(F.col("ci_high") < 0).alias("may_replace"), F.count("*").alias("n_seeds"))


def matched_coverage(results: DataFrame, reference: str, candidate: str, by: Sequence[str] = (), tolerance: float = 0.02) -> DataFrame:
    """The winner by interval score of two calibrations (calibrator_id, coverage, interval_score) whose coverages are within tolerance; null where they aren't."""
    side = lambda who, n: results.where(F.col("calibrator_id") == who).select(*by, F.col("coverage").alias(f"{n}_coverage"), F.col("interval_score").alias(f"{n}_score"))
    one, two = side(reference, "reference"), side(candidate, "candidate")
    both = one.join(two, list(by)) if by else one.crossJoin(two)
    matched = F.abs(F.col("reference_coverage") - F.col("candidate_coverage")) <= tolerance
    winner = F.when(F.col("candidate_score") < F.col("reference_score"), candidate).when(F.col("candidate_score") > F.col("reference_score"), reference).otherwise("tie")
    return both.withColumn("matched", matched).withColumn("winner", F.when(F.col("matched"), winner))


def raw_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Points whose forecasts before calibration differ between two calibrations: empty where only the calibration differs."""
    raw = ["raw_lower", "raw_point", "raw_upper"]
    other = two.select("point_id", *(F.col(c).alias(f"other_{c}") for c in raw), F.lit(True).alias("_two"))
    both = one.select("point_id", *raw, F.lit(True).alias("_one")).join(other, "point_id", "full_outer")
    same = F.col("_one").isNotNull() & F.col("_two").isNotNull()
    for c in raw:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return both.where(~same).select("point_id")


def set_differences(planned: DataFrame, actual: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, problem): planned and missing, or there and not planned."""
    p, a = planned.select(key), actual.select(key)
    return p.subtract(a).withColumn("problem", F.lit("missing")).unionByName(a.subtract(p).withColumn("problem", F.lit("extra")))


def in_several_roles(assigned: DataFrame, by: Sequence[str] = (), key: str = "task_id") -> DataFrame:
    """Keys that more than one role claims."""
    return assigned.groupBy(*by, key).agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def not_exactly_once(expected: DataFrame, predicted: DataFrame, key: str = "point_id") -> DataFrame:
    """Keys predicted more or less often than once, with how often."""
    n = predicted.groupBy(key).agg(F.count("*").alias("_n"))
    return expected.select(key).distinct().withColumn("_e", F.lit(1)).join(n, key, "full_outer").select(key, F.coalesce("_n", F.lit(0)).alias("times"), F.col("_e").isNotNull().alias("expected")).where("times <> 1 OR NOT expected")


def closes_over_tasks(suite: DataFrame, tasks: DataFrame, by: Sequence[str] = (), tolerance: float = 1e-10) -> DataFrame:
    """Whether the MAE of the whole is the weighted mean of the tasks' MAEs."""
    mean = tasks.groupBy(*by).agg((F.sum(F.col("weight_sum") * F.col("mae")) / F.sum("weight_sum")).alias("_mae"))
    both = suite.join(mean, list(by)) if by else suite.crossJoin(mean)
    return both.select(*by, (F.abs(F.col("mae") - F.col("_mae")) <= tolerance * F.greatest(F.lit(1.0), F.abs("mae"))).alias("closes"))


def _resampled(tasks: DataFrame, sums: Sequence[str], replicates: int, seed: str, by: Sequence[str]) -> DataFrame:
    """The sums of resampled tasks, one row a replicate. Every task's place doubles as a draw's number i; the numbered
    tasks grow with the input, so they meet the draws by a sort merge and are never broadcast."""
    numbered = _numbered(tasks, by)
    draws = numbered.select(*by, F.col("place").alias("i"), "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).withColumn("place", draw(seed, F.col("n"))).select(*by, "b", "place")
    return draws.join(numbered.drop("task_id", "n").hint("merge"), [*by, "place"]).groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in sums))


def across_conditions_bootstrap(errors: DataFrame, replicates: int, seed: str) -> DataFrame:
    """Tasks that every condition has, errors (condition_id, task_id, candidate, reference: MAE of the task): the mean
    difference over conditions first and tasks then, with its nearest-rank 95 % interval over resampled tasks."""
    own = in_all_conditions(errors)
    tasks = own.groupBy("task_id").agg(F.avg(F.col("candidate") - F.col("reference")).alias("delta"))
    enough = tasks.agg(F.count("*").alias("n_tasks"), F.avg("delta").alias("mean_mae_delta"))
    enough = enough.withColumn("n_tasks", F.when(F.col("n_tasks") < 2, F.raise_error(F.lit("fewer than two matched tasks")).cast("long")).otherwise(F.col("n_tasks")))
    boot = _resampled(tasks.withColumn("w", F.lit(1)), ["w", "delta"], replicates, seed, ()).withColumn("delta", F.col("delta") / F.col("w"))
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY delta)")
    return enough.crossJoin(boot.agg(rank(0.025).alias("ci_low"), rank(0.975).alias("ci_high"), F.avg((F.col("delta") < 0).cast("double")).alias("win_probability")))


def interval_bootstrap(paired: DataFrame, replicates: int, seed: str, alpha: float = 0.10) -> DataFrame:
    """Two differences over the same resampled tasks: the weighted interval score and the share of tasks whose points are
    all covered. paired (task_id, truth, weight, lower, upper, other_lower, other_upper): candidate and reference."""
    other = paired.select("task_id", "truth", "weight", F.col("other_lower").alias("lower"), F.col("other_upper").alias("upper"))
    one = lambda df, name: df.groupBy("task_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * interval_score(alpha)).alias(f"{name}_s"), F.min(F.col("truth").between(F.col("lower"), F.col("upper")).cast("double")).alias(f"{name}_c"))
    tasks = one(paired, "a").join(one(other, "b").drop("w"), "task_id").withColumn("k", F.lit(1.0))
    both = (((F.col("a_s") - F.col("b_s")) / F.col("w")).alias("interval_score_delta"), ((F.col("a_c") - F.col("b_c")) / F.col("k")).alias("task_coverage_delta"))
    names, sums = ("interval_score_delta", "task_coverage_delta"), ["w", "k", "a_s", "b_s", "a_c", "b_c"]
    boot = _resampled(tasks, sums, replicates, seed, ()).select(*both)
    bounds = boot.agg(*(F.percentile(c, q).alias(f"{c}_{n}") for c in names for n, q in (("low", 0.025), ("high", 0.975))))
    return tasks.agg(F.count("*").alias("n_tasks"), *(F.sum(c).alias(c) for c in sums)).select("n_tasks", *both).crossJoin(bounds)


def key_mismatches(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side has and the other lacks, or has more often: (keys, one, two), empty for equal sides."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(one, "one").join(n(two, "two"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", F.lit(0)).alias("two")).where("one <> two")


def union_sources(*sources: DataFrame) -> DataFrame:
    """One dataset of several sources' events; a run that two sources have fails the query."""
    out = None
    for i, s in enumerate(sources):
        own = s.withColumn("source", F.lit(i))
        out = own if out is None else out.unionByName(own)
    several = out.groupBy("trajectory_id").agg(F.count_distinct("source").alias("_n"))
    return out.join(several, "trajectory_id").withColumn("trajectory_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several sources have "), "trajectory_id")).cast("string")).otherwise(F.col("trajectory_id"))).drop("_n")
