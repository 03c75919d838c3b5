"""Frozen ensembles: parameters of all members as a published table, scored on held-out tasks without fitting again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import forecast, splits
from runledger.sources.external import publish, verified


def members(rows: DataFrame, folds: DataFrame, k: int, cell: Sequence[str] = ("condition_id",), alpha: float = 0.10, fit: Callable[[DataFrame, Sequence[str], float, DataFrame], DataFrame] = forecast.fit_empirical) -> DataFrame:
    """Parameters and widening of each (seed, test fold), all fitted at once: (cell ..., seed, test_fold, lower, point, upper, expansion).

    rows as for forecast.cross_validated, of development tasks; folds (seed, task_id, fold). A cell in which a member has
    no training or calibration rows lacks that member, which scoring reports.
    """
    by = [*cell, "seed", "test_fold"]
    seen = splits.roles(rows.join(folds.select("seed", "task_id", "fold"), "task_id"), k).withColumn("truth", F.col("label_value").cast("double"))
    params = fit(seen.where("role = 'train'"), by, alpha, seen.where("role = 'validation'"))
    return params.join(forecast.fit_conformal(seen.where("role = 'calibration'").join(params, by), by, alpha).select(*by, "expansion"), by)


def freeze(fitted: DataFrame, tasks: DataFrame, path: str) -> None:
    """Publish the members and the tasks that they were fitted on, each with its fingerprint; an existing path is an error."""
    publish(fitted, f"{path}/members")
    publish(tasks.select("task_id").distinct(), f"{path}/tasks")


def score(spark: SparkSession, rows: DataFrame, path: str, n_members: int, keep: Sequence[str], cell: Sequence[str] = ("condition_id",)) -> DataFrame:
    """The mean of the frozen members' calibrated forecasts for each row (point_id, task_id, cell ..., keep ...).

    Tables that changed since they were published are refused (ValueError). A row of a task that members were fitted on,
    and one whose cell lacks a member, fail the query. No rows give none.
    """
    own, known = verified(spark, f"{path}/members"), verified(spark, f"{path}/tasks").withColumn("_known", F.lit(True))
    fresh = rows.select("point_id", "task_id", *dict.fromkeys([*cell, *keep])).join(known, "task_id", "left")
    leaked = F.raise_error(F.concat(F.lit("fitted on this task: "), "task_id")).cast("string")
    fresh = fresh.withColumn("point_id", F.when(F.col("_known"), leaked).otherwise(F.col("point_id"))).drop("_known")
    said = fresh.join(own, list(cell), "left").withColumn("member", F.when(F.col("point").isNotNull(), F.concat_ws("-", "seed", "test_fold")))
    said = said.withColumn("lower", F.greatest(F.lit(0.0), F.col("lower") - F.col("expansion"))).withColumn("upper", F.greatest(F.col("point"), F.col("upper") + F.col("expansion")))
    return forecast.ensemble(said, n_members, keep)
