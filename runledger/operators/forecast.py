"""Forecasters as parameter tables: fit = a DataFrame of parameters a group, predict = a join; calibration likewise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.metrics import reached, step_quantile
from runledger.sources.tables import kept


def fit_empirical(train: DataFrame, by: Sequence[str], alpha: float = 0.10, validation: DataFrame | None = None) -> DataFrame:
    """Weighted step quantiles alpha/2, 1/2 and 1 - alpha/2 of the label in each group."""
    return step_quantile(train, F.col("label_value").cast("double"), {"lower": alpha / 2, "point": 0.5, "upper": 1 - alpha / 2}, by)


def fit_line(train: DataFrame, x: str, by: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """Weighted least squares on one feature and the step quantiles of its residuals: (slope, intercept, low, high)."""
    own = train.where(F.col(x).isNotNull())
    mean = lambda c: F.sum(F.col("weight") * c) / F.sum("weight")
    means = own.groupBy(*by).agg(mean(F.col(x)).alias("_mx"), mean(F.col("label_value")).alias("_my"))
    at = own.join(means, list(by))
    dx, dy = F.col(x) - F.col("_mx"), F.col("label_value") - F.col("_my")
    line = at.groupBy(*by).agg(F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(F.col("weight") * dx * dy).alias("_xy"), F.sum(F.col("weight") * dx * dx).alias("_xx"))
    line = line.withColumn("slope", F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).select(*by, "slope", "intercept")
    rest = own.join(line, list(by))
    residual = F.col("label_value") - (F.col("intercept") + F.col("slope") * F.col(x))
    bands = step_quantile(rest, residual, {"low": alpha / 2, "high": 1 - alpha / 2}, by)
    return line.join(bands, list(by))


def predict_line(rows: DataFrame, params: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    raw = F.col("intercept") + F.col("slope") * F.col(x)
    out = rows.join(params, list(by)).withColumn("point", F.greatest(F.lit(0.0), raw))
    return out.withColumn("lower", F.greatest(F.lit(0.0), F.least(raw + F.col("low"), F.col("point")))).withColumn("upper", F.greatest(raw + F.col("high"), F.col("point"))).drop("slope", "intercept", "low", "high")


def fit_residual_bands(train: DataFrame, estimate: str, by: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """Residual quantiles around an estimate that comes from outside."""
    return step_quantile(train.where(F.col(estimate).isNotNull()), F.col("label_value") - F.col(estimate), {"low": alpha / 2, "high": 1 - alpha / 2}, by)


def predict_bands(rows: DataFrame, params: DataFrame, estimate: str, by: Sequence[str]) -> DataFrame:
    point = F.greatest(F.lit(0.0), F.col(estimate).cast("double"))
    out = rows.join(params, list(by)).withColumn("point", point)
    return out.withColumn("lower", F.least(F.greatest(F.lit(0.0), F.col(estimate) + F.col("low")), "point")).withColumn("upper", F.greatest(F.col(estimate) + F.col("high"), F.col("point"))).drop("low", "high")


def fit_conformal(calibration: DataFrame, by: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """Split conformal with one score a task, its worst miss: the ceil((n + 1)(1 - alpha))-th smallest (expansion) of each group."""
    miss = F.greatest(F.col("lower") - F.col("truth"), F.col("truth") - F.col("upper"), F.lit(0.0))
    tasks = calibration.groupBy(*by, "task_id").agg(F.max(miss).alias("score"))
    rank = F.least(F.col("_t"), F.greatest(F.lit(1), F.ceil((F.col("_t") + 1) * F.lit(1 - alpha))))
    equal = tasks.groupBy(*by, F.col("score").alias("_v")).agg(F.count("*").alias("_w"))
    return reached(equal, {"expansion": rank}, by).join(tasks.groupBy(*by).agg(F.count("*").alias("calibration_tasks")), list(by)) if by else reached(equal, {"expansion": rank}).crossJoin(tasks.agg(F.count("*").alias("calibration_tasks"))).where("calibration_tasks > 0")


def calibrated(forecasts: DataFrame, expansion: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intervals widened on both sides; the forecast before stays in raw_*. Expansions have one row a group and are
    broadcast, so that forecasts are not dealt to tasks by their few groups."""
    out = forecasts.join(F.broadcast(expansion.select(*by, "expansion")), list(by)) if by else forecasts.crossJoin(expansion.select("expansion"))
    out = out.withColumns({f"raw_{c}": F.col(c) for c in ("lower", "point", "upper")})
    return out.withColumn("lower", F.greatest(F.lit(0.0), F.col("raw_lower") - F.col("expansion"))).withColumn("upper", F.greatest(F.col("point"), F.col("raw_upper") + F.col("expansion"))).drop("expansion")


def cross_validated(rows: DataFrame, folds: DataFrame, k: int, cell: Sequence[str] = ("condition_id",), alpha: float = 0.10, fit: Callable[[DataFrame, Sequence[str], float, DataFrame], DataFrame] = fit_empirical) -> DataFrame:
    """All folds at once: fit on train, calibrate on the next fold, forecasts of every row by the model that hasn't seen its task.

    rows (task_id, label_value, weight, cell ...); folds (task_id, fold). ``fit`` is the hook for own
    forecasters: (train, by, alpha, validation) -> parameters lower, point, upper a group. The validation fold is
    there for a forecaster that stops early or picks settings by it; the baselines leave it alone.

    Rows meet their fold once and are written; the parameters, one row a cell and test fold, are fitted once and broadcast.
    """
    from runledger.operators.splits import roles

    by = [*cell, "test_fold"]
    # every row once for each test fold; roles are arithmetic on the fold, so only (task_id, fold) is joined
    dealt = kept(rows.join(folds.select("task_id", "fold"), "task_id"), "dealt")
    seen = roles(dealt, k).withColumn("truth", F.col("label_value").cast("double"))
    params = F.broadcast(kept(fit(seen.where("role = 'train'"), by, alpha, seen.where("role = 'validation'")), "params"))
    expansion = fit_conformal(seen.where("role = 'calibration'").join(params, by), by, alpha)
    return calibrated(seen.where("role = 'test'").join(params, by), expansion, by)


def ensemble(members: DataFrame, n_members: int, keep: Sequence[str]) -> DataFrame:
    """The mean forecast of each point over members; a point that a member lacks, or says twice, fails the query."""
    mean = members.groupBy("point_id", *keep).agg(F.count("*").alias("_n"), F.count_distinct("member").alias("_m"), *(F.avg(c).alias(c) for c in ("lower", "point", "upper")))
    bad = F.when((F.col("_n") != n_members) | (F.col("_m") != n_members), F.raise_error(F.concat(F.lit("members differ at "), F.col("point_id"))).cast("double"))
    return mean.withColumn("point", F.coalesce(bad, F.col("point"))).drop("_n", "_m")


def invalid_forecasts(forecasts: DataFrame) -> DataFrame:
    """Forecasts that break a rule, with ``problem``: not 0 <= lower <= point <= upper, something infinite or null, or
    only a part of the triple before calibration."""
    triple = [F.col(c).cast("double") for c in ("lower", "point", "upper")]
    odd = F.lit(False)
    for c in triple:
        odd = odd | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    raw = [F.col(c) for c in ("raw_lower", "raw_point", "raw_upper")]
    some = sum((c.isNotNull().cast("int") for c in raw), F.lit(0))
    disorder = (F.col("lower") < 0) | (F.col("lower") > F.col("point")) | (F.col("point") > F.col("upper"))
    problem = F.when(odd, "not_finite").when(disorder, "out_of_order").when(some.isin(1, 2), "raw_in_part")
    return forecasts.withColumn("problem", problem).where("problem IS NOT NULL")


def fit_encoding(train: DataFrame, numbers: Sequence[str], words: Sequence[str]) -> DataFrame:
    """One row: of each number its median, and mean and deviation after filling nulls by it; of each word column its
    sorted vocabulary in the training rows. The row is as wide as the vocabularies, which belong to categories."""
    medians = train.agg(*(F.percentile(c, 0.5).alias(f"{c}_median") for c in numbers), *(F.array_sort(F.collect_set(c)).alias(f"{c}_words") for c in words))
    filled = train.select(*numbers).crossJoin(F.broadcast(medians))  # one row
    stats = filled.agg(*(x for c in numbers for x in (F.avg(F.coalesce(F.col(c), F.col(f"{c}_median"))).alias(f"{c}_mean"), F.stddev_pop(F.coalesce(F.col(c), F.col(f"{c}_median"))).alias(f"{c}_deviation"))))
    return medians.crossJoin(stats)


def _is(c: str) -> Callable[[Column], Column]:
    return lambda word: F.coalesce((word == F.col(c)).cast("double"), F.lit(0.0))


def encoded(rows: DataFrame, encoding: DataFrame, numbers: Sequence[str], words: Sequence[str]) -> DataFrame:
    """rows with ``encoded``: of each number its standard score (nulls filled by the median, no deviation gives 0) and
    whether it was missing; of each word column one place a word and a last one for unknown or null."""
    at = rows.crossJoin(F.broadcast(encoding))  # one row
    parts = []
    for c in numbers:
        score = (F.coalesce(F.col(c), F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.col(f"{c}_deviation")
        parts.append(F.array(F.when(F.col(f"{c}_deviation") > 0, score).otherwise(0.0), F.col(c).isNull().cast("double")))
    for c in words:
        known = F.coalesce(F.array_contains(f"{c}_words", F.col(c)), F.lit(False))
        parts.append(F.concat(F.transform(f"{c}_words", _is(c)), F.array((~known).cast("double"))))
    return at.select(*rows.columns, F.concat(*parts).alias("encoded"))
