"""Prediction points and supervised rows: (position, target) fan-out, label join, weights, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.operators.audit import fingerprint

#: Target -> the label it reads, by position of its points.
TARGETS = {
    "call_pre": {"call_billable_total": "call_billable_total", "call_billable_output": "call_billable_output", "call_unknown_billable": "call_unknown_billable", "final_response_output": "final_response_output"},
    "task_pre": {"task_provider_accounted_remaining": "task_provider_accounted_remaining", "task_unknown_remaining": "task_unknown_remaining"},
    "task_update": {"task_provider_accounted_remaining": "task_provider_accounted_remaining", "task_unknown_remaining": "task_unknown_remaining"},
}


def points(snapshots: DataFrame) -> DataFrame:
    """Label-free points: every request fans out to (position, target); the first request of a run is task_pre, later ones task_update."""
    first = F.row_number().over(W.partitionBy("trajectory_id").orderBy("cutoff_event_seq")) == 1
    pairs = lambda position: F.array(*(F.struct(F.lit(position).alias("position"), F.lit(t).alias("target")) for t in TARGETS[position]))
    fan = F.explode(F.concat(pairs("call_pre"), F.when(F.col("first"), pairs("task_pre")).otherwise(pairs("task_update")))).alias("p")
    out = snapshots.withColumn("first", first).select("*", fan).drop("first")
    return out.select(F.concat_ws(":", "source_event_id", "p.position", "p.target").alias("point_id"), F.col("p.position").alias("position"), F.col("p.target").alias("target"), *snapshots.columns)


def rows(events: DataFrame, runs: DataFrame, snapshots: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with their labels and task, run and condition; a point without a label fails the query. Labels join once a
    request, on the run and the boundary, before the fan-out."""
    kinds = list(dict.fromkeys(c for by in TARGETS.values() for c in by.values()))
    own = labels.select("trajectory_id", F.col("event_seq").alias("cutoff_event_seq"), F.struct(*kinds).alias("_labels"))
    joined = points(snapshots.join(own, ["trajectory_id", "cutoff_event_seq"], "left")).join(runs.select("trajectory_id", "task_id", "condition_id"), "trajectory_id")
    return _labelled(joined, snapshots.columns)


def rows_of(requests: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` of requests that have the features ``names``, their labels, task and condition already: nothing is joined."""
    kinds = list(dict.fromkeys(c for by in TARGETS.values() for c in by.values()))
    return _labelled(points(requests.select(*names, "task_id", "condition_id", F.struct(*kinds).alias("_labels"))), names)


def _labelled(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    label = F.coalesce(*(F.when((F.col("position") == p) & (F.col("target") == t), F.col("_labels")[c]) for p, by in TARGETS.items() for t, c in by.items()))
    joined = joined.withColumns({f"label_{c}": label[c] for c in ("value", "status", "reason")}).drop("_labels")
    status = F.coalesce("label_status", F.raise_error(F.concat(F.lit("a point has no label: "), "point_id")).cast("string"))
    return joined.select("trajectory_id", "point_id", "position", "target", *(c for c in names if c != "trajectory_id"), "label_value", status.alias("label_status"), "label_reason", "task_id", "condition_id")


def cell_rows(runs: DataFrame, snapshots: DataFrame, labels: DataFrame, position: str, target: str) -> DataFrame:
    """``rows`` for one position and target only: picked before the join, which is on the run and the boundary."""
    first = F.row_number().over(W.partitionBy("trajectory_id").orderBy("cutoff_event_seq")) == 1
    here = {"call_pre": F.lit(True), "task_pre": F.col("_first"), "task_update": ~F.col("_first")}[position]
    label = F.col(TARGETS[position][target])
    own = labels.select("trajectory_id", F.col("event_seq").alias("cutoff_event_seq"), label["value"].alias("label_value"), label["status"].alias("label_status"), label["reason"].alias("label_reason"))
    at = snapshots.withColumn("_first", first).where(here).drop("_first").join(own, ["trajectory_id", "cutoff_event_seq"], "left").join(runs.select("trajectory_id", "task_id", "condition_id"), "trajectory_id")
    status = F.coalesce("label_status", F.raise_error(F.concat(F.lit("a point has no label: "), "source_event_id")).cast("string"))
    return at.withColumns({"label_status": status, "position": F.lit(position), "target": F.lit(target), "point_id": F.concat_ws(":", "source_event_id", F.lit(position), F.lit(target))})


def request_cell(runs: DataFrame | None, labels: DataFrame, position: str, target: str) -> DataFrame:
    """``cell_rows`` of the requests that labels has, with no features but the request's number and size: nothing is
    joined but the runs, and the events are read for their labels alone. Without ``runs``, labels have the task and
    condition of their run."""
    number = F.row_number().over(W.partitionBy("trajectory_id").orderBy("event_seq")).cast("long")
    here = {"call_pre": F.lit(True), "task_pre": F.col("request_count") == 1, "task_update": F.col("request_count") > 1}[position]
    label = F.col(TARGETS[position][target])
    own = labels.withColumn("request_count", number).where(here).select(
        "trajectory_id", F.col("event_seq").alias("cutoff_event_seq"), F.col("point_event_id").alias("source_event_id"), "logical_call_id", "request_count", F.col("request_tokens_local").alias("current_request_tokens_local"),
        label["value"].alias("label_value"), label["status"].alias("label_status"), label["reason"].alias("label_reason"), *(("task_id", "condition_id") if runs is None else ()),
    )
    at = own if runs is None else own.join(runs.select("trajectory_id", "task_id", "condition_id"), "trajectory_id")
    return at.withColumns({"position": F.lit(position), "target": F.lit(target), "point_id": F.concat_ws(":", "source_event_id", F.lit(position), F.lit(target))})


def context_id(explicit: Column, state: Column, request_hash: Column, run_context: Column, call_id: Column) -> Column:
    """What a point's forecast may share with others: what its event says, else the run's context and the call."""
    said = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (explicit, state, request_hash)]
    return F.coalesce(*said, F.concat_ws(":", run_context, F.lit("call"), call_id))


def condition_id(explicit: Column, **config: Column) -> Column:
    """The condition a run says, else a hash of those configuration values that aren't null (canonical JSON, keys in
    order), else a constant."""
    has = F.coalesce(*(c.cast("string") for c in config.values()))
    text = F.to_json(F.struct(*(config[k].alias(k) for k in sorted(config))), {"ignoreNullFields": "true"})
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.when(has.isNotNull(), F.concat(F.lit("condition:"), F.substring(F.sha2(text, 256), 1, 16))), F.lit("condition:unspecified"))


def declared(value: Column, observables: Column, needs: str = "request_local_count") -> Column:
    """A feature that counts only where its source declares the observable it needs; null elsewhere."""
    return F.when(F.array_contains(observables, needs), value)


def eligibility(cell: DataFrame) -> DataFrame:
    """One row: how many points a cell has and an order-free hash of their ids, equal for equal cells."""
    return fingerprint(cell, ["point_id"])


def balance_groups(cell: DataFrame, least: int = 5) -> DataFrame:
    """(condition_id, position, target, tasks): the groups whose tasks are to be spread over folds, with ``least`` tasks or more."""
    return cell.groupBy("condition_id", "position", "target").agg(F.count_distinct("task_id").alias("tasks")).where(F.col("tasks") >= least)


def universe(rows: DataFrame) -> DataFrame:
    """The tasks of each condition."""
    return rows.select("condition_id", "task_id").distinct()


def eligible(rows: DataFrame, position: str | None = None, target: str | None = None, condition: str | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """The observed rows of a cell; required features must not be null."""
    out = rows.where("label_status = 'observed'")
    for name, value in (("position", position), ("target", target), ("condition_id", condition)):
        out = out if value is None else out.where(F.col(name) == value)
    for name in features:
        out = out.where(F.col(name).isNotNull())
    return out


def weighted(cell: DataFrame) -> DataFrame:
    """cell with weight = 1 / (runs of the task * points of the run): every task of a cell weighs 1 in all.

    Two aggregations instead of a distinct count over a window.
    """
    sized = run_weights(cell)
    return cell.join(sized, [c for c in sized.columns if c != "weight"])


def run_weights(cell: DataFrame) -> DataFrame:
    """(condition_id, position, target, task_id, trajectory_id, weight): what each point of a run weighs in ``weighted``."""
    keys = ["condition_id", "position", "target", "task_id"]
    by_run = cell.groupBy(*keys, "trajectory_id").agg(F.count("*").alias("run_points"))
    by_task = by_run.groupBy(*keys).agg(F.count("*").alias("task_runs"))
    return by_run.join(by_task, keys).withColumn("weight", 1 / (F.col("task_runs") * F.col("run_points"))).drop("task_runs", "run_points")


def lifecycle_weights(rows: DataFrame) -> DataFrame:
    """rows with lifecycle_weight: only observed update points weigh, others 0; each task weighs 1."""
    keys = ["condition_id", "target", "task_id"]
    scored = (F.col("position") == "task_update") & (F.col("label_status") == "observed")
    by_run = rows.groupBy(*keys, "trajectory_id").agg(F.count_if(scored).alias("run_points"))
    by_task = by_run.groupBy(*keys).agg(F.count_if(F.col("run_points") > 0).alias("task_runs"))
    sized = by_run.join(by_task, keys)
    return rows.join(sized, [*keys, "trajectory_id"]).withColumn("lifecycle_weight", F.when(scored, 1 / (F.col("task_runs") * F.col("run_points"))).otherwise(0.0)).drop("run_points", "task_runs")


def visible_spend(rows: DataFrame) -> DataFrame:
    """rows with the spend that became visible since the point before; unknown only where the missing-usage counter grew."""
    w = W.partitionBy("trajectory_id", "target").orderBy("cutoff_event_seq", "point_id")
    spent = F.col("cumulative_provider_input_tokens") + F.col("cumulative_provider_output_tokens")
    grew = F.col("missing_usage_attempts") > F.lag("missing_usage_attempts").over(w)
    delta = spent - F.lag(spent).over(w)
    checked = F.when(delta < 0, F.raise_error(F.lit("spend counters decrease")).cast("long")).otherwise(delta)
    return rows.withColumn("visible_spend", F.when(~grew, checked))


def carried_forecast(rows: DataFrame, start: str) -> DataFrame:
    """The mechanical update: the start forecast less what was spent, never below 0, carried over unknown steps.

    W_t = max(0, W_(t-1) - s_t) in closed form: with S the running sum of -s (unknown counts 0),
    W_t = S_t + max(W_0, -min over k <= t of S_k), so no sequential code is needed.
    """
    w = W.partitionBy("trajectory_id", "target").orderBy("cutoff_event_seq", "point_id")
    prefix = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_s", F.sum(-F.coalesce("visible_spend", F.lit(0))).over(prefix))
    out = out.withColumn("_w0", F.first(start).over(prefix))
    return out.withColumn("carried", F.col("_s") + F.greatest(F.col("_w0"), -F.min("_s").over(prefix))).drop("_s", "_w0")
