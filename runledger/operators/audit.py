"""Audits: profiles, reconciliations, duplicates and fingerprints of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def request_shape(turns: DataFrame) -> DataFrame:
    """For every assistant turn the messages, characters and roles before it."""
    p = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    n = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, 1).otherwise(0)).over(p), F.lit(0)).cast("long")
    at = turns.select("conv_id", "turn", "role", F.count("*").over(p).alias("request_message_count"), F.coalesce(F.sum(F.char_length("text")).over(p), F.lit(0)).cast("long").alias("request_content_chars"), n("user").alias("user_messages"), n("assistant").alias("assistant_messages"))
    return at.where("role = 'assistant'").drop("role")


def trajectory_metrics(events: DataFrame) -> DataFrame:
    """Calls, attempts, tools, retries and usage states of each run in one aggregation."""
    kind, usage = F.col("event_type"), F.col("payload.usage")
    known = F.coalesce(usage["input_tokens"].isNotNull() & usage["output_tokens"].isNotNull(), F.lit(False))
    ends = kind.isin("api_completed", "api_failed")
    return events.groupBy("trajectory_id").agg(
        F.count("*").alias("events"), F.count_if(kind == "request_built").alias("calls"), F.count_if(kind == "api_attempt_started").alias("attempts"),
        (F.count_if(kind == "api_attempt_started") - F.count_if(kind == "request_built")).alias("retries"), F.count_if(kind.isin("tool_completed", "tool_failed")).alias("tools"), F.count_if(kind == "tool_failed").alias("failed_tools"),
        F.count_if(ends & known).alias("known_usage"), F.count_if(ends & ~known).alias("missing_usage"), (F.count_if(kind == "api_attempt_started") - F.count_if(ends)).alias("open_attempts"),
    )


def histogram(df: DataFrame, key: str, value: str, values: Sequence[str]) -> DataFrame:
    """Counts of the given values for each key as columns, zero where there is none."""
    return df.groupBy(key).pivot(value, list(values)).count().na.fill(0, list(values))


def status_matrix(rows: DataFrame, positions: Sequence[str], targets: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Rows by position, target and status, zero-filled over the full grid."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(p, t, s) for p in positions for t in targets for s in statuses], "position string, target string, label_status string")
    found = rows.groupBy("position", "target", "label_status").agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(found, ["position", "target", "label_status"], "left").na.fill(0, ["n"])


def status_reasons(rows: DataFrame, positions: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rows by position, target, status and reason, zero-filled: every (status, reason) that occurs anywhere has a row at
    every given position and target. A null reason counts as the empty one; without rows there is nothing."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(p, t) for p in positions for t in targets], "position string, target string")
    found = rows.groupBy("position", "target", "label_status", F.coalesce("label_reason", F.lit("")).alias("label_reason")).agg(F.count("*").alias("n"))
    pairs = found.select("label_status", "label_reason").distinct().crossJoin(F.broadcast(grid))  # a few constants
    return pairs.join(found, ["position", "target", "label_status", "label_reason"], "left").na.fill(0, ["n"])


def status_totals(rows: DataFrame) -> DataFrame:
    """Status totals over all rows, by position, by target and by both, in one pass."""
    return rows.cube("position", "target").agg(F.count("*").alias("n"), *(F.count_if(F.col("label_status") == s).alias(s) for s in ("observed", "missing", "censored", "invalid")))


def null_poisoned_sum(value: Column) -> Column:
    """The sum where every row has a value, else null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def usage_closure(attempts: DataFrame) -> DataFrame:
    """Per run whether the usage of all attempts, some or none is known, with the sums where all are."""
    by = attempts.groupBy("trajectory_id").agg(F.count("*").alias("attempts"), F.count("total_tokens").alias("known"), null_poisoned_sum(F.col("input_tokens")).alias("input_tokens"), null_poisoned_sum(F.col("output_tokens")).alias("output_tokens"))
    return by.withColumn("closure", F.when(F.col("known") == F.col("attempts"), "closed").when(F.col("known") == 0, "none").otherwise("missing"))


def nearest_rank(df: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles."""
    return df.agg(F.count(value).alias("n"), *(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, q in qs.items()))


def duplicates(files: DataFrame, content: Column, within: str, size: Column) -> DataFrame:
    """Groups of equal contents: copies, extra copies and bytes, groups within one owner and across owners."""
    by = files.select(F.sha2(content, 256).alias("h"), size.alias("size"), F.col(within).alias("owner")).groupBy("h", "size").agg(F.count("*").alias("copies"), F.count_distinct("owner").alias("owners")).where("copies > 1")
    return by.agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_copies"), F.coalesce(F.sum((F.col("copies") - 1) * F.col("size")), F.lit(0)).alias("extra_bytes"), F.count_if(F.col("owners") == 1).alias("within_one"), F.count_if(F.col("owners") > 1).alias("across"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and order-free content hash: the 128-bit MD5s of the rows, as four sums of 32 bits; any changed row shows."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("long")), F.lit(0)).alias(f"h{i}") for i, at in enumerate((1, 9, 17, 25))))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides, of the left only and of the right only."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("l") & F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull() & F.col("r")).alias("right_only"))


def count_of_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def inventory(files: DataFrame, by: str, size: Column) -> DataFrame:
    """Files and bytes by key with the total (null key)."""
    return files.rollup(by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def bottom_k(df: DataFrame, key: str, salt: str, k: int) -> DataFrame:
    """The k keys with the smallest hash: a sample that any order of the input gives again."""
    return df.select(key).distinct().withColumn("h", F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col(key).cast("string")), 256)).orderBy("h").limit(k)


def token_coverage(attempts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a usage field: the attempts that have it and its sum."""
    sums = attempts.agg(*(x for c in fields for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("known"), F.col(f"s_{c}").alias("tokens")) for c in fields))).alias("x")).select("x.*")


def encoder_statistics(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Train-only statistics, one row a column: exact median, mean and population deviation after filling nulls with the
    median, and the sorted vocabulary of text columns."""
    medians = df.agg(*(F.percentile(c, 0.5).alias(c) for c in numbers), *(F.array_sort(F.collect_set(c)).alias(c) for c in texts))
    filled = df.crossJoin(F.broadcast(medians.select(*(F.col(c).alias(f"_m_{c}") for c in numbers)))).agg(*(x for c in numbers for x in (F.avg(F.coalesce(F.col(c), F.col(f"_m_{c}"))).alias(f"a_{c}"), F.stddev_pop(F.coalesce(F.col(c), F.col(f"_m_{c}"))).alias(f"d_{c}"), F.first(f"_m_{c}").alias(f"m_{c}"))))
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("median"), F.col(f"a_{c}").alias("mean"), F.col(f"d_{c}").alias("deviation"), F.lit(None).cast("array<string>").alias("vocabulary"))
    out = filled.select(F.explode(F.array(*map(one, numbers))).alias("x")).select("x.*")
    words = [medians.select(F.lit(c).alias("column"), *(F.lit(None).cast("double").alias(n) for n in ("median", "mean", "deviation")), F.col(c).alias("vocabulary")) for c in texts]
    for w in words:
        out = out.unionByName(w)
    return out


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Least, most, sum and mean of a count column, and how often each value occurs: one row a value."""
    whole = df.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row


def four_states(rows: DataFrame, by: Sequence[str] = (), status: str = "label_status") -> DataFrame:
    """How many rows are observed, missing, censored and invalid."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("observed", "missing", "censored", "invalid")))


def flag_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row a flag: rows where it is true, false and unknown."""
    sums = df.agg(*(F.count_if(x).alias(f"{n}_{k}") for n, c in flags.items() for k, x in (("t", c), ("f", ~c), ("u", c.isNull()))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), F.col(f"{n}_t").alias("true_count"), F.col(f"{n}_f").alias("false_count"), F.col(f"{n}_u").alias("unknown_count")) for n in flags))).alias("x")).select("x.*")


def evaluator_status(outcomes: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes (outcome: 1 resolved, 2 not, 3 no result, 4 broken, 5 cut off) against the reports of their runs
    (report_count, report_resolved): observed where exactly one report agrees, missing without any, censored, else invalid."""
    at = outcomes.join(reports, list(keys), "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))
    judged, said = F.col("outcome").isin(1, 2), F.col("report_resolved") == F.when(F.col("outcome") == 1, 1).otherwise(0)
    agrees = judged & (F.col("report_count") == 1) & F.coalesce(said, F.lit(False))
    missing = (F.col("outcome") == 3) | (judged & (F.col("report_count") == 0))
    return at.agg(F.count_if(agrees).alias("observed"), F.count_if(missing).alias("missing"), F.count_if(F.col("outcome") == 5).alias("censored"), F.count_if((F.col("outcome") == 4) | (judged & ~agrees & ~missing)).alias("invalid"))


def ledger_reconciliation(one: DataFrame, two: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two ledgers of the same calls: entries that agree, differ, are in the first only (extra) and in the second only (missing)."""
    a = one.select(*keys, F.struct(*values).alias("a"))
    b = two.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, list(keys), "full_outer")
    same, there = F.col("a").eqNullSafe(F.col("b")), F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(F.count_if(there & same).alias("agreeing"), F.count_if(there & ~same).alias("disagreeing"), F.count_if(F.col("b").isNull()).alias("extra"), F.count_if(F.col("a").isNull()).alias("missing"))


def totals_agree(said: DataFrame, counted: DataFrame) -> DataFrame:
    """One row a column of two one-row aggregates: both values and whether they are equal."""
    own = [c for c in said.columns if c in counted.columns]
    both = said.select(F.struct(*own).alias("s")).crossJoin(F.broadcast(counted.select(F.struct(*own).alias("c"))))  # one row each
    return both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"s.{c}").cast("long").alias("said"), F.col(f"c.{c}").cast("long").alias("counted")) for c in own))).alias("x")).select("x.*", F.col("x.said").eqNullSafe(F.col("x.counted")).alias("agrees"))


def transitions(snapshots: DataFrame) -> DataFrame:
    """How each request's messages follow from those before: snapshots (trajectory_id, seq, fingerprints, roles, may_repeat).

    ``extension``: the old messages and more, beginning with the answer; ``unanswered``: and one user message only;
    ``repeat``: the same again, where that may be; ``reset``: a new system and user message; else ``broken``.
    """
    w = W.partitionBy("trajectory_id").orderBy("seq")
    at = snapshots.withColumns({"next": F.lead("fingerprints").over(w), "next_roles": F.lead("roles").over(w)}).where("next IS NOT NULL")
    n, m = F.size("fingerprints"), F.size("next")
    prefix = F.slice("next", F.lit(1), n) == F.col("fingerprints")
    first = F.get("next_roles", n)
    kind = (
        F.when((F.col("next") == F.col("fingerprints")) & F.col("may_repeat"), "repeat").when((m == 2) & (F.col("next_roles") == F.array(F.lit("system"), F.lit("user"))) & ~prefix, "reset")
        .when((m > n) & prefix & (m == n + 1) & (first == "user"), "unanswered").when((m > n) & prefix & (first == "assistant"), "extension").otherwise("broken")
    )
    return at.select("trajectory_id", "seq", kind.alias("transition"))


def rank_agreement(df: DataFrame, by: str, orders: Sequence[str]) -> DataFrame:
    """Of each group the rows and how many of them have the same rank in all orders (ties by the first order)."""
    ranks = [F.row_number().over(W.partitionBy(by).orderBy(F.col(c).asc_nulls_last(), F.col(orders[0]))) for c in orders]
    at = df.select(by, *(r.alias(f"_r{i}") for i, r in enumerate(ranks)))
    same = F.lit(True)
    for i in range(1, len(orders)):
        same = same & (F.col(f"_r{i}") == F.col("_r0"))
    return at.groupBy(by).agg(F.count("*").alias("n"), F.count_if(same).alias("agreeing"))


def counters(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs: (name, value, n), in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names))).alias("p")
    return df.select(pairs).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))
