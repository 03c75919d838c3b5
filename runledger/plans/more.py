"""Queries on usage names, identities, raw intervals, strata, reconciliations and message prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import text, usage
from runledger.operators import audit, compare, features, forecast, labels, metrics, points, validate
from runledger.plans import base
from runledger.plans.base import ATTEMPTS, CELL, HISTORY, LABELS, SCORED, rounded
from runledger.sources import chat, external, mapping
from runledger.sources.mapping import table
from runledger.sources.tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT AS input_tokens, CASE WHEN l_linenumber = 5 THEN NULL ELSE floor(l_quantity)::BIGINT END AS output_tokens, CASE WHEN l_linenumber = 1 THEN floor(l_extendedprice)::BIGINT + floor(l_quantity)::BIGINT WHEN l_linenumber = 2 THEN 7 END AS total_tokens,
  CASE WHEN l_linenumber = 3 THEN l_partkey END AS cached_input_tokens, CASE WHEN l_linenumber = 4 THEN floor(l_quantity)::BIGINT + l_suppkey % 2 END AS reasoning_output_tokens,
  CASE l_linenumber WHEN 2 THEN CASE WHEN floor(l_extendedprice)::BIGINT + floor(l_quantity)::BIGINT <> 7 THEN 'total_differs' ELSE '' END WHEN 5 THEN 'output_tokens' WHEN 4 THEN CASE WHEN l_suppkey % 2 = 1 THEN 'reasoning_exceeds_output' ELSE '' END ELSE '' END AS problems FROM lineitem""")
def usage_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage objects written under other names line by line, and parsed again."""
    n, i, o = F.col("l_linenumber"), F.floor("l_extendedprice").cast("long"), F.floor("l_quantity").cast("long")
    one = F.struct(
        F.when(n % 2 == 1, i).alias("input_tokens"), F.when(n % 2 == 0, i).alias("prompt_tokens"), F.when(~n.isin(2, 4, 5), o).alias("output_tokens"), F.when(n.isin(2, 4), o).alias("completion_tokens"),
        F.when(n == 1, i + o).when(n == 2, 7).alias("total_tokens"), F.when(n == 3, F.struct(F.col("l_partkey").alias("cached_tokens"))).alias("prompt_tokens_details"), F.when(n == 4, F.struct((o + F.col("l_suppkey") % 2).alias("reasoning_tokens"))).alias("completion_tokens_details"),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("x", F.to_json(one))
    lines = lines.withColumn("x", F.when(n == 5, F.concat(F.expr("left(x, length(x) - 1)"), F.lit(',"output_tokens":"many"}'))).otherwise(F.col("x")))
    at = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", usage.parsed(F.try_parse_json("x")).alias("u"))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.col(f"u.{c}") for c in ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_output_tokens")), F.array_join("u.problems", "|").alias("problems"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'condition:' || substr(sha256('{"max_steps":' || (o_orderkey % 5)::VARCHAR || ',"model_id":"' || o_orderstatus || '"}'), 1, 16) ELSE 'condition:unspecified' END AS condition_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'said' WHEN 1 THEN 'state' WHEN 2 THEN 'hash' ELSE o_orderkey::VARCHAR || ':call:c1' END AS context_id FROM orders""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition and context ids: said, hashed from the configuration, or a constant."""
    k = F.col("o_orderkey")
    condition = points.condition_id(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(" "), model_id=F.when(k % 3 == 1, F.col("o_orderstatus")), max_steps=F.when(k % 3 == 1, k % 5))
    context = points.context_id(F.when(k % 4 == 0, "said"), F.when(k % 4 == 1, "state"), F.when(k % 4 == 2, "hash"), k.cast("string"), F.lit("c1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", condition.alias("condition_id"), context.alias("context_id"))


@query("SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"none\":null}') AS identity FROM orders")
def row_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.row_identity(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None).cast("string").alias("none")).alias("identity"))


@query("WITH" + SCORED + """, r AS (SELECT *, greatest(0, raw_lower) AS lo, greatest(raw_upper, point) AS hi FROM scored),
  m AS (SELECT condition_id, min(v) FILTER (c >= (0.5 - 1e-12) * t) AS x FROM (SELECT condition_id, v, sum(w) OVER (PARTITION BY condition_id ORDER BY v) AS c, sum(w) OVER (PARTITION BY condition_id) AS t FROM (SELECT condition_id, hi - lo AS v, sum(weight) AS w FROM r GROUP BY ALL)) GROUP BY ALL),
  k AS (SELECT condition_id, avg(ok::DOUBLE) AS x FROM (SELECT condition_id, task_id, min((truth BETWEEN lo AND hi)::INT) AS ok FROM r GROUP BY ALL) GROUP BY ALL)
  SELECT r.condition_id, round(sum(weight * (truth BETWEEN lo AND hi)::INT) / sum(weight), 6) AS raw_coverage, round(sum(weight * (hi < truth)::INT) / sum(weight), 6) AS raw_interval_below_truth_rate, round(sum(weight * (lo > truth)::INT) / sum(weight), 6) AS raw_interval_above_truth_rate,
  round(sum(weight * greatest(0, hi - truth)) / sum(weight), 3) AS raw_mean_extra_reserved_tokens, round(any_value(k.x), 6) AS raw_task_simultaneous_coverage, round(sum(weight * (hi - lo + 20 * greatest(0, lo - truth) + 20 * greatest(0, truth - hi))) / sum(weight), 3) AS raw_interval_score,
  round(any_value(m.x), 3) AS raw_median_interval_width, round(sum(weight * (raw_lower > point OR point > raw_upper)::INT) / sum(weight), 6) AS quantile_crossing_rate FROM r JOIN m USING (condition_id) JOIN k USING (condition_id) GROUP BY r.condition_id""")
def raw_metric_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.raw_suite(base.scored(spark, sf_dir), ["condition_id"])
    tokens = ("raw_mean_extra_reserved_tokens", "raw_interval_score", "raw_median_interval_width")
    return out.drop("raw_target_exceeds_upper_rate", "raw_normalized_interval_width").select("condition_id", *(F.round(c, 3 if c in tokens else 6).alias(c) for c in out.columns if c not in ("condition_id", "raw_target_exceeds_upper_rate", "raw_normalized_interval_width")))


@query("""WITH c AS (SELECT event_type, value, sum(count(*)) OVER (PARTITION BY event_type ORDER BY value) AS c, sum(count(*)) OVER (PARTITION BY event_type) AS t FROM events WHERE value IS NOT NULL GROUP BY event_type, value)
  SELECT e.event_type, count(*) AS n, round(median(e.value), 6) AS latency_p50_ms, round(any_value(p.x), 6) AS latency_p95_ms, sum(e.user_id)::BIGINT AS prediction_overhead_tokens FROM events e JOIN (SELECT event_type, min(value) FILTER (c >= (0.95 - 1e-12) * t) AS x FROM c GROUP BY ALL) p USING (event_type) WHERE e.value IS NOT NULL GROUP BY ALL""")
def prediction_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of an event read as milliseconds, its user as overhead tokens."""
    return rounded(metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"], ["user_id"]))


@query("WITH" + LABELS + """, s AS (SELECT condition_id, task_id, trajectory_id, CASE WHEN ordinal > 1 THEN rest_status END AS st, coalesce(nullif(rest_reason, ''), 'unspecified') AS why FROM labels0),
  r AS (SELECT condition_id, task_id, trajectory_id, string_agg(DISTINCT CASE WHEN st = 'censored' THEN why END, '+' ORDER BY CASE WHEN st = 'censored' THEN why END) AS c, string_agg(DISTINCT CASE WHEN st = 'missing' THEN why END, '+' ORDER BY CASE WHEN st = 'missing' THEN why END) AS m, count(*) FILTER (st = 'observed') AS o, count(st) AS n FROM s GROUP BY ALL)
  SELECT condition_id, CASE WHEN c IS NOT NULL THEN 'censored:' || c WHEN o > 0 THEN 'observed_termination' ELSE 'unscored_missing:' || coalesce(m, 'unspecified') END AS stratum, count(*) AS n_sequences, count(DISTINCT task_id) AS n_tasks, sum(n)::BIGINT AS n_update_boundaries, sum(o)::BIGINT AS n_scored, sum(n - o)::BIGINT AS n_context_only FROM r GROUP BY ALL""")
def termination_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = base.all_rows(spark, sf_dir, history=False).where("target = 'task_provider_accounted_remaining'")
    update = F.col("position") == "task_update"
    return metrics.termination_strata(steps.select("condition_id", "task_id", "trajectory_id", F.when(update, F.col("label_status")).alias("label_status"), "label_reason"), ["condition_id"])


@query("WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY ALL) SELECT turns AS value, count(*) AS n, min(min(turns)) OVER () AS least, max(max(turns)) OVER () AS most, sum(sum(turns)) OVER ()::BIGINT AS total, round(sum(sum(turns)) OVER () / sum(count(*)) OVER (), 6) AS mean FROM c GROUP BY turns")
def turn_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return rounded(audit.distribution(turns, "turns"))


@query("WITH" + LABELS + " SELECT condition_id, count(*) FILTER (rest_status = 'observed') AS observed, count(*) FILTER (rest_status = 'missing') AS missing, count(*) FILTER (rest_status = 'censored') AS censored, count(*) FILTER (rest_status = 'invalid') AS invalid FROM labels0 GROUP BY ALL")
def four_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = labels.suffix_labels(mapping.events(spark, sf_dir)).join(mapping.runs(spark, sf_dir).select("trajectory_id", "condition_id"), "trajectory_id")
    return audit.four_states(suffix.withColumn("label_status", F.col("task_provider_accounted_remaining.status")), ["condition_id"])


@query("SELECT unnest(['toxic', 'good']) AS flag, unnest([count(*) FILTER (toxic = 1), count(*) FILTER (quality = 1)]) AS true_count, unnest([count(*) FILTER (toxic <> 1), count(*) FILTER (quality <> 1)]) AS false_count, unnest([count(*) FILTER (toxic IS NULL), count(*) FILTER (quality IS NULL)]) AS unknown_count FROM documents LEFT JOIN labels USING (doc_id)")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return audit.flag_counts(both, {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1})


@query("""WITH o AS (SELECT doc_id, 1 + doc_id % 5 AS outcome FROM documents), r AS (SELECT doc_id, 1 + (doc_id % 11 = 0)::INT AS n, CASE WHEN doc_id % 7 > 0 THEN quality END AS ok FROM labels), j AS (SELECT o.outcome, coalesce(n, 0) AS n, ok FROM o LEFT JOIN r USING (doc_id)),
  s AS (SELECT CASE WHEN outcome = 5 THEN 'c' WHEN outcome = 4 THEN 'i' WHEN outcome = 3 OR n = 0 THEN 'm' WHEN n = 1 AND ok IS NOT NULL AND (ok = 1) = (outcome = 1) THEN 'o' ELSE 'i' END AS s FROM j)
  SELECT count(*) FILTER (s = 'o') AS observed, count(*) FILTER (s = 'm') AS missing, count(*) FILTER (s = 'c') AS censored, count(*) FILTER (s = 'i') AS invalid FROM s""")
def evaluator_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs with an outcome, labels as their reports."""
    outcomes = table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 5).alias("outcome"))
    reports = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1).alias("report_count"), F.when(F.col("doc_id") % 7 > 0, F.col("quality")).alias("report_resolved"))
    return audit.evaluator_status(outcomes, reports, ["doc_id"])


@query("WITH" + CELL + """, p AS (SELECT c.trajectory_id || '-' || b.seq || ':task_update:task_provider_accounted_remaining' AS id FROM cell c JOIN (SELECT trajectory_id, call_no, 1 + ordinal - 1 + 3 * (coalesce(sum(attempts) OVER w, 0)) AS seq FROM ledger WINDOW w AS (PARTITION BY trajectory_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b USING (trajectory_id, call_no)), h AS (SELECT md5(id) AS h FROM p)
  SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS h0, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS h1, sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS h2, sum(('0x' || substr(h, 25, 8))::BIGINT)::BIGINT AS h3 FROM h""")
def cell_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.eligibility(base.cell(spark, sf_dir))


@query("WITH" + CELL + " SELECT condition_id, 'task_update' AS position, 'task_provider_accounted_remaining' AS target, count(DISTINCT task_id) AS tasks FROM cell GROUP BY ALL HAVING count(DISTINCT task_id) >= 5")
def balance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.balance_groups(base.cell(spark, sf_dir))


@query("WITH" + CELL + " SELECT DISTINCT condition_id, task_id FROM cell")
def cell_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.universe(base.cell(spark, sf_dir))


_TASK_ERRORS = ", t AS (SELECT condition_id, task_id, sum(weight * abs(point - truth)) / sum(weight) AS c, sum(weight * abs(100000 - truth)) / sum(weight) AS r FROM scored GROUP BY ALL)"
_DRAWS = "n AS (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS place, count(*) OVER () AS n FROM k), d AS (SELECT b, ('0x' || substr(md5('seed|' || b || '|' || place), 1, 8))::BIGINT % n AS pick FROM n, (SELECT unnest(range(1, 201)) AS b))"


@query("WITH" + SCORED + _TASK_ERRORS + ", k AS (SELECT task_id, avg(c - r) AS delta FROM t GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT condition_id) FROM t)), " + _DRAWS + """, s AS (SELECT b, avg(n.delta) AS delta FROM d JOIN n ON n.place = d.pick GROUP BY ALL)
  SELECT (SELECT count(*) FROM k) AS n_tasks, (SELECT round(avg(delta), 3) FROM k) AS mean_mae_delta, round(quantile_disc(delta, 0.025), 3) AS ci_low, round(quantile_disc(delta, 0.975), 3) AS ci_high, avg((delta < 0)::INT)::DOUBLE AS win_probability FROM s""")
def across_conditions_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that all conditions have: the forecasts against a flat guess of 100,000 tokens."""
    one = base.scored(spark, sf_dir)
    mae = lambda point, name: metrics.weighted_mean(F.abs(point - F.col("truth"))).alias(name)
    errors = kept(one.groupBy("condition_id", "task_id").agg(mae(F.col("point"), "candidate"), mae(F.lit(100_000.0), "reference")), "errors")
    return rounded(compare.across_conditions_bootstrap(errors, 200, "seed"), 3)


_SCORE = "sum(weight * ({1} - {0} + 20 * greatest(0, {0} - truth) + 20 * greatest(0, truth - {1})))"


@query("WITH" + SCORED + f", k AS (SELECT task_id, sum(weight) AS w, {_SCORE.format('lower', 'upper')} AS sa, {_SCORE.format('raw_lower', 'raw_upper')} AS sb, min((truth BETWEEN lower AND upper)::INT) AS ca, min((truth BETWEEN raw_lower AND raw_upper)::INT) AS cb FROM scored GROUP BY ALL), " + _DRAWS + """,
  s AS (SELECT b, sum(n.sa - n.sb) / sum(n.w) AS i, sum(n.ca - n.cb) / count(*) AS c FROM d JOIN n ON n.place = d.pick GROUP BY ALL)
  SELECT (SELECT count(*) FROM k) AS n_tasks, (SELECT round(sum(sa - sb) / sum(w), 3) FROM k) AS interval_score_delta, (SELECT round(sum(ca - cb) / count(*), 3) FROM k) AS task_coverage_delta, round(quantile_cont(i, 0.025), 3) AS interval_score_delta_low, round(quantile_cont(i, 0.975), 3) AS interval_score_delta_high,
  round(quantile_cont(c, 0.025), 3) AS task_coverage_delta_low, round(quantile_cont(c, 0.975), 3) AS task_coverage_delta_high FROM s""")
def interval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated intervals against those before calibration."""
    one = base.scored(spark, sf_dir).withColumns({"other_lower": F.col("raw_lower"), "other_upper": F.col("raw_upper")})
    return rounded(compare.interval_bootstrap(one, 200, "seed"), 3)


@query("WITH" + HISTORY + """, h AS (SELECT * FROM hist) SELECT unnest(['request_count', 'current_request_tokens_local', 'last_call_output_tokens']) AS feature, unnest([0, count(*) FILTER (local IS NULL), count(*) FILTER (last_call_output_tokens IS NULL)]) AS incomplete_rows,
  unnest([true, count(*) FILTER (local IS NULL) = 0, count(*) FILTER (last_call_output_tokens IS NULL) = 0]) AS complete FROM h""")
def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = base.requests(spark, sf_dir)
    return validate.complete_features(snaps, ("request_count", "current_request_tokens_local", "last_call_output_tokens"))


@query("WITH" + HISTORY + " SELECT trajectory_id, 'call-' || call_no AS logical_call_id, CASE WHEN trajectory_id::BIGINT % 2 = 0 THEN local END AS local FROM hist")
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local counts of the sources that declare them: runs with even numbers."""
    snaps = features.selected(features.snapshots(kept(mapping.events(spark, sf_dir), "events"), kept), ["request", "logical_call_id"])
    observables = F.when(F.col("trajectory_id").cast("long") % 2 == 0, F.array(F.lit("usage"), F.lit("request_local_count"))).otherwise(F.array(F.lit("usage")))
    return snaps.select("trajectory_id", "logical_call_id", points.declared(F.col("current_request_tokens_local"), observables).alias("local"))


@query("WITH" + ATTEMPTS + """ SELECT (SELECT count(*) FROM calls) AS boundaries, (SELECT count(*) FROM calls WHERE call_no % 2 = 0) AS dropped""")
def boundary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary has one snapshot; of snapshots of odd calls only, just the even ones are missed."""
    events = kept(mapping.events(spark, sf_dir), "events")
    boundaries = events.where("event_type = 'request_built'").select("trajectory_id", F.col("event_seq").alias("cutoff_event_seq"))
    snaps = features.snapshots(events, kept).select("trajectory_id", "cutoff_event_seq", "logical_call_id")
    equal = compare.key_mismatches(snaps, boundaries, ["trajectory_id", "cutoff_event_seq"]).agg(F.count("*").alias("_bad"))
    odd = snaps.where(F.regexp_extract("logical_call_id", r"(\d+)$", 1).cast("int") % 2 == 1)
    dropped = compare.key_mismatches(odd, boundaries, ["trajectory_id", "cutoff_event_seq"]).agg(F.count("*").alias("dropped"))
    return boundaries.agg(F.count("*").alias("boundaries")).crossJoin(equal).crossJoin(dropped).where("_bad = 0").drop("_bad")


@query("WITH" + ATTEMPTS + """, a AS (SELECT *, call_no % 4 AS q FROM att) SELECT count(*) FILTER (q IN (1, 2)) AS agreeing, count(*) FILTER (q = 3) AS disagreeing, count(*) FILTER (q = 0) AS extra, (SELECT count(*) FROM orders) AS missing FROM a""")
def ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts against a second ledger that lacks every fourth call, says another output for every third and has one entry more a run."""
    keys, values = ["trajectory_id", "call_no", "attempt_no"], ["input_tokens", "output_tokens"]
    one = kept(mapping.attempts(spark, sf_dir).select(*keys, *values), "ledger")
    q = F.col("call_no") % 4
    two = one.where(q != 0).withColumn("output_tokens", F.when(q == 3, F.coalesce("output_tokens", F.lit(0)) + 1).otherwise(F.col("output_tokens")))
    more = mapping.runs(spark, sf_dir).select("trajectory_id", F.lit(99).cast("long").alias("call_no"), F.lit(1).cast("long").alias("attempt_no"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    return audit.ledger_reconciliation(one, two.unionByName(more), keys, values)


@query("SELECT unnest(['files', 'bytes']) AS field, unnest([count(*), sum(n_chars)::BIGINT]) AS said, unnest([count(*), sum(length(text))::BIGINT]) AS counted, unnest([true, sum(n_chars) IS NOT DISTINCT FROM sum(length(text))]) AS agrees FROM documents")
def totals_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table says of its texts' lengths against what is counted."""
    docs = table(spark, sf_dir, "documents")
    said = docs.agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return audit.totals_agree(said, docs.agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("bytes")))


_SNAPSHOTS = """m AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS f FROM conversations), s AS (SELECT conv_id, turn, role, list(f) OVER w AS fs, list(role) OVER w AS rs FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, f)),
  u AS (SELECT conv_id, 2 * turn AS seq, CASE WHEN conv_id % 4 = 3 AND turn >= 2 THEN ['x', f2] ELSE fs END AS fs, CASE WHEN conv_id % 4 = 3 AND turn >= 2 THEN ['system', 'user'] ELSE rs END AS rs FROM (SELECT *, fs[-1] AS f2 FROM s) WHERE role = 'user' OR conv_id % 4 = 2
    UNION ALL SELECT conv_id, 2 * turn + 1, fs, rs FROM s WHERE role = 'user' AND conv_id % 4 = 1),
  t AS (SELECT conv_id, seq, fs, lead(fs) OVER w AS nf, lead(rs) OVER w AS nr, conv_id % 8 = 1 AS may FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY seq))"""


@query("WITH " + _SNAPSHOTS + """ SELECT conv_id::VARCHAR AS trajectory_id, seq, CASE WHEN nf = fs AND may THEN 'repeat' WHEN len(nf) = 2 AND nr = ['system', 'user'] AND nf[1:len(fs)] <> fs THEN 'reset' WHEN len(nf) > len(fs) AND nf[1:len(fs)] = fs AND len(nf) = len(fs) + 1 AND nr[len(fs) + 1] = 'user' THEN 'unanswered'
  WHEN len(nf) > len(fs) AND nf[1:len(fs)] = fs AND nr[len(fs) + 1] = 'assistant' THEN 'extension' ELSE 'broken' END AS transition FROM t WHERE nf IS NOT NULL""")
def message_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the messages of each request: some are repeated, some start anew, some lack the answer."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("f"))
    w = W.partitionBy("conv_id").orderBy("turn", "f").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = own.withColumns({"fingerprints": F.collect_list("f").over(w), "roles": F.collect_list("role").over(w)})
    k, user = F.col("conv_id") % 4, F.col("role") == "user"
    new = (k == 3) & (F.col("turn") >= 2)
    plain = at.where(user | (k == 2)).select("conv_id", (2 * F.col("turn")).alias("seq"), F.when(new, F.array(F.lit("x"), "f")).otherwise(F.col("fingerprints")).alias("fingerprints"), F.when(new, F.array(F.lit("system"), F.lit("user"))).otherwise(F.col("roles")).alias("roles"))
    again = at.where(user & (k == 1)).select("conv_id", (2 * F.col("turn") + 1).alias("seq"), "fingerprints", "roles")
    rows = plain.unionByName(again).select(F.col("conv_id").cast("string").alias("trajectory_id"), "seq", "fingerprints", "roles", (F.col("conv_id") % 8 == 1).alias("may_repeat"))
    return audit.transitions(rows)


@query("""SELECT conv_id, turn, sha256('{"role":"' || role || '","content_hash":"' || sha256(coalesce(text, '')) || '","content_chars":' || length(coalesce(text, '')) || ',"tool_call_id":null,"tool_calls":null}') AS fingerprint FROM conversations WHERE role IS NOT NULL""")
def message_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.lit(None).cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")
    return table(spark, sf_dir, "conversations").where("role IS NOT NULL").select("conv_id", "turn", chat.fingerprint(F.col("role"), F.coalesce("text", F.lit("")), F.lit(None).cast("string"), calls).alias("fingerprint"))


@query("WITH" + SCORED + """, e AS (SELECT condition_id, fold, sum(weight * (abs(point - truth) - abs(400000 - truth))) / sum(weight) AS d FROM scored GROUP BY ALL) SELECT condition_id, bool_and(d < 0) AS may_replace, count(*) AS n_seeds FROM e GROUP BY ALL""")
def may_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the forecasts beat a flat guess of 400,000 tokens in every fold; the difference stands for its interval's end."""
    error = lambda point: F.abs(point - F.col("truth"))
    ends = base.scored(spark, sf_dir).groupBy("condition_id", "fold").agg(metrics.weighted_mean(error(F.col("point")) - error(F.lit(400_000.0))).alias("ci_high"))
    return compare.may_replace(ends, ["condition_id"])


@query("WITH" + CELL + " SELECT condition_id, count(*) AS n FROM cell WHERE condition_id = '1-URGENT' GROUP BY ALL")
def one_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of one condition passes the guard; tests/test_evaluation.py has one that doesn't."""
    return validate.one_condition(points.eligible(base.cell(spark, sf_dir), condition="1-URGENT")).groupBy("condition_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id, ts) AS b, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, ts) AS c FROM events)
  SELECT user_id, count(*) AS n, count(*) FILTER (a = b AND a = c) AS agreeing FROM r GROUP BY ALL""")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ranked by time, by number and by value."""
    return audit.rank_agreement(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id", "value"])


@query("SELECT 'priority' AS name, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'clerk', CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5)::VARCHAR END, count(*) FROM orders GROUP BY ALL")
def value_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of condition, model and provider columns: an order's priority, status and a clerk made of its customer."""
    k = F.col("o_custkey") % 5
    return audit.counters(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(k > 0, k).alias("clerk")), ["priority", "status", "clerk"])


@query("SELECT problem, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 1 THEN 'not_finite' WHEN 2 THEN 'out_of_order' WHEN 3 THEN 'out_of_order' WHEN 4 THEN 'raw_in_part' WHEN 5 THEN 'not_finite' END AS problem FROM orders) WHERE problem IS NOT NULL GROUP BY ALL")
def invalid_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts made of orders, with one fault each by the remainder of their number."""
    m, one = F.col("o_orderkey") % 6, F.lit(1.0)
    rows = table(spark, sf_dir, "orders").select(
        F.when(m == 2, -1.0).otherwise(0.5).alias("lower"), F.when(m == 1, float("inf")).when(m == 3, 0.25).otherwise(one).alias("point"), F.when(m != 5, 2.0).alias("upper"), F.when(m > 3, 1.0).alias("raw_lower"), F.when(m > 3, 1.0).alias("raw_point"), F.when(m > 4, 1.0).alias("raw_upper"),
    )
    return forecast.invalid_forecasts(rows).groupBy("problem").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS b, 'n' || s_nationkey % 3 AS w FROM supplier), t AS (SELECT * FROM s WHERE s_suppkey % 2 = 1 AND w <> 'n2'), m AS (SELECT median(b) AS m FROM t), d AS (SELECT any_value(m) AS m, avg(coalesce(b, m)) AS a, stddev_pop(coalesce(b, m)) AS d FROM t, m)
  SELECT s_suppkey, round((coalesce(b, m) - a) / d, 6) AS balance, (b IS NULL)::INT::DOUBLE AS missing, (w = 'n0')::INT::DOUBLE AS n0, (w = 'n1')::INT::DOUBLE AS n1, (w = 'n2')::INT::DOUBLE AS unknown FROM s, d""")
def encoded_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances and nations, fitted on a part that lacks one of three words."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("b"), F.concat(F.lit("n"), F.col("s_nationkey") % 3).alias("w"))
    fitted = forecast.fit_encoding(own.where("s_suppkey % 2 = 1 AND w <> 'n2'"), ["b"], ["w"])
    out = forecast.encoded(own, fitted, ["b"], ["w"])
    return rounded(out.select("s_suppkey", *(F.get("encoded", F.lit(i)).alias(n) for i, n in enumerate(("balance", "missing", "n0", "n1", "unknown")))))


@query("SELECT o_orderkey, (o_orderkey % 9)::INT::BIGINT AS run, 'task-' || o_custkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'completion' ELSE 'report.final' END AS kind FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of orders; every fifth is no path of a run."""
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 5 > 0, "s3://b/x/run_").otherwise("s3://b/x/log_"), k % 9, F.lit("/task-"), F.col("o_custkey"), F.lit("/"), F.when(k % 2 == 0, "completion").otherwise("report.final"), F.lit(".json"))
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in external.path_parts(path).items())))
