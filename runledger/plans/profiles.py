"""Queries on audits, texts and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions import text
from runledger.operators import audit, retrieval, splits
from runledger.plans import base
from runledger.plans.base import ATTEMPTS, FOLDS, LABELS, SALT, rounded
from runledger.sources import mapping
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


@query("WITH" + ATTEMPTS + """, a AS (SELECT trajectory_id, count(*) AS attempts, count(DISTINCT call_no) AS calls, count(*) FILTER (NOT dangling) AS tools, count(*) FILTER (NOT dangling AND tool_failed) AS failed_tools, count(*) FILTER (NOT dangling AND known) AS known_usage, count(*) FILTER (NOT dangling AND NOT known) AS missing_usage, count(*) FILTER (dangling) AS open_attempts FROM att GROUP BY ALL)
  SELECT o_orderkey::VARCHAR AS trajectory_id, 2 + coalesce(calls + 3 * attempts - 2 * open_attempts, 0) AS events, coalesce(calls, 0) AS calls, coalesce(attempts, 0) AS attempts, coalesce(attempts - calls, 0) AS retries, coalesce(tools, 0) AS tools, coalesce(failed_tools, 0) AS failed_tools, coalesce(known_usage, 0) AS known_usage, coalesce(missing_usage, 0) AS missing_usage, coalesce(open_attempts, 0) AS open_attempts FROM orders LEFT JOIN a ON trajectory_id = o_orderkey::VARCHAR""")
def trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.trajectory_metrics(mapping.events(spark, sf_dir))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(table(spark, sf_dir, "events"), "user_id", "event_type", ("click", "error", "purchase", "signup", "view"))


_POSITIONS = "SELECT CASE WHEN ordinal = 1 THEN 'task_pre' ELSE 'task_update' END AS position, 'task_provider_accounted_remaining' AS target, rest_status AS label_status FROM labels0 UNION ALL SELECT CASE WHEN ordinal = 1 THEN 'task_pre' ELSE 'task_update' END, 'task_unknown_remaining', unk_status FROM labels0"


@query("WITH" + LABELS + f", r AS ({_POSITIONS}), g AS (SELECT * FROM (SELECT unnest(['task_pre', 'task_update']) AS position), (SELECT unnest(['task_provider_accounted_remaining', 'task_unknown_remaining']) AS target), (SELECT unnest(['observed', 'censored', 'missing', 'invalid']) AS label_status)) SELECT position, target, label_status, count(r.target) AS n FROM g LEFT JOIN r USING (position, target, label_status) GROUP BY ALL")
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_matrix(base.all_rows(spark, sf_dir, history=False), ("task_pre", "task_update"), ("task_provider_accounted_remaining", "task_unknown_remaining"), ("observed", "censored", "missing", "invalid"))


@query("WITH" + LABELS + f", r AS ({_POSITIONS}) SELECT position, target, count(*) AS n, count(*) FILTER (label_status = 'observed') AS observed, count(*) FILTER (label_status = 'missing') AS missing, count(*) FILTER (label_status = 'censored') AS censored, count(*) FILTER (label_status = 'invalid') AS invalid FROM r GROUP BY CUBE (position, target)")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_totals(base.all_rows(spark, sf_dir, history=False).where("position <> 'call_pre'"))


@query("WITH" + ATTEMPTS + " SELECT trajectory_id, count(*) AS attempts, count(*) FILTER (known) AS known, CASE WHEN bool_and(known) THEN sum(i0)::BIGINT END AS input_tokens, CASE WHEN bool_and(known) THEN sum(o0)::BIGINT END AS output_tokens, CASE WHEN bool_and(known) THEN 'closed' WHEN NOT bool_or(known) THEN 'none' ELSE 'missing' END AS closure FROM att GROUP BY ALL")
def usage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.usage_closure(mapping.attempts(spark, sf_dir))


@query("SELECT count(n_chars) AS n, quantile_disc(n_chars, 0.25) AS p25, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99 FROM documents")
def size_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}))


@query("WITH g AS (SELECT sha256(text) AS h, strlen(text) AS size, count(*) AS copies, count(DISTINCT source) AS owners FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(copies), 0)::BIGINT AS copies, coalesce(sum(copies - 1), 0)::BIGINT AS extra_copies, coalesce(sum((copies - 1) * size), 0)::BIGINT AS extra_bytes, count(*) FILTER (owners = 1) AS within_one, count(*) FILTER (owners > 1) AS across FROM g")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.duplicates(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text"), "source", F.octet_length("text")))


@query("WITH h AS (SELECT md5(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderstatus, chr(0)))) AS h FROM orders) SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS h0, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS h1, sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS h2, sum(('0x' || substr(h, 25, 8))::BIGINT)::BIGINT AS h3 FROM h")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS \"both\", count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def label_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY ALL) GROUP BY ALL")
def runs_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.count_of_counts(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, max(strlen(text))::BIGINT AS largest FROM documents GROUP BY ROLLUP (source)")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.inventory(table(spark, sf_dir, "documents"), "source", F.octet_length("text").cast("long")))


@query("SELECT o_custkey, sha256('sample' || chr(0) || o_custkey::VARCHAR) AS h FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY h LIMIT 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bottom_k(table(spark, sf_dir, "orders"), "o_custkey", "sample", 50)


@query("WITH" + ATTEMPTS + " SELECT 'input_tokens' AS field, count(*) FILTER (known) AS known, sum(i0) FILTER (known)::BIGINT AS tokens FROM att UNION ALL SELECT 'output_tokens', count(*) FILTER (known), sum(o0) FILTER (known)::BIGINT FROM att UNION ALL SELECT 'total_tokens', count(*) FILTER (known), sum(i0 + o0 + off::INT) FILTER (known)::BIGINT FROM att")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.token_coverage(mapping.attempts(spark, sf_dir), ("input_tokens", "output_tokens", "total_tokens"))


@query("SELECT o_orderpriority AS condition_id, count(*) AS runs, count(DISTINCT o_custkey) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY ALL")
def condition_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.runs(spark, sf_dir).groupBy("condition_id").agg(F.count("*").alias("runs"), F.count_distinct("task_id").alias("tasks"), F.count_if(F.col("terminal") == "task_finished").alias("finished"))


@query("WITH" + ATTEMPTS + " SELECT trajectory_id, count(*) AS attempts FROM att GROUP BY ALL ORDER BY attempts DESC, trajectory_id LIMIT 20")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.attempts(spark, sf_dir).groupBy("trajectory_id").agg(F.count("*").alias("attempts")).orderBy(F.desc("attempts"), "trajectory_id").limit(20)


@query("WITH" + ATTEMPTS + " SELECT trajectory_id, 'call-' || call_no AS logical_call_id, 'attempt-' || attempt_no AS attempt_id FROM att WHERE dangling")
def open_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = mapping.events(spark, sf_dir)
    keys = ["trajectory_id", "logical_call_id", "attempt_id"]
    return events.where("event_type = 'api_attempt_started'").select(*keys).join(events.where("event_type IN ('api_completed', 'api_failed')").select(*keys), keys, "left_anti")


@query("""WITH s AS (SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS b, s_nationkey FROM supplier), m AS (SELECT median(b) AS m FROM s)
  SELECT 'balance' AS "column", round(any_value(m), 6) AS median, round(avg(coalesce(b, m)), 6) AS mean, round(stddev_pop(coalesce(b, m)), 6) AS deviation, NULL::VARCHAR AS words FROM s, m UNION ALL SELECT 'nation', NULL, NULL, NULL, (SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT s_nationkey::VARCHAR AS w FROM s))""")
def encoder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances, every fourth of them null, and nations as words."""
    own = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    out = audit.encoder_statistics(own, ["balance"], ["nation"])
    return rounded(out.select("column", "median", "mean", "deviation", F.array_join("vocabulary", "|").alias("words")))


@query(r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines, len(regexp_extract_all(text, '```')) // 2 AS fences, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = text.content_summary(F.col("text"))
    return rounded(table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in text.shape(F.col("text")).items()), summary["sha256"].alias("sha256"), summary["bytes"].alias("bytes")))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.(?:png|jpe?g|gif|svg)(?:\\?|$)') THEN 'image' WHEN regexp_matches(url, '/(?:en|de|fr|es)/') THEN 'article-' || regexp_extract(url, '/(en|de|fr|es)/', 1) WHEN regexp_matches(url, '[?&]page=') THEN 'listing' ELSE 'other' END AS kind FROM pages")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_class(F.col("url")).alias("kind"))


@query("SELECT count(*) AS events, count(DISTINCT json_structure(props)::VARCHAR) AS shapes FROM events")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(text.json_shape(F.col("props")).alias("shape")).agg(F.count("*").alias("events"), F.count_distinct("shape").alias("shapes"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(text.strict_json(F.col("props")), "$.k", "long").alias("k"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"api_key":"[REDACTED]","n":' || doc_id || '}' WHEN 1 THEN '{"a":{"Client-Secret":"[REDACTED]"},"b":"Bearer [REDACTED]"}' WHEN 2 THEN '{"token":"[REDACTED]","tokens":' || doc_id || '}' ELSE regexp_replace(replace(text, 'bearer', 'b_'), 'sk-', 'Bearer [REDACTED]', 'g') END AS text FROM documents WHERE text IS NOT NULL""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and JSON texts with secrets as strings, nested numbers, objects and lists, and bearer credentials."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    plain = F.regexp_replace(F.replace("text", F.lit("bearer"), F.lit("b_")), "sk-", "Bearer xyz=")
    made = (
        F.when(k == 0, F.concat(F.lit('{"api_key":"s\\"'), i, F.lit('","n":'), i, F.lit("}"))).when(k == 1, F.concat(F.lit('{"a":{"Client-Secret":'), i, F.lit('},"b":"bearer a.b-c~'), i, F.lit('="}')))
        .when(k == 2, F.concat(F.lit('{"token":{"x":["]",{"y":'), i, F.lit('}]},"tokens":'), i, F.lit("}"))).otherwise(plain)
    )
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.redacted_json(made).alias("text"))


@query("SELECT doc_id, sha256('salt' || chr(0) || doc_id::VARCHAR) AS pseudonym FROM documents")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.pseudonym("salt", F.col("doc_id").cast("string")).alias("pseudonym"))


_NEAREST = r"""WITH tok AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}') AS w FROM documents UNION ALL SELECT 'q', item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}') FROM benchmark),
  c AS (SELECT side, id, term, count(*) AS tf FROM (SELECT side, id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM tok) GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c WHERE side = 'd'),
  v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM c WHERE side = 'd' GROUP BY term ORDER BY df DESC, term LIMIT 4096), n), x AS (SELECT side, id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)),
  y AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM x), p AS (SELECT a.id AS item_id, b.id AS doc_id, round(sum(a.w * b.w), 9) AS similarity FROM (FROM y WHERE side = 'q') a JOIN (FROM y WHERE side = 'd') b USING (term) GROUP BY a.id, b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM p WHERE similarity > 0 QUALIFY rank <= 5)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    # texts are cut twice, for the vocabulary and for its terms alone, as all their terms would be many times the texts
    vocab = kept(retrieval.vocabulary(retrieval.terms(texts, "doc_id", "text"), "doc_id", n=retrieval.with_terms(texts, "doc_id", "text")), "vocabulary")
    docs = retrieval.terms(texts, "doc_id", "text", vocab)
    asked = retrieval.terms(table(spark, sf_dir, "benchmark"), "item_id", "text", vocab)
    # documents and items have numbers of their own: an item has no document of the same id to leave out
    named = retrieval.vectors(docs, vocab, "doc_id").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    found = retrieval.neighbours(retrieval.vectors(asked, vocab, "item_id"), named, "item_id", "doc_id")
    return found.withColumn("doc_id", F.col("doc_id") - 1_000_000_000)


@query(_NEAREST + " SELECT item_id, doc_id, similarity, rank FROM r")
def text_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to each benchmark item; the vocabulary comes from the documents alone."""
    return rounded(_nearest(spark, sf_dir), 9)


@query(_NEAREST + """ SELECT item_id, median(n_chars) AS total_median, round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 6) AS total_iqr, median(length(source)) AS calls_median, round(avg(similarity), 6) AS mean_similarity, count(*) AS n_neighbours FROM r JOIN documents USING (doc_id) GROUP BY item_id""")
def neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each item's neighbours: their lengths as totals, the lengths of their sources' names as calls."""
    facts = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total"), F.char_length("source").alias("calls"))
    return rounded(retrieval.neighbour_features(_nearest(spark, sf_dir), facts, "item_id", "doc_id"))


@query(rf"""WITH fold AS (
    SELECT doc_id, (row_number() OVER (ORDER BY sha256('{SALT}' || chr(0) || doc_id::VARCHAR), doc_id::VARCHAR) - 1) % {FOLDS} AS fold FROM (SELECT DISTINCT doc_id FROM documents)),
  tok AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]{{2,}}') AS w FROM documents),
  c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM tok) GROUP BY ALL),
  t AS (SELECT unnest(range({FOLDS}))::INT AS test_fold),
  role AS (SELECT doc_id, test_fold, (fold - test_fold + {FOLDS}) % {FOLDS} >= 3 AND n_chars IS NOT NULL AS train FROM fold JOIN documents USING (doc_id), t),
  n AS (SELECT test_fold, count(*) FILTER (train) AS n FROM role GROUP BY test_fold),
  v AS (
    SELECT test_fold, term, ln((1 + n) / (1 + df)) + 1 AS idf
    FROM (SELECT test_fold, term, count(*) AS df FROM c JOIN role USING (doc_id) WHERE train GROUP BY test_fold, term
      QUALIFY row_number() OVER (PARTITION BY test_fold ORDER BY count(*) DESC, term) <= 4096) JOIN n USING (test_fold)),
  x AS (SELECT test_fold, doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)),
  y AS (SELECT test_fold, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY test_fold, doc_id)) AS w, train FROM x JOIN role USING (test_fold, doc_id)),
  p AS (
    SELECT a.test_fold, a.doc_id, b.doc_id AS other, round(sum(a.w * b.w), 9) AS similarity
    FROM y a JOIN y b ON a.test_fold = b.test_fold AND a.term = b.term AND b.train AND a.doc_id <> b.doc_id GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY test_fold, doc_id ORDER BY similarity DESC, other) AS rank FROM p WHERE similarity > 0 QUALIFY rank <= 5),
  g AS (
    SELECT r.doc_id, test_fold, median(n_chars) AS total_median, round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 6) AS total_iqr,
      median(length(source)) AS calls_median, round(avg(similarity), 6) AS mean_similarity, count(*) AS n_neighbours
    FROM r JOIN documents d ON d.doc_id = r.other GROUP BY ALL)
  SELECT doc_id, test_fold::BIGINT AS test_fold, total_median, total_iqr, calls_median, mean_similarity, coalesce(n_neighbours, 0) AS n_neighbours
  FROM role LEFT JOIN g USING (doc_id, test_fold)""")
def fold_neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold's training side knows of every document's neighbours: vocabulary and idf are fitted on the training
    documents alone, and no document is its own neighbour. Totals and calls are those of ``neighbour_features``."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.select(F.col("doc_id").alias("neighbour_id"), F.col("n_chars").alias("total"), F.char_length("source").alias("calls"))
    named = docs.select(F.col("doc_id").cast("string").alias("task_id"))
    folds = kept(splits.ranked_folds(named, SALT, FOLDS).select(F.col("task_id").cast("long").alias("task_id"), "fold"), "folds")
    learned = kept(folds.join(docs.where("n_chars IS NOT NULL").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi"), "learned")
    counted = kept(retrieval.terms(docs.withColumnRenamed("doc_id", "task_id"), "task_id", "text"), "terms")
    found = retrieval.fold_neighbours(counted, learned, FOLDS)
    known = retrieval.neighbour_features(found, facts, "task_id", "neighbour_id", ("test_fold",))
    all_folds = folds.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("test_fold"))
    return rounded(all_folds.join(known, ["task_id", "test_fold"], "left").fillna(0, ["n_neighbours"]).withColumnRenamed("task_id", "doc_id"))
