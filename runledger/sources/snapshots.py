"""Completion snapshots: one JSON file a model call, which repeats all messages before it, as canonical events.

The tree is ``<root>/.../<run>/llm_completions/<task>/<provider>__<model>-<timestamp>.json`` with, for each run, a task
log ``<run>/output.jsonl`` and evaluator reports ``<run>/eval_outputs/<task>/report.json``.

Messages are only read once, to hash them. Each snapshot then carries the chain of its hashes to the end, h(i) = sha256(h(i - 1),
hash of message i), so that "the messages before are a prefix of these" is one comparison of two hashes, however long
a conversation grows, and no text is shuffled. A task that breaks a rule gives no events and is listed with its
problems; a task without a log ends as ``logging_incomplete``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions.usage import parsed
from runledger.operators.validate import listed
from runledger.sources.chat import fingerprint
from runledger.sources.mapping import _payload

_CALL = "STRUCT<id: STRING, function: STRUCT<name: STRING, arguments: STRING>>"
_SNAPSHOT = (
    f"timestamp DOUBLE, messages ARRAY<STRUCT<role: STRING, content: VARIANT, tool_call_id: STRING, name: STRING, tool_calls: ARRAY<{_CALL}>>>, kwargs STRUCT<tools: VARIANT>, "
    f"response STRUCT<id: STRING, created: BIGINT, model: STRING, usage: VARIANT, choices: ARRAY<STRUCT<message: STRUCT<content: VARIANT, tool_calls: ARRAY<{_CALL}>>, provider_specific_fields: VARIANT>>>"
)
_LOG = (
    "instance_id STRING, error STRING, metadata STRUCT<max_iterations: BIGINT>, history ARRAY<STRUCT<action: STRING>>, "
    "metrics STRUCT<accumulated_token_usage: VARIANT, token_usages: ARRAY<STRUCT<response_id: STRING, prompt_tokens: BIGINT, completion_tokens: BIGINT>>>"
)
#: The fields of a task's report and the groups of its tests.
REPORT_FLAGS = ("patch_is_None", "patch_exists", "patch_successfully_applied", "resolved")
TEST_GROUPS = ("FAIL_TO_PASS", "PASS_TO_PASS", "FAIL_TO_FAIL", "PASS_TO_FAIL")
_TESTS = ", ".join(f"{g}: STRUCT<success: ARRAY<STRING>, failure: ARRAY<STRING>>" for g in TEST_GROUPS)
_REPORT = f"MAP<STRING, STRUCT<{', '.join(f'{c}: BOOLEAN' for c in REPORT_FLAGS)}, tests_status: STRUCT<{_TESTS}>>>"
_KEY = ("run", "task")


def _files(spark: SparkSession, root: str, names: str, whole: bool) -> DataFrame:
    """(value, file) of the files below root with such names; none is no error."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    try:
        return read.text(root, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string, file string")


def _part(file: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.url_decode(F.regexp_extract(file, pattern, group)), F.lit(""))


def plain(content: Column) -> Column:
    """A content's text: a string itself, the texts of a list's parts in a row, else its JSON."""
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(texts, F.try_variant_get(content, "$", "string"), F.to_json(content), F.lit(""))


def chained(hashes: Column) -> Column:
    """The chain over an array of hashes; of an empty one the empty text."""
    return F.aggregate(hashes, F.lit(""), lambda chain, x: F.sha2(F.concat(chain, x), 256))


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row a completion file: its place, times, response and messages as hashes. No text is left."""
    pattern = r"/([^/]+)/llm_completions/([^/]+)/([^/]+?)__(.+)-(\d+(?:\.\d+)?)\.json$"
    files = _files(spark, root, "*.json", True).where(F.col("file").contains("/llm_completions/"))
    at = files.select("file", F.from_json("value", _SNAPSHOT).alias("s"))
    names = {"run": 1, "task": 2, "provider": 3, "model": 4}
    own = lambda role, content, result, calls: fingerprint(role, plain(content), result, calls)
    messages = F.transform("s.messages", lambda m: F.struct(
        m["role"].alias("role"), own(m["role"], m["content"], m["tool_call_id"], m["tool_calls"]).alias("hash"), m["tool_call_id"].alias("id"), m["name"].alias("name"), F.char_length(plain(m["content"])).alias("chars"),
    ))
    answer = F.get("s.response.choices", F.lit(0))
    calls = F.coalesce(answer["message"]["tool_calls"], F.array().cast(f"array<{_CALL}>"))
    calls_or_null = F.when(F.size(calls) > 0, calls)
    return at.select(
        "file", *(_part(F.col("file"), pattern, i).alias(n) for n, i in names.items()), _part(F.col("file"), pattern, 5).cast("double").alias("named_at"),
        F.col("s.timestamp").alias("logged_at"), F.col("s.response.created").alias("created"), F.col("s.response.id").alias("response_id"), F.col("s.response.model").alias("resolved_model"),
        F.col("s.response.usage").alias("usage"), F.sha2(F.coalesce(F.to_json("s.kwargs.tools"), F.lit("")), 256).alias("tools_hash"),
        F.coalesce(F.try_variant_get(answer["provider_specific_fields"], "$.error", "variant").isNotNull(), F.lit(False)).alias("failed"),
        F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"))).alias("calls"),
        own(F.lit("assistant"), answer["message"]["content"], F.lit(None).cast("string"), calls_or_null).alias("answer"), messages.alias("messages"),
    ).withColumn("chain", chained(F.transform("messages", lambda m: m["hash"])))


def transitions(snaps: DataFrame) -> DataFrame:
    """snapshots in order with ``k`` and how each follows from the one before: ``kind`` (first, extension, unanswered,
    repeat, reset, broken), ``tools`` (results of that one's calls) and ``faults``."""
    w = W.partitionBy(*_KEY).orderBy("named_at", "logged_at", "created", "file")
    at = snaps.withColumn("before", F.lag(F.struct(F.size("messages").alias("n"), "chain", "answer", "calls", "failed")).over(w)).withColumn("k", F.row_number().over(w).cast("long") - 1)
    ranks = [F.row_number().over(W.partitionBy(*_KEY).orderBy(F.col(c).asc_nulls_last(), "named_at", "file")) - 1 for c in ("logged_at", "created")]
    at = at.withColumn("in_order", (ranks[0] == F.col("k")) & (ranks[1] == F.col("k")))
    n, m, first = F.size("messages"), F.col("before.n"), F.col("before").isNull()
    hashes = F.transform("messages", lambda x: x["hash"])
    extends = (n > m) & (chained(F.slice(hashes, F.lit(1), F.greatest(m, F.lit(0)))) == F.col("before.chain"))
    same = (n == m) & (F.col("chain") == F.col("before.chain"))
    new = F.slice("messages", F.greatest(m, F.lit(0)) + 1, F.greatest(n - m, F.lit(0)))
    roles = F.transform("messages", lambda x: x["role"])
    kind = (
        F.when(first, "first").when(same & (F.col("before.failed") | ((F.size("before.calls") > 0) & (F.size("calls") > 0))), "repeat")
        .when((roles == F.array(F.lit("system"), F.lit("user"))) & ~extends, "reset").when(~extends, "broken")
        .when((F.size(new) == 1) & (new[0]["role"] == "user"), "unanswered").when(new[0]["role"] == "assistant", "extension").otherwise("broken")
    )
    at = at.withColumn("kind", F.coalesce(kind, F.lit("broken"))).withColumn("new", F.when(F.col("kind") == "extension", new))
    rest = F.slice("new", 2, F.greatest(F.size("new") - 1, F.lit(0)))
    tools = F.transform(F.filter(rest, lambda x: x["role"] == "tool"), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    at = at.withColumn("tools", F.coalesce(tools, F.array().cast("array<struct<id:string,name:string>>")))
    extension = F.col("kind") == "extension"
    faults = listed({
        "not_json": F.col("messages").isNull(), "file_name": F.col("named_at").isNull(), "no_response": F.col("response_id").isNull() | F.col("resolved_model").isNull(), "bad_usage": F.size(F.array_except(parsed(F.col("usage"))["problems"], F.array(F.lit("reasoning_exceeds_output")))) > 0,
        "order_differs": ~F.col("in_order"), "messages_broken": F.col("kind") == "broken", "answer_differs": extension & (F.col("new")[0]["hash"] != F.col("before.answer")),
        "unknown_role": extension & F.exists(rest, lambda x: F.coalesce(~x["role"].isin("tool", "user"), F.lit(True))),
        "tool_results_differ": extension & ((F.array_sort("tools") != F.array_sort("before.calls")) | (F.size(F.array_distinct("tools")) != F.size("tools"))),
    })
    return at.withColumn("faults", faults).drop("new", "in_order")


def task_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row a line of the task logs: how a task ended, its usage and the ledger of its responses."""
    lines = _files(spark, root, "output.jsonl", False).where(F.trim("value") != "")
    at = lines.select(_part(F.col("file"), r"/([^/]+)/output\.jsonl$", 1).alias("run"), F.from_json("value", _LOG).alias("l"))
    usage = parsed(F.col("l.metrics.accumulated_token_usage"))
    finished = F.exists(F.coalesce("l.history", F.array().cast("array<struct<action:string>>")), lambda h: F.coalesce(h["action"] == "finish", F.lit(False)))
    return at.select("run", F.col("l.instance_id").alias("task"), "l.error", finished.alias("finished"), F.col("l.metadata.max_iterations").alias("max_steps"), usage["input_tokens"].alias("log_in"), usage["output_tokens"].alias("log_out"), F.col("l.metrics.token_usages").alias("ledger"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """One row an evaluator report: its flags, the number of tests passed and failed, and its problems."""
    files = _files(spark, root, "report.json", True)
    pattern = r"/([^/]+)/eval_outputs/([^/]+)/report\.json$"
    at = files.select(*(_part(F.col("file"), pattern, i + 1).alias(c) for i, c in enumerate(_KEY)), F.from_json("value", _REPORT).alias("r"))
    one = at.withColumn("e", F.element_at(F.map_values("r"), 1))
    count = lambda what: sum((F.coalesce(F.size(F.col(f"e.tests_status.{g}.{what}")), F.lit(0)) for g in TEST_GROUPS), F.lit(0)).cast("long")
    shown = F.lit(False)
    for c in REPORT_FLAGS:
        shown = shown | F.col(f"e.{c}").isNull()
    wrong = listed({"not_of_its_task": F.col("r").isNull() | (F.map_keys("r") != F.array("task")), "flags": shown, "tests": F.col("e.tests_status").isNull()})
    return one.select(*_KEY, *(F.col(f"e.{c}").alias(c) for c in REPORT_FLAGS), count("success").alias("tests_passed"), count("failure").alias("tests_failed"), wrong.alias("problems"))


def ledger(snaps: DataFrame, logs: DataFrame) -> DataFrame:
    """Completions against the task logs' ledgers, a row a task: agreeing, disagreeing, extra (no ledger entry), missing
    (no completion), repeated ids, and the usage of the extra ones (null where a count is unknown)."""
    use = parsed(F.col("usage"))
    one = snaps.select(*_KEY, "response_id", use["input_tokens"].alias("a_in"), use["output_tokens"].alias("a_out"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(None).cast("long").alias("b_in"), F.lit(None).cast("long").alias("b_out"))
    two = logs.select(*_KEY, F.explode("ledger").alias("x")).select(*_KEY, "x.response_id", *(F.lit(None).cast("long").alias(c) for c in ("a_in", "a_out")), F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("x.prompt_tokens").alias("b_in"), F.col("x.completion_tokens").alias("b_out"))
    by_id = one.unionByName(two).groupBy(*_KEY, "response_id").agg(*(F.sum(c).alias(c) for c in ("a", "b", "a_in", "a_out", "b_in", "b_out")))
    both, extra = (F.col("a") > 0) & (F.col("b") > 0), F.col("b") == 0
    same = F.col("a_in").eqNullSafe(F.col("b_in")) & F.col("a_out").eqNullSafe(F.col("b_out"))
    unknown = F.count_if(extra & (F.col("a_in").isNull() | F.col("a_out").isNull())) > 0
    total = lambda c: F.when(~unknown, F.coalesce(F.sum(F.when(extra, F.col(c))), F.lit(0)))
    return by_id.groupBy(*_KEY).agg(
        F.count_if(both & same).alias("agreeing"), F.count_if(both & ~same & (F.col("a") == 1) & (F.col("b") == 1)).alias("disagreeing"), F.count_if(extra).alias("extra"), F.count_if(F.col("a") == 0).alias("missing"),
        F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"), total("a_in").alias("extra_in"), total("a_out").alias("extra_out"),
    )


def events(spark: SparkSession, root: str, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(canonical events of the tasks that break no rule, (run, task, problem) of the others).

    ``keep`` may write a table that several branches read.
    """
    at = keep(transitions(snapshots(spark, root)), "snapshots")
    logs = keep(task_logs(spark, root), "task-logs")
    said = reports(spark, root)
    used = parsed(F.col("usage"))
    sums = at.groupBy(*_KEY).agg(
        F.count("*").alias("calls"), F.count_distinct("tools_hash", "provider", "model", "resolved_model").alias("settings"), F.first("model").alias("model_id"), F.max_by("kind", "k").alias("last_kind"),
        F.count_if(used["input_tokens"].isNull() | used["output_tokens"].isNull()).alias("unknown"), F.sum(used["input_tokens"]).alias("own_in"), F.sum(used["output_tokens"]).alias("own_out"), F.first("tools_hash").alias("tools_hash"), F.first("provider").alias("provider"),
    )
    books = ledger(at, logs)
    counted = logs.groupBy(*_KEY).agg(F.count("*").alias("lines"), *(F.first(c).alias(c) for c in ("error", "finished", "max_steps", "log_in", "log_out")))
    tasks = sums.join(counted, list(_KEY), "full_outer").join(books, list(_KEY), "left").join(said.select(*_KEY, F.lit(True).alias("reported"), F.col("problems").alias("report_problems")), list(_KEY), "full_outer")
    logged_runs = logs.select("run").distinct().withColumn("logged", F.lit(True))
    tasks = keep(tasks.join(logged_runs, "run", "left"), "tasks")
    rules = listed({
        "settings_change": F.col("settings") > 1, "log_line_repeated": F.col("lines") > 1, "ledger_differs": F.col("disagreeing") > 0, "response_repeated": F.col("repeated") > 0,
        "completion_without_log": F.col("logged") & F.col("lines").isNull() & F.col("calls").isNotNull(), "report_alone": F.col("reported") & F.col("lines").isNull() & F.col("calls").isNull(), "log_without_task": F.col("task").isNull(),
    })
    of_task = tasks.select(*_KEY, F.explode(F.concat(rules, F.coalesce(F.transform("report_problems", lambda p: F.concat(F.lit("report_"), p)), F.array().cast("array<string>")))).alias("problem"))
    bad = of_task.unionByName(at.select(*_KEY, F.explode("faults").alias("problem"))).distinct()

    name = F.concat(F.lit("snapshots:"), F.substring(F.sha2(F.concat_ws("\x1f", *_KEY), 256), 1, 32))
    gone = bad.select(*_KEY).distinct()
    fair = tasks.join(gone, list(_KEY), "left_anti").withColumn("trajectory_id", name)
    calls = at.join(gone, list(_KEY), "left_anti").withColumn("trajectory_id", name)
    none = F.lit(None).cast("string")
    event = lambda step, kind, payload, call=none, attempt=none: F.struct(F.lit(step).alias("step"), (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), call.alias("logical_call_id"), attempt.alias("attempt_id"), payload.alias("payload"))
    call_of = lambda k: F.concat_ws(":", "trajectory_id", F.lit("call"), k)
    this, attempt = call_of(F.col("k")), F.concat(call_of(F.col("k")), F.lit(":attempt:0"))
    usage = F.when(F.col("usage").isNotNull(), F.struct(*(used[f"{c}_tokens"].alias(f"{c}_tokens") for c in ("input", "output", "total"))))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda acc, m: acc + m["chars"])
    fan = F.concat(
        F.transform("tools", lambda t: event(0, "tool_completed", _payload(tool_name=t["name"]), call_of(F.col("k") - 1))),
        F.array(
            event(1, "request_built", _payload(request_message_count=F.size("messages"), request_content_chars=chars, model_id=F.col("model")), this), event(2, "api_attempt_started", _payload(), this, attempt),
            event(3, "api_completed", _payload(usage=usage, model_id=F.col("resolved_model")), this, attempt),
        ),
    )
    rows = calls.select("trajectory_id", "k", "file", F.posexplode(fan).alias("place", "e"))
    whole = F.col("log_in").isNotNull() & F.col("log_out").isNotNull()
    closing = F.when(whole, F.col("log_in") + F.coalesce("extra_in", F.when(F.col("extra").isNull(), 0))).when(F.col("unknown") == 0, F.col("own_in"))
    closing_out = F.when(whole, F.col("log_out") + F.coalesce("extra_out", F.when(F.col("extra").isNull(), 0))).when(F.col("unknown") == 0, F.col("own_out"))
    final = F.struct(closing.alias("input_tokens"), closing_out.alias("output_tokens"), (closing + closing_out).alias("total_tokens"))
    ended = F.coalesce("finished", F.lit(False))
    reason = F.when(F.col("error").isNotNull(), "task_error").otherwise("logging_incomplete")
    setting = F.concat(F.lit("condition:"), F.substring(F.sha2(F.concat_ws("\x1f", "model_id", "tools_hash", "provider"), 256), 1, 20))
    start = fair.select("trajectory_id", F.lit(-1).cast("long").alias("k"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("place"), event(0, "task_started", _payload(task_id=F.col("task"), run_id=F.col("run"), condition_id=setting, model_id=F.col("model_id"), max_steps=F.col("max_steps"))).alias("e"))
    end = fair.select("trajectory_id", F.lit(1 << 40).cast("long").alias("k"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("place"), event(0, F.when(ended, "task_finished").otherwise("task_aborted"), _payload(usage=final, outcome=F.when(ended, "finished").when(F.col("error").isNotNull(), "error").otherwise("unknown"), reason=F.when(~ended, reason))).alias("e"))
    everything = rows.unionByName(start).unionByName(end)
    seq = F.row_number().over(W.partitionBy("trajectory_id").orderBy("k", "place")).cast("long") - 1
    return everything.withColumn("event_seq", seq).select(
        F.lit(1).cast("long").alias("schema_version"), F.concat_ws(":event:", "trajectory_id", "event_seq").alias("event_id"), "trajectory_id", "event_seq", "e.event_type",
        F.timestamp_micros(F.lit(946_684_800_000_000) + F.col("event_seq")).alias("occurred_at"), "e.logical_call_id", "e.attempt_id", F.col("file").alias("raw_ref"), "e.payload",
    ), bad
