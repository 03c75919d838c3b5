"""Readers of other logs and tables: turn logs, wide aggregates with task metadata, manifests, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.audit import fingerprint


def turns(spark: SparkSession, path: str) -> DataFrame:
    """One row a turn log (a JSONL file): type counts, usage of the completed turn, how the run ends.

    A file with a broken line or with several completed turns fails the query.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    strict = F.coalesce(v.isNotNull() & F.trim("value").startswith("{"), F.lit(False))
    field = lambda name: F.try_variant_get(v, f"$.usage.{name}", "long").alias(name)
    names = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
    read = lines.select("file", F.when(strict, F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("broken line in "), "file")).cast("string")).alias("type"), *map(field, names))
    by_type = read.groupBy("file", "type").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("type") == "turn.completed", F.col(c))).alias(c) for c in names))
    out = by_type.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("event_type_counts"), F.coalesce(F.sum(F.when(F.col("type") == "turn.completed", F.col("n"))), F.lit(0)).alias("completed"), *(F.max(c).alias(c) for c in names))
    done = F.when(F.col("completed") > 1, F.raise_error(F.concat(F.lit("several completed turns in "), "file")).cast("string")).when(F.col("completed") == 1, "task_finished").otherwise("task_aborted")
    return out.withColumn("terminal", done).withColumn("reason", F.when(F.col("terminal") == "task_aborted", "logging_incomplete").otherwise("turn_completed")).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).drop("completed")


def task_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, repo, problem_statement, difficulty); a repeated id fails the query."""
    own = spark.read.parquet(path).select("instance_id", "repo", "problem_statement", "difficulty")
    twice = own.groupBy("instance_id").agg(F.count("*").alias("_n"))
    return own.join(twice, "instance_id").withColumn("instance_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated task "), "instance_id")).cast("string")).otherwise(F.col("instance_id"))).drop("_n")


def aggregates(spark: SparkSession, path: str, model: str, metadata: DataFrame) -> DataFrame:
    """One launch row a problem from a wide CSV of mean usage, for one model: half-even rounded label, outside
    estimate, text shape of the statement. A problem without metadata fails the query."""
    from runledger.functions.text import shape

    number = lambda c: F.expr(f"try_cast(`{model}_{c}` AS DOUBLE)")
    rows = spark.read.option("header", True).csv(path).select("problem_id", (number("gt_input_token_avg") + number("gt_output_token_avg")).alias("mean"), (number("predicted_avg_input") + number("predicted_avg_output")).alias("estimate"))
    at = rows.join(metadata.withColumn("_found", F.lit(True)), rows["problem_id"] == metadata["instance_id"], "left")
    key = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no metadata for "), "problem_id")).cast("string")).otherwise(F.col("problem_id"))
    return at.select(key.alias("task_id"), "repo", "difficulty", F.bround("mean").cast("long").alias("label_value"), F.when(F.col("mean").isNull(), "missing").otherwise("observed").alias("label_status"), F.col("estimate"), *(c.alias(f"statement_{n}") for n, c in shape(F.col("problem_statement")).items()))


def manifest_problems(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Files that differ from the manifest (path, bytes, sha256) either way: (path below root, problem); empty if all match."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.expr(f"substring(path, {len(top) + 2})").alias("path"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha"))
    both = manifest.select("path", "bytes", "sha256").join(files, "path", "full_outer")
    problem = F.when(F.col("found_sha").isNull(), "missing").when(F.col("sha256").isNull(), "not_listed").when(F.col("bytes") != F.col("found_bytes"), "size_differs").when(F.col("sha256") != F.col("found_sha"), "content_differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def publish(df: DataFrame, path: str) -> None:
    """Write a table with its fingerprint beside it; an existing one is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    spark = df.sparkSession
    fingerprint(spark.read.parquet(f"{path}/data"), sorted(df.columns)).write.mode("errorifexists").json(f"{path}/fingerprint")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """A published table; ValueError if its rows aren't those that were published."""
    df = spark.read.parquet(f"{path}/data")
    said = spark.read.json(f"{path}/fingerprint")
    now = fingerprint(df, sorted(df.columns))
    if now.select(*sorted(now.columns)).exceptAll(said.select(*sorted(now.columns))).count():
        raise ValueError(f"{path} has changed since it was published")
    return df


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines {path, bytes, sha256} as a table; a line that breaks a rule, or a path that is listed
    twice, fails the query."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", "path STRING, bytes BIGINT, sha256 STRING").alias("r")).select("value", "r.*")
    good = F.coalesce((F.trim("path") != "") & ~F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|$)") & (F.col("bytes") >= 0) & F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    twice = rows.groupBy("path").agg(F.count("*").alias("_n"))
    at = rows.withColumn("_good", good).join(twice, "path", "left")
    checked = F.when(~F.col("_good"), F.raise_error(F.concat(F.lit("bad line in the manifest: "), "value")).cast("string")).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), "path")).cast("string")).otherwise(F.col("path"))
    return at.select(checked.alias("path"), "bytes", "sha256")


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, instance_id, repo, difficulty) of a JSON file {count, tasks: [...]}; another number of tasks than it says,
    or ids that don't grow, fail the query."""
    schema = "count BIGINT, tasks ARRAY<STRUCT<instance_id: STRING, repo: STRING, difficulty: STRING>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f"))
    right = F.coalesce(F.col("f.count") == F.size("f.tasks"), F.lit(False))
    ids = F.transform("f.tasks", lambda t: t["instance_id"])
    sorted_ = ids == F.array_sort(F.array_distinct(ids))
    tasks = F.when(~right, F.raise_error(F.lit("the declared count differs")).cast("array<struct<instance_id:string,repo:string,difficulty:string>>")).when(~sorted_, F.raise_error(F.lit("ids repeat or aren't sorted")).cast("array<struct<instance_id:string,repo:string,difficulty:string>>")).otherwise(F.col("f.tasks"))
    return whole.select(F.posexplode(tasks).alias("place", "t")).select("place", "t.*")


def path_parts(path: Column, pattern: str = r"(?:^|/)run_(\d+)/([^/]+)/([^/]+?)(?:\.[^./]+)?$") -> dict[str, Column]:
    """Run, task and kind of a file by its path; null where the path is no such one."""
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return {"run": part(1).cast("int"), "task": part(2), "kind": part(3)}


def write_predictions(forecasts: DataFrame, path: str, by: tuple[str, ...] = ("candidate_id", "split_seed")) -> None:
    """Prediction records, a folder for each candidate and seed; an existing path is an error."""
    forecasts.write.mode("errorifexists").partitionBy(*by).json(path)
