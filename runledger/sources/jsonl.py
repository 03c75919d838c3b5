"""Canonical JSONL: a strict scan with quarantine, a sink that overwrites nothing, append with rejection, ordered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger import schema
from runledger.functions.text import redacted_json
from runledger.functions.usage import parsed
from runledger.operators.validate import row_problems

FIELDS = ("schema_version", "event_id", "trajectory_id", "event_seq", "event_type", "occurred_at", "logical_call_id", "attempt_id", "raw_ref", "payload")
_ZONED = r"(?:Z|[+-]\d\d:?\d\d)$"


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): lines that are strict JSON objects with exactly the known fields, a zoned time and valid
    values; every other non-blank line with its text, file and reasons.

    Strict parsing (no repeated keys, no NaN) is ``try_parse_json``; fields are typed by the event schema. Usage is
    read under all its names; a count that is no whole number from 0 on sends the line to quarantine.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    names = F.json_object_keys("value")
    typed = F.from_json("value", schema.EVENT, {"mode": "PERMISSIVE"})
    read = lines.select("value", "file", F.try_parse_json("value").isNotNull().alias("strict"), names.alias("names"), F.get_json_object("value", "$.occurred_at").alias("said"), typed.alias("e"))
    # usage may come under providers' names for its counts
    raw = F.try_variant_get(F.try_parse_json("value"), "$.payload.usage", "variant")
    use = parsed(raw)
    named = F.when(raw.isNotNull() & F.col("e.payload.usage").isNotNull(), F.struct(*(use[f"{c}_tokens"].alias(f"{c}_tokens") for c in ("input", "output", "total"))))
    read = read.withColumn("wrong", F.array_remove(F.array_except(F.coalesce(use["problems"], F.array().cast("array<string>")), F.array(F.lit("reasoning_exceeds_output"))), "total_differs"))
    read = read.withColumn("e", F.when(F.col("e.payload").isNotNull(), F.col("e").withField("payload.usage", named)).otherwise(F.col("e")))
    known = F.array(*map(F.lit, FIELDS))
    shape = F.array_compact(F.array(
        F.when(~F.col("strict"), F.lit("not_strict_json")), F.when(F.size(F.array_except(F.coalesce("names", F.array().cast("array<string>")), known)) > 0, F.lit("unknown_field")),
        F.when(F.size(F.array_except(known, F.coalesce("names", F.array().cast("array<string>")))) > 0, F.lit("missing_field")), F.when(~F.coalesce(F.col("said").rlike(_ZONED), F.lit(False)), F.lit("time_without_zone")),
        F.when(F.size("wrong") > 0, F.lit("usage")),
    ))
    checked = row_problems(read.select("value", "file", shape.alias("shape"), "e.*"))
    checked = checked.withColumn("problems", F.concat("shape", "problems"))
    good = checked.where(F.size("problems") == 0).select(*FIELDS)
    return good, checked.where(F.size("problems") > 0).select("value", "file", "problems")


def write(events: DataFrame, path: str) -> None:
    """Write events as JSONL; an existing path or no events at all is an error."""
    if events.isEmpty():
        raise ValueError("there are no events to write")
    zoned = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    events.select(*FIELDS).withColumn("occurred_at", zoned).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def acceptable(new: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events whose sequence grows within their run, after what is stored, and whose id is new."""
    at = new.withColumn("_twice", F.row_number().over(W.partitionBy("event_id").orderBy("trajectory_id", "event_seq")) > 1)
    top = F.lit(None).cast("long")
    if stored is not None:
        tops = stored.groupBy("trajectory_id").agg(F.max("event_seq").alias("_top"))
        at = at.join(tops, "trajectory_id", "left").join(stored.select("event_id", F.lit(True).alias("_known")), "event_id", "left")
        at, top = at.withColumn("_twice", F.col("_twice") | F.coalesce("_known", F.lit(False))), F.col("_top")
    # what goes for its id holds no place in the sequence
    before = F.lag("event_seq").over(W.partitionBy("trajectory_id", "_twice").orderBy("event_seq", "event_id"))
    bad = F.col("_twice") | F.coalesce(F.col("event_seq") <= before, F.lit(False)) | F.coalesce(F.col("event_seq") <= top, F.lit(False))
    at = at.withColumn("_bad", bad)
    return at.where("NOT _bad").select(*new.columns), at.where("_bad").select(*new.columns)


def append(events: DataFrame, path: str) -> DataFrame:
    """Append the acceptable events, payload texts redacted, to the Parquet table at path; returns the rejected ones."""
    spark = events.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    good, bad = acceptable(events, stored)
    texts = [f.name for f in schema.PAYLOAD.fields if f.dataType.simpleString() == "string"]
    for name in texts:
        good = good.withColumn("payload", F.col("payload").withField(name, redacted_json(F.col(f"payload.{name}"))))
    good.write.mode("append").parquet(path)
    return bad


def ordered(events: DataFrame, trajectory_id: str | None = None) -> DataFrame:
    """Events in order, of one run if asked."""
    return (events if trajectory_id is None else events.where(F.col("trajectory_id") == trajectory_id)).orderBy("trajectory_id", "event_seq")


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("trajectory_id").agg(F.count("*").alias("events"))
