"""Exact deduplication as a stateful stream.

A stream over the log of documents keeps, per digest of the normalised text, one state row without
expiry in a disk-backed store: the digest, the stable identifier of the row that stays, its locator (file
and row number) and the size of the group. When the stream has drained, the state is read as a table.
Digests with more than one row (hits) are then checked on the full bytes of all their texts; texts that
share a digest but differ are grouped by the texts themselves.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Defined results:
a null text counts as empty; of equal texts the one with most code points in the original, then the
smallest id, then the first row stays, so exactly one row of repeated rows stays; an empty table gives an
empty result; other columns are ignored. A null id sorts before all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import columns, located, maybe_in, new_path, stored, without

SPACES = r"[\x20\x09-\x0D]+"
#: A store on disk, without space set aside for each of many small parts; all parts of an executor share a
#: bounded memory and are closed once their task has ended.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(spark: SparkSession, log: DataFrame, path: str, files_a_batch: int) -> DataFrame:
    """(digest, best, n) after the log at path has streamed through the keyed state.

    The state's store is in the shared folder, so a lost executor's part of it is read back from there.
    """
    place, before = new_path(spark, "dedup-state"), {k: spark.conf.get(k, None) for k in _STORE}
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row", "file")).alias("best")
    state = stream.groupBy("digest").agg(best, F.count("*").alias("n"))
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).start()
        run.awaitTermination()
        if not run.lastProgress:
            return log.sparkSession.createDataFrame([], log.groupBy("digest").agg(best, F.count("*").alias("n")).schema)
        kept = spark.read.format("statestore").load(place)
        kept = kept.select(F.col("key.digest").alias("digest"), *(F.col(f"value.{c}").alias(a) for c, a in zip(kept.schema["value"].dataType.names, ("best", "n"), strict=True)))
        return stored(kept, "dedup-groups")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_a_batch: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text), dropped ones too.

    ``digest`` is the key of the state; a weaker one only means more bytes to check, never a wrong group.
    """
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("row", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    return _decided(texts, digest, files_a_batch).drop("row", "file")


def _decided(texts: DataFrame, digest: Callable[[Column], Column], files_a_batch: int = 1000) -> DataFrame:
    """The result for rows (doc_id, text, row, file), with row and file."""
    spark = texts.sparkSession
    texts = texts.withColumn("norm", normalised(F.col("text"))).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    path = new_path(spark, "dedup-log")
    texts.select("doc_id", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"), "n_chars", "row", "file").write.parquet(path)
    log = spark.read.parquet(path)
    groups = keyed_state(spark, log, path, files_a_batch)
    joined = log.drop("n_chars").join(groups, "digest")

    # hits: compare the full bytes of every text whose digest has been seen before
    bodies = maybe_in(texts.select("norm", digest(F.col("norm")).alias("digest")), "digest", groups.where("n > 1").select("digest"))
    differ = bodies.groupBy("digest").agg(F.min("norm").alias("first"), F.max("norm").alias("last")).where("first <> last").select("digest")
    differ = stored(differ, "dedup-clashes")
    if differ.isEmpty():
        return _result(joined)
    return _result(joined.join(differ, "digest", "left_anti")).unionByName(_result(_by_text(texts, differ, digest)))


def _by_text(texts: DataFrame, differ: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of the digests that different texts share, grouped by the texts."""
    apart = stored(texts.select("norm", digest(F.col("norm")).alias("digest"), "doc_id", "n_chars", "row", "file").join(differ, "digest", "left_semi"), "dedup-apart")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row", "file")).alias("best")
    groups = apart.groupBy("norm").agg(best, F.count("*").alias("n"))
    return apart.select("doc_id", "norm", "row", "file", sha256(F.col("norm")).alias("text_sha256")).join(groups, "norm")


def _result(joined: DataFrame) -> DataFrame:
    kept = (F.col("row") == F.col("best.row")) & (F.col("file") == F.col("best.file"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256", "row", "file")


def drop_copies(docs: DataFrame, plain: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns whatever these are called.

    Rows are told apart by their place (see ``located``), so of equal texts just the one stays that
    ``exact_dedup`` keeps, be ids null or repeated. Null texts count as empty ones; an empty table stays one.
    """
    own = located(docs, plain)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = _decided(own.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col("_row").alias("row"), F.col("_file").alias("file")), sha256)
    gone = stored(rows.where("NOT kept").select(F.col("file").alias("_file"), F.col("row").alias("_row")), "dedup-gone")
    return without(own, ["_file", "_row"], gone).select(*(F.col(a).alias(c) for c, a in at.items()))
