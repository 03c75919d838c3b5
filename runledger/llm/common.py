"""Shared helpers: the shared folder, written tables that cut lineage, places of rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary folder (tests); on a cluster that would be no shared one, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under fixed names, so that extra columns with clashing names do no harm."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in wanted.items()))


#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches of ``BATCH_ROWS`` rows at most.

    Spark's own 10,000 rows make a whole partition of texts or sets one batch, which both sides of a task hold more
    than once. Spark reads the setting when the result is run, so it stays lowered in the session; a lower one is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "0")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def located(docs: DataFrame, plain: bool = False) -> DataFrame:
    """docs with its columns as c0, c1, ... and each row's place, ``_file`` and ``_row``, the same whenever it is read.

    ``plain``: docs is a mere read of Parquet files, whose own places serve; anything else is written first.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    place = ("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if plain and "_metadata" not in docs.columns:
        try:
            return own.select(*place)
        except AnalysisException:  # no file has these rows
            pass
    return stored(own, "located").select(*place)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of undirected edges (a long, b long) as rows (id, component), component the smallest id.

    Alternating large-star and small-star steps, two aggregations and two joins on ids a round. Each is written to
    the shared folder, so that the joins read tables of known size: Spark looks a small one up by broadcast, and
    between large ones it can split the shuffled partition of a star's centre. Vertices without an edge do not appear. Self-loops are ignored; an
    empty input gives an empty result.
    """
    spark = edges.sparkSession
    now, path = stored_at(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "cc")
    last = None
    for _ in range(most_rounds):
        # large-star: the larger neighbours of each vertex are linked with its smallest neighbour or itself
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least, least_at = stored_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        large, large_at = stored_at(both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct(), "cc")
        # small-star: the smaller neighbours of each vertex, and itself, are linked with the smallest of them
        lowest, lowest_at = stored_at(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(lowest, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        before = path
        now, path = stored_at(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "cc")
        for done in (before, least_at, large_at, lowest_at):
            removed(spark, done)
        mark = now.agg(F.count("*"), F.sum(F.expr("CAST(xxhash64(u, v) AS DECIMAL(38, 0))"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    members = now.groupBy("u").agg(F.min("v").alias("component")).selectExpr("u AS id", "component")
    return members.unionByName(members.selectExpr("component AS id", "component").distinct())


#: Bits of the filter of ``maybe_in``: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


def _marked(df: DataFrame, key: Column, ids: DataFrame, bits: int) -> DataFrame:
    """df with ``_hit``: whether its key may be the one column of ids; false for nulls."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("string")), F.lit(bits))
    sets = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_set"))
    own = F.when(key.isNotNull(), F.pmod(F.xxhash64(key.cast("string")), F.lit(bits)))
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(own)).withColumn("_at", F.bitmap_bit_position(own))
    byte = F.conv(F.hex(F.expr("substring(_set, CAST(_at div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0, F.lit(False))
    return marked.join(F.broadcast(sets), "_bucket", "left").select(*df.columns, hit.alias("_hit"))


def maybe_in(df: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose ``column`` may be in the one column of ids: all that are, and few others.

    A bit set of fixed size (``bits`` / 8 bytes, the proven bound of what is broadcast) is built from
    hashes of the ids. It only saves shuffling; when it fills up more rows pass, none is lost. Follow it
    with the exact join. Nulls never pass.
    """
    return _marked(df, F.col(column), ids, bits).where("_hit").drop("_hit")


def without(df: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """Rows of df whose keys are not in gone (the same columns); a null key is in nothing. Only rows that may be there are shuffled."""
    one = lambda: F.concat(*(x for k in keys for x in (F.col(k).cast("string"), F.lit("\x1f"))))
    marked = _marked(df, one(), gone.select(one().alias("key")), FILTER_BITS)
    checked = marked.where("_hit").join(gone, keys, "left_anti")
    return marked.where("NOT _hit").unionByName(checked).select(*df.columns)
