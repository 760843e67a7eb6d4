"""Child tables and the audit log as stored files that a batch may be written to again.

Whatever a failure leaves, the same batch written once more makes whole: a batch is
known by its id, is staged as a whole before anything stored is touched, and is
marked when it is in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intake import feed

BUCKET = "bucket"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows of a child table; none before its first batch."""
    table = f"{path}/rows"
    if not _exists(spark, table):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, present boolean, {BUCKET} int").parquet(table).where("present").drop("present", BUCKET)


def write_children(changed: DataFrame, parents: DataFrame, path: str, key: str, batch_id: int | str, buckets: int = 64) -> None:
    """The rows of ``changed`` in place of all that are stored of the keys in ``parents``, which may have none left.

    Rows lie in ``buckets`` partitions by a hash of the key, and only those that a
    parent falls in are written. They are first written to a stage of the batch's
    own; partitions are then replaced from that. Before the stage is whole, nothing
    stored has changed; where replacing breaks off, the stage is what a second
    attempt goes on from. A batch that is in is not written again. Every partition
    has a row that isn't present, so that one left empty is replaced too.
    """
    spark = changed.sparkSession
    mark, stage, table = f"{path}/batches/{batch_id}", f"{path}/stages/{batch_id}", f"{path}/rows"
    if _exists(spark, mark):
        return
    schema = ", ".join(f"`{c}` {t}" for c, t in changed.dtypes)
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)
    if not _exists(spark, f"{stage}/_SUCCESS"):
        keys = parents.select(key).distinct()
        touched = keys.select(place).distinct()  # at most ``buckets`` rows
        rows = changed.select("*", place)
        if _exists(spark, table):
            stored = spark.read.schema(f"{schema}, present boolean, {BUCKET} int").parquet(table).where("present").drop("present")
            left = stored.join(F.broadcast(touched), BUCKET, "left_semi").join(keys, key, "left_anti")
            rows = left.select(*rows.columns).unionByName(rows)
        empty = touched.select(*(F.lit(None).cast(t).alias(c) for c, t in changed.dtypes), F.lit(False).alias("present"), BUCKET)
        rows.withColumn("present", F.lit(True)).unionByName(empty).repartition(BUCKET).write.mode("overwrite").parquet(stage)
    replace_partitions(spark.read.parquet(stage), table)
    _put(spark, mark)
    _remove(spark, stage)


def replace_partitions(rows: DataFrame, table: str) -> None:
    """The table's partitions that ``rows`` have, replaced by them."""
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table)


def write_audit(records: DataFrame, path: str, batch_id: int | str) -> None:
    """A batch of audit records as a folder of its own, so that the same batch written again replaces it."""
    records.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def audit(spark: SparkSession, path: str, keep: int = 5000) -> DataFrame:
    """The log, newest first, cut to ``keep``: the local log's size is its feature."""
    return feed(spark.read.parquet(path).drop("batch"), keep)


def prune_audit(spark: SparkSession, path: str, keep: int = 5000) -> None:
    """Removes folders of batches none of whose records is among the newest ``keep``; what ``audit`` gives stays as it is."""
    kept = {r["batch"] for r in feed(spark.read.parquet(path), keep).select(F.col("batch").cast("string").alias("batch")).distinct().collect()}  # at most ``keep`` rows
    for r in spark.read.parquet(path).select(F.col("batch").cast("string").alias("batch")).distinct().toLocalIterator():
        if r["batch"] not in kept:
            _remove(spark, f"{path}/batch={r['batch']}")


def sink(write: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream's micro-batches to ``write(rows, batch_id)``, which gets the same rows with the same id after a failure."""
    return lambda stream: stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
