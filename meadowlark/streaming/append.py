"""Streams of batches into an append-only series; repeats are known by their batch key."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that a stream of this schema is appended to. The series comes from folder names: without the stream's
    schema, Spark would take ids such as 007 and 7 for one number."""
    own = StructType([f for f in schema.fields if f.name != "micro_batch"] + [StructField("micro_batch", StringType())])
    return spark.read.schema(own).parquet(path).select(*schema.names)


def append_stream(rows: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("series_id", "batch_key"), available_now: bool = True) -> StreamingQuery:
    """Writes the rows of batches that aren't stored yet, partitioned by series; below them by ``micro_batch``.

    A batch that a restart or a source repeats changes nothing: stored keys are left out by an anti join. Each
    micro-batch is written beside the table and moved into it by one rename, so one that fails halfway leaves nothing
    behind by which its keys would seem to be stored. A rename of a folder must be atomic, as in HDFS and local file
    systems; object stores copy file by file, and need a table format with commits instead. Null keys are keys like others.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(part: DataFrame, number: int) -> None:
        spark: SparkSession = part.sparkSession
        files, target = _folder(spark, f"{path}/micro_batch={stream}-{number}")
        if files.exists(target):  # written before a restart
            return
        table = _folder(spark, path)[1]
        if files.exists(table) and any("micro_batch=" in x.getPath().getName() for x in files.listStatus(table)):
            known = stored_rows(spark, path, part.schema).select(*(F.col(k).alias(f"_known_{k}") for k in keys)).distinct()
            part = part.join(known, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys)), "left_anti")
        staged = f"{path.rstrip('/')}-staged/{stream}-{number}"
        part.write.mode("overwrite").partitionBy(keys[0]).parquet(staged)
        files.mkdirs(table)
        if not files.rename(_folder(spark, staged)[1], target):
            raise OSError(f"{staged} could not be moved to {path}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_counts(fixes: DataFrame, late: str = "1 day") -> DataFrame:
    """Fixes an animal and UTC day, from a stream or a table; rows later than the watermark are left out of streams."""
    return fixes.withWatermark("observed_at", late).groupBy("entity_id", F.window("observed_at", "1 day")).count()
