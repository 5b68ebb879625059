"""Keeps postings of a stream of files: each micro-batch adds a delta.

A delta is a folder of postings named after its batch, so a batch that is run again
after a failure replaces its own delta and nothing is counted twice. compact() puts
the deltas into one sorted table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.postings import extract
from ..sources.corpus import text_only


def start(files: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes deltas of a stream (path, content) below target, as (path, g) rows and one with
    a null g for each path. Rows with a null path are left out; a null content or a
    binary one has no trigrams, so that it takes a file out that was there before."""

    def add(batch: DataFrame, number: int) -> None:
        files = batch.where("path is not null").select("path", "content").withColumn("file_id", F.monotonically_increasing_id()).persist()
        named = text_only(files)
        grams = extract(named).join(named.select("file_id", "path"), "file_id").select("path", "g").union(files.select("path", F.lit(None).cast("int")))
        grams.repartitionByRange("g").sortWithinPartitions("g").write.mode("overwrite").parquet(f"{target}/batch={number}")
        files.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def postings(spark: SparkSession, target: str) -> DataFrame:
    """(path, g) of all deltas; of a path that came again the last batch counts."""
    every = spark.read.schema("path string, g int, batch long").parquet(target)
    last = every.groupBy("path").agg(F.max("batch").alias("batch"))
    return every.join(last, ["path", "batch"], "left_semi").where("g is not null").select("path", "g").distinct()


def compact(spark: SparkSession, target: str, into: str) -> None:
    postings(spark, target).repartitionByRange("g", "path").sortWithinPartitions("g", "path").write.parquet(into)
