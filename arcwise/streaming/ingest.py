"""Structured Streaming over folders of edge files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from arcwise.sources.edges import SCHEMA
from arcwise.sources.sinks import PROPERTIES


def edge_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the edges (src, dst, ts) that arrive as Parquet files under path."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_degrees(edges: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(src, start, n, first_contacts_approx): edges of each source in tumbling windows of event time, and about how many
    different targets; late edges are let in up to the watermark.
    """
    timed = edges.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    per = timed.groupBy(F.window("at", width).alias("w"), "src").agg(F.count("*").alias("n"), F.approx_count_distinct("dst").alias("first_contacts_approx"))
    return per.select("src", F.col("w.start").alias("start"), "n", "first_contacts_approx")


def append_edges(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a stored graph; ends when what is there is read.

    Each batch is range-partitioned and sorted as stored graphs are. Its files bear its number: a batch that is tried again
    replaces what it had moved in. A stored vertex range no longer holds and is deleted.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")
        fs = name("x").getFileSystem(spark._jsc.hadoopConfiguration())
        batch.select("src", "dst", "ts").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst", "ts").write.mode("overwrite").parquet(f"{path}/_batch-{number}")
        for old in fs.globStatus(name(f"part-batch-{number}-*")):
            fs.delete(old.getPath(), False)
        for k, new in enumerate(fs.globStatus(name(f"_batch-{number}/part-*"))):
            fs.rename(new.getPath(), name(f"part-batch-{number}-{k:05d}.parquet"))
        fs.delete(name(f"_batch-{number}"), True)
        fs.delete(name(PROPERTIES), True)

    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
