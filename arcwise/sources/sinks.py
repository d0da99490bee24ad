"""Sinks: stored graphs, text exports, outdegree files, and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwise.sources.edges import Dataset, read_text_edges


#: Readers of a folder pass over names that begin with an underscore.
PROPERTIES = "_properties"


def write_graph(edges: DataFrame, path: str, partitions: int | None = None, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Stores edges as Parquet, range-partitioned by source and sorted, so that a source's edges are read from few row groups."""
    by = ([partitions] if partitions else []) + ["src", "dst"]
    edges.select("src", "dst", "ts").repartitionByRange(*by).sortWithinPartitions("src", "dst", "ts").write.mode(mode).option("compression", compression).parquet(path)


def write_properties(spark: SparkSession, path: str, row: dict) -> None:
    """Stores a row of numbers beside the edges, in a folder that readers of the edges pass over."""
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items())).coalesce(1).write.mode("overwrite").parquet(f"{path}/{PROPERTIES}")


def read_properties(spark: SparkSession, path: str) -> dict | None:
    """The stored numbers, or None if there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PROPERTIES}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{path}/{PROPERTIES}").first().asDict()


def write_times(encoded: DataFrame, offsets: DataFrame, path: str, compression: str = "zstd") -> None:
    """Stores a time stream (src, nth, dst, delta) and its index (src, bits, offset), both range-partitioned and sorted by source."""
    for table, rows, order in (("times", encoded, ["src", "nth"]), ("index", offsets, ["src"])):
        rows.repartitionByRange("src").sortWithinPartitions(*order).write.mode("overwrite").option("compression", compression).parquet(f"{path}/{table}")


def read_times(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(time stream, index) as write_times stored them."""
    return spark.read.parquet(f"{path}/times"), spark.read.parquet(f"{path}/index")


def export_text(edges: DataFrame, path: str, shift: int = 0, temporal: bool = False) -> None:
    """Writes ``src<TAB>dst`` lines, or ``src dst 1 ts`` lines that read_text_edges takes, with shifted ids."""
    s, d = F.col("src") + shift, F.col("dst") + shift
    cols = [s, d, F.lit(1), F.col("ts")] if temporal else [s, d]
    edges.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value")).write.text(path)


def packed_degrees(degrees: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(block, bytes): the outdegrees of ids block * size onwards as big-endian 32-bit integers, in id order."""
    hexes = F.array_sort(F.collect_list(F.struct("id", F.lpad(F.hex("degree"), 8, "0").alias("h"))))
    return degrees.withColumn("block", F.floor(F.col("id") / block)).groupBy("block").agg(F.unhex(F.array_join(F.transform(hexes, lambda x: x["h"]), "")).alias("bytes"))


def ingest(spark: SparkSession, data: Dataset, root: str, partitions: int | None = None, check_sorted: bool = True) -> DataFrame:
    """The stored graph of a data set; it is made from the raw edge list if it isn't there yet. A raw list whose sources decrease is an error."""
    stored = f"{root}/{data.stored}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stored}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        write_graph(read_text_edges(spark, f"{root}/{data.raw}", check_sorted=check_sorted), stored, partitions, mode="overwrite")
    return spark.read.parquet(stored)
