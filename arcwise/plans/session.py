"""Session helpers: the shared folder, lineage cuts, and a distributed row number."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes that a file is to have at least on average, as the source has them, and shuffle partitions that make one file.
FILE_BYTES, SHUFFLED = 16 << 20, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where the cluster names none and all runs in this process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arcwise-"))
        have = sc._jsc.sc().getCheckpointDir()
    return (named or have.get()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/arcwise-{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete the path, which must be there, when it ends."""
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)


def table_files(source: DataFrame) -> int:
    """How many files a table of about the source's bytes is to have: of FILE_BYTES each, but two for each core at least.

    Of a source whose size Spark doesn't know the number is so large that it bounds nothing.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * source.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE_BYTES), 1 << 30))


def few_files(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in no more partitions than ``table_files`` of its source: many small partitions would make as many small files."""
    return df.coalesce(table_files(source))


def materialised(df: DataFrame, name: str = "state", files: int | None = None, by: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read back: plans of loops stay short and lost executors cost nothing.

    ``files``: how many files it has at most, 0: as many as partitions; else one for SHUFFLED shuffle partitions, but two for each
    core at least. What Python workers make should be put together before they get it: a task that runs one worker after the other
    keeps the buffers of all. ``by``: the last column, a folder for each value of it. The table goes when the driver ends, or before that with ``discarded``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if files is None:
        files = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHUFFLED)
    (df.coalesce(files) if files else df).write.parquet(path, partitionBy=by)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of ``materialised`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_table_path", None):
            fs, at = _path(df.sparkSession, path)
            fs.delete(at, True)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files of plans that are done go then, and not at some time later."""
    gc.collect()
    spark._jvm.System.gc()


def kept_by(df: DataFrame, key: str) -> DataFrame:
    """The rows, written, then dealt out by the key and kept by the executors: joins on the key move the other side only.

    What a lost executor kept is read again. To be given back with ``unpersist``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialised(df, "kept").repartition(n, key).persist(StorageLevel.MEMORY_AND_DISK)


class Grown:
    """A table in the shared folder to which steps of a loop add rows."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema, self.name, self.parts = spark, schema, name, []

    def add(self, df: DataFrame) -> DataFrame:
        """Adds the rows; returns them as written."""
        self.parts.append(materialised(df, self.name))
        return self.parts[-1]

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[p._table_path for p in self.parts])

    def discard(self) -> None:
        discarded(*self.parts)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based place of each row in the order, without bringing the rows into one partition.

    Rows are range-partitioned and written; only the count of each partition goes through one task.
    """
    parts = materialised(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")
