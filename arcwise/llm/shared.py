"""Session settings and lineage cuts that the operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcwise.plans.session import discarded, few_files, materialised, shared_dir, swept, table_files  # noqa: F401

#: Rows and bytes of an Arrow batch; one longer text still stands in a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000

written = materialised


def prepared(spark: SparkSession) -> SparkSession:
    """Sets the size of Arrow batches, and a checkpoint folder where none is named (as in tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_dir(spark)
    return spark


def released() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


@contextlib.contextmanager
def exchanges_gone(spark: SparkSession):
    """Within it, the shuffle files of a query go when it ends, without waiting for the driver's garbage. For queries that are run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), after which a worker keeps nothing of a task. Columns may have any name."""
    names = df.columns

    def task(batches):
        try:
            yield from run(batch.rename_columns(names) for batch in batches)
        finally:
            released()

    # mapInArrow reads a dot in a name as a field of a column.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(task, schema) if any(set(".`") & set(c) for c in names) else df.mapInArrow(task, schema)


#: Bytes in memory up to which a table is broadcast to be looked up.
LOOKUP_BYTES = 32_000_000


def lookup(small: DataFrame, row_bytes: Column, most: int | None = None) -> DataFrame:
    """A table that texts are joined with, written. Where its rows take no more than ``most`` bytes it is broadcast, so that the texts
    stay where they are; a larger one is joined by an exchange.
    """
    most = LOOKUP_BYTES if most is None else most
    out = written(small, "lookup")
    taken = out.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(out) if taken <= most else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows of least hash of the keys, in that order.

    A first filter on the hash leaves about twice as many, so that tasks don't each send n rows to be sorted.
    """
    total = rows.count()
    h = F.xxhash64(*keys)
    if total > 4 * n:
        rows = rows.filter(F.shiftrightunsigned(h, 32) < int((1 << 32) * 2 * n / total))
    return rows.orderBy(F.shiftrightunsigned(h, 32), *keys).limit(n)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out
