"""Exchanges of many small fixed-size records as packed blocks of bytes, and corpus-wide counters.

A map task packs the records for each bucket into one binary row per batch, so Spark moves few
rows and numpy sorts a bucket at once. Buckets are many times the number of shuffle partitions and
are handled one after the other, which bounds a task's memory.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm.blocks import U64
from arcwise.llm.shared import in_batches

#: Buckets for each shuffle partition.
BUCKETS = 4
#: Counters of a sketch: 4 Mi, of which the driver gets one byte each.
SKETCH_BITS = 22
_SLICE_BITS = 16


def buckets_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS


def packed(keys: np.ndarray, records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, block) rows: the records by the bucket that their key's upper bits give."""
    where = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    where, records = where[order], records[order]
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(where)]
    return pa.RecordBatch.from_arrays([pa.array(where[cut], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary())], names=["bucket", "block"])


def by_bucket(df: DataFrame, work, kind: np.dtype, schema) -> DataFrame:
    """work(records) for each bucket's records; df has (bucket, block). It yields Arrow batches of the schema."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and parts:
                    yield from work(np.concatenate(parts))
                    parts = []
                now = bucket
                parts.append(np.frombuffer(block.as_buffer(), kind))
        if parts:
            yield from work(np.concatenate(parts))

    return df.repartition(n, "bucket").sortWithinPartitions("bucket").transform(in_batches, run, schema)


class Sketch:
    """Counts of hashed items in 2**SKETCH_BITS counters, filled by one task."""

    def __init__(self):
        self.counts = np.zeros(1 << SKETCH_BITS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount((hashes >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)

    def batch(self, task: int) -> pa.RecordBatch:
        parts = [zlib.compress(x.tobytes(), 1) for x in self.counts.reshape(-1, 1 << _SLICE_BITS)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "task", "counts"])


SKETCH_SCHEMA = "slice int, task int, counts binary"


def levels(sketches: DataFrame, tasks: int) -> np.ndarray:
    """The sum of all tasks' sketches, as one byte each: twice the binary logarithm. Sums go through about sqrt(tasks) groups first."""

    def summed(done):
        def run(key, frames):
            total = 0
            for t in frames:
                for x in t.column("counts"):
                    total = total + np.frombuffer(zlib.decompress(x.as_py()), np.uint64 if done else np.uint32)
            out = np.minimum(2 * np.log2(1 + total.astype(float)), 255).astype(np.uint8) if done else total.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([out.tobytes() if done else zlib.compress(out.tobytes(), 1)], pa.binary())], names=["slice", "task", "counts"])

        return lambda key, table: pa.Table.from_batches(run(key, [table]))

    groups = max(1, round(tasks**0.5))
    some = sketches.groupBy("slice", F.pmod("task", F.lit(groups)).alias("part")).applyInArrow(summed(False), SKETCH_SCHEMA)
    rows = some.groupBy("slice").applyInArrow(summed(True), SKETCH_SCHEMA).collect()  # 2**SKETCH_BITS bytes in all
    out = np.zeros((1 << SKETCH_BITS) >> _SLICE_BITS << _SLICE_BITS, np.uint8)
    for r in rows:
        out[r["slice"] << _SLICE_BITS : (r["slice"] + 1) << _SLICE_BITS] = np.frombuffer(r["counts"], np.uint8)
    return out


def level_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)]


def rarity_keys(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that sort rare items first: level, then hash. Equal items have equal keys."""
    return (level_of(table, hashes).astype(U64) << U64(56)) | (hashes >> U64(8))


#: Bits of a filter over ids.
BLOOM_BITS = 23


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of a Bloom filter of 1 MB over a long column: false positives only. The driver gets 2**17 longs at most."""
    h = F.shiftrightunsigned(F.xxhash64(column), 64 - BLOOM_BITS)
    rows = ids.select(F.shiftrightunsigned(h, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({column}), {64 - BLOOM_BITS}) & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(1 << (BLOOM_BITS - 6), U64)
    for r in rows:
        out[r["word"]] = r["bits"] & ((1 << 64) - 1)
    return out


def bloom_has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """hashes: xxhash64 of the ids, as Spark computes it."""
    h = hashes.astype(np.int64).view(U64) >> U64(64 - BLOOM_BITS)
    return (bits[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) > 0


