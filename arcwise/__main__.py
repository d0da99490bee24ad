"""``python -m arcwise DATASET WORKLOAD [--root PATH] [--prepare-only] [--out PATH]``: ingest if needed, run, report the time."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from arcwise.graph import TemporalGraph, run_workload, workload
from arcwise.sources.edges import data_root, dataset
from arcwise.sources.sinks import ingest


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="arcwise")
    p.add_argument("dataset")
    p.add_argument("workload", nargs="?", default="RA")
    p.add_argument("--root")
    p.add_argument("--prepare-only", action="store_true")
    p.add_argument("--out", help="folder for the result, as Parquet")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("arcwise").getOrCreate()
    data = dataset(a.dataset)
    edges = ingest(spark, data, data_root(a.root))
    if a.prepare_only:
        return
    graph = TemporalGraph.from_edges(edges, 0, data.last + 1)
    began = time.perf_counter_ns()
    out = run_workload(graph, a.workload, data)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
        rows = spark.read.parquet(a.out).count()
    else:
        rows = out.count()
    print(f"RESULT dataset={data.name} workload={workload(a.workload)} rows={rows} elapsed_ns={time.perf_counter_ns() - began}")


if __name__ == "__main__":
    main()
