"""Sources of temporal edges: text edge lists, Parquet, and views of the star-schema tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Seconds since 1970 of a timestamp column, whatever the session's time zone.
_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
SCHEMA = "src bigint, dst bigint, ts bigint"


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(line, file, block) of lines that aren't blank; with ``header`` without each file's first one."""
    if header:
        # The CSV reader leaves out the first line with text of a file, and only there; no line has its separator.
        read = spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True).csv(path)
    else:
        read = spark.read.text(path)
    line = F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")
    return read.select(line, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter("line != ''")


def read_text_edges(spark: SparkSession, path: str, header: bool = False, shift: int = 0, partitions: int | None = None, check_sorted: bool = False) -> DataFrame:
    """Edges of whitespace-separated lines ``src dst <ignored> ts`` (gzip or plain).

    Blank lines are skipped; a line with fewer than four columns, a column that is no integer or a negative
    node fails the job. ``shift`` is added to node ids. ``header``: the first line that isn't blank of every file is left
    out, whatever stands in it. ``check_sorted`` reads the files once before and raises ValueError if a file's sources
    decrease. A gzip file can't be split, so rows can be dealt out anew by source with ``partitions``.
    """
    lines = _lines(spark, path, header)
    cols = F.split("line", " ")
    number = lambda i: F.get(cols, F.lit(i)).try_cast("bigint")
    rows = lines.select("line", "file", "block", *[number(i).alias(c) for i, c in enumerate(("src", "dst", "_skipped", "ts"))])
    sound = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("_skipped").isNotNull() & F.col("ts").isNotNull() & (F.col("src") >= 0) & (F.col("dst") >= 0)
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("line"))).cast("bigint")
    edge = [F.when(sound, F.col(c) + (shift if c != "ts" else 0)).otherwise(bad).alias(c) for c in ("src", "dst", "ts")]
    if check_sorted and (found := unsorted_files(rows.select("file", "block", edge[0])).first()):
        raise ValueError(f"sources decrease in {found['file']}, from {found['before']} to {found['src']}")
    out = rows.select(*edge)
    return out.repartition(partitions, "src") if partitions else out


def unsorted_files(rows: DataFrame) -> DataFrame:
    """(file, before, src): where sources decrease within a file. rows (file, block, src) come as they are read, a file's blocks each in order.

    A block gives one row; only these are put in order by file.
    """

    def run(batches):
        import pyarrow as pa

        seen: dict = {}  # (file, block): [first, last, before, src] of this task's splits
        for batch in batches:
            for file, block, src in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "src")), strict=True):
                s = seen.setdefault((file, block), [src, src, None, None])
                if src < s[1] and s[2] is None:
                    s[2:] = s[1], src
                s[1] = src
        columns = [*zip(*seen), *zip(*seen.values())] if seen else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["file", "block", "first", "last", "before", "src"])

    blocks = rows.mapInArrow(run, "file string, block bigint, first bigint, last bigint, before bigint, src bigint")
    prior = F.lag("last").over(Window.partitionBy("file").orderBy("block"))
    return blocks.withColumn("prior", prior).select("file", F.coalesce("before", "prior").alias("before"), F.when(F.col("before").isNotNull(), F.col("src")).otherwise(F.col("first")).alias("src")).filter("src < before")


def unsorted_sources(edges: DataFrame, position: str) -> DataFrame:
    """Positions at which the source is less than on the position before, in blocks of 2**16 positions with one border row each."""
    block = F.floor(F.col(position) / 65536)
    e = edges.select(F.col(position).alias("at"), "src", block.alias("block"))
    last = e.groupBy("block").agg(F.max_by("src", "at").alias("border")).select((F.col("block") + 1).alias("block"), "border")
    before = F.lag("src").over(Window.partitionBy("block").orderBy("at"))
    return e.join(last, "block", "left").withColumn("before", F.coalesce(before, "border")).filter("src < before").select("at", "src", "before")


def read_edges(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Edges of a stored graph (``parquet``) or of a text edge list (``text``)."""
    if format == "text":
        return read_text_edges(spark, path, **options)
    return spark.read.format(format).load(path).select("src", "dst", "ts")


def event_walk(spark: SparkSession, sf_dir: str, bucket_rows: int = 100_000) -> DataFrame:
    """Edges from each event's user to the next event's user, in order of (ts, event_id); the last event has none.

    The next row is found within buckets of time, as wide as ``bucket_rows`` events take on average; only each bucket's first
    row goes to the bucket before it, so no task holds all events.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    at = F.expr(_SECONDS)
    seen = e.agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).first()
    width = max(1, (seen["high"] - seen["low"] + 1) * bucket_rows // seen["n"]) if seen["n"] else 1
    e = e.withColumn("bucket", F.floor(at / width))
    firsts = e.groupBy("bucket").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    firsts = firsts.select("bucket", F.lead("first").over(Window.orderBy("bucket")).alias("after"))
    inside = F.lead("user_id").over(Window.partitionBy("bucket").orderBy("ts", "event_id"))
    out = e.withColumn("inside", inside).join(firsts, "bucket").withColumn("dst", F.coalesce("inside", "after"))
    return out.filter("dst is not null").select(F.col("user_id").cast("bigint").alias("src"), F.col("dst").cast("bigint"), F.expr(_SECONDS).alias("ts"), "event_id")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to suppliers (ids from a million on) at the day of shipping."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_shipdate")
    rows = item.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").cast("bigint").alias("src"), (F.col("l_suppkey") + 1_000_000).cast("bigint").alias("dst"), F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("ts"))


@dataclass(frozen=True)
class Dataset:
    """A named graph: vertex range, active range, and the iterations its workloads use."""

    name: str
    last: int
    first: int = 0
    active_from: int = 0
    rank_iterations: int = 100
    color_rounds: int = 512
    random_access: bool = False
    view_of: str | None = None

    @property
    def active(self) -> tuple[int, int]:
        return self.active_from, self.last + 1

    @property
    def start(self) -> int:
        return max(self.first, self.active_from)

    @property
    def raw(self) -> str:
        return f"raw/{self.view_of or self.name}.raw.txt.gz"

    @property
    def stored(self) -> str:
        return f"stored/{self.view_of or self.name}"


#: The six data sets' ranges and iteration counts.
DATASETS = {
    d.name: d
    for d in (
        Dataset("Comm", 9_999, random_access=True),
        Dataset("MyD", 999_967, first=1, random_access=True),
        Dataset("Flickr", 2_585_568, first=1),
        Dataset("Wiki", 42_640_545, first=1, rank_iterations=10),
        Dataset("Yahoo", 102_867_214, rank_iterations=2, color_rounds=2),
        Dataset("Yahoo-sub", 102_867_214, active_from=2_000, rank_iterations=2, color_rounds=2, view_of="Yahoo"),
    )
}
_ALIASES = {"cbtcomm": "Comm"}


def dataset(name: str) -> Dataset:
    """The data set of a name; case, ``-`` and ``_`` don't matter."""
    plain = name.lower().replace("-", "").replace("_", "")
    for d in DATASETS.values():
        if plain in (d.name.lower().replace("-", ""), *[a for a, n in _ALIASES.items() if n == d.name]):
            return d
    raise KeyError(f"no data set {name!r}; there are {', '.join(DATASETS)}")


def data_root(given: str | None = None) -> str:
    """Where data sets lie: what is given, else ARCWISE_DATA, else the nearest ``data`` folder upwards."""
    if root := given or os.environ.get("ARCWISE_DATA"):
        return root
    at = os.getcwd()
    while not os.path.isdir(os.path.join(at, "data")):
        if (up := os.path.dirname(at)) == at:
            raise FileNotFoundError("no data folder: name one or set ARCWISE_DATA")
        at = up
    return os.path.join(at, "data")
