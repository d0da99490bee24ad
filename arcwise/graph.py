"""TemporalGraph: one table of edges (src, dst, ts), a vertex range, and the analytics over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwise.operators import access, scores, storage, traversal
from arcwise.sources import edges as sources, sinks


@dataclass(frozen=True)
class TemporalGraph:
    """A temporal directed multigraph. Vertices are the ids low..high-1, whether they have edges or not."""

    edges: DataFrame
    low: int
    high: int
    is_view: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame, low: int | None = None, high: int | None = None) -> TemporalGraph:
        """Range: what is given, else 0 to the largest id."""
        e = edges.select("src", "dst", "ts")
        if high is None:
            top = e.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
            high = 0 if top is None else top + 1
        return cls(e, low or 0, high)

    @classmethod
    def read(cls, spark: SparkSession, path: str, low: int | None = None, high: int | None = None, level: StorageLevel | None = None) -> TemporalGraph:
        """A stored graph; ``level`` persists its edges."""
        e = sources.read_edges(spark, path)
        if high is None and (known := sinks.read_properties(spark, path)):
            low, high = known["low"] if low is None else low, known["high"]
        return cls.from_edges(e.persist(level) if level else e, low, high)

    @property
    def ids(self) -> DataFrame:
        return access.vertices(self.edges.sparkSession, self.low, self.high)

    @property
    def inside(self) -> DataFrame:
        """Edges within the active range; all of them on a graph that is no view."""
        return access.active(self.edges, self.low, self.high) if self.is_view else self.edges

    def active(self, low: int, high: int) -> TemporalGraph:
        """The view of the vertices low..high-1. Degrees still count edges to other vertices where the semantics ask for it."""
        return replace(self, low=max(low, self.low), high=min(high, self.high), is_view=True)

    def window(self, start: int, end: int) -> TemporalGraph:
        return replace(self, edges=self.edges.filter(F.col("ts").between(start, end)))

    def bucketed(self, factor: int) -> TemporalGraph:
        """Times rounded to buckets, as a lossy store gives them back."""
        from arcwise.functions.codec import bucket

        return replace(self, edges=self.edges.withColumn("ts", bucket("ts", factor)))

    def first_contact(self) -> DataFrame:
        return access.first_contacts(self.inside)

    def successors(self, ids: DataFrame | None = None) -> DataFrame:
        return access.successors(self.edges, ids)

    def is_neighbor(self, pairs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        return access.are_neighbors(pairs, self.edges, start, end)

    def out_degrees(self) -> DataFrame:
        return access.out_degrees(self.edges, self.ids)

    def scan(self) -> DataFrame:
        return access.scan_digest(self.edges.filter((F.col("src") >= self.low) & (F.col("src") < self.high)))

    def random_access(self, probes: DataFrame) -> DataFrame:
        return access.random_access(probes, self.edges)

    def bfs(self, start: int) -> DataFrame:
        return traversal.bfs(self.inside, start)

    def earliest_arrival(self, *starts: int, contacts: str = "first") -> DataFrame:
        ids = self.edges.sparkSession.createDataFrame([(s,) for s in starts], "id bigint")
        return traversal.earliest_arrival(self.inside, ids, contacts)

    def components(self, directed: bool = True) -> DataFrame:
        return traversal.components(self.inside, self.ids) if directed else traversal.weak_components(self.inside, self.ids)

    def page_rank(self, iterations: int, alpha: float = scores.ALPHA, normalize: bool = False) -> DataFrame:
        return scores.page_rank(self.edges, self.ids, iterations, alpha=alpha, normalize=normalize, low=self.low if self.is_view else None, high=self.high)

    def hits(self, iterations: int) -> DataFrame:
        return scores.hits(self.inside, self.ids, iterations)

    def degree_centrality(self, start: int = 0, end: int = 0, mean: str = "integer") -> DataFrame:
        return access.degree_centrality(self.inside, self.ids, start, end, mean)

    def color(self, priority: str = "java", max_rounds: int = 512) -> DataFrame:
        """``priority``: "java" (the seeded sequence) or "hash"."""
        spark = self.edges.sparkSession
        p = scores.sequence_priorities(spark, self.high).filter(F.col("id") >= self.low) if priority == "java" else self.ids.select("id", scores.hash_priority().alias("priority"))
        return scores.color(self.inside, p, max_rounds)

    def stats(self) -> DataFrame:
        return storage.properties(self.edges, self.high - self.low)

    def sweep(self, ks=storage.SWEEP_K, factors=storage.SWEEP_FACTORS) -> DataFrame:
        return storage.sweep(self.edges, ks, factors)

    def write(self, path: str, partitions: int | None = None, compression: str = "zstd", stats: bool = False) -> None:
        """Stores the edges and the vertex range; with ``stats`` also the storage statistics of ``stats()``."""
        sinks.write_graph(self.edges, path, partitions, compression)
        more = {k: v for k, v in self.stats().first().asDict().items() if isinstance(v, (int, float))} if stats else {}
        sinks.write_properties(self.edges.sparkSession, path, {"low": self.low, "high": self.high} | more)


#: Names of the workloads and the words that stand for them.
WORKLOADS = {"RA": ("RANDOMACCESS", "NEIGHBORACCESS"), "BFS": ("BREADTHFIRSTSEARCH",), "CC": ("CONNECTEDCOMPONENTS",), "PR": ("PAGERANK",), "HITS": (), "DC": ("DEGREECENTRALITY",), "GC": ("GRAPHCOLORING", "COLORING")}


def workload(name: str) -> str:
    """The short name of a workload; case, ``-`` and ``_`` don't matter."""
    plain = name.upper().replace("-", "").replace("_", "").replace(" ", "")
    for short, words in WORKLOADS.items():
        if plain == short or plain in words:
            return short
    raise ValueError(f"no workload {name!r}; there are {', '.join(WORKLOADS)}")


def run_workload(graph: TemporalGraph, name: str, data: sources.Dataset) -> DataFrame:
    """A data set's workload with its parameters."""
    short = workload(name)
    g = graph.active(*data.active)
    if short == "RA":
        probes = min(data.last + 1, g.high) - max(data.first, g.low)
        return g.random_access(access.hashed_probes(graph.edges.sparkSession, probes, max(data.first, g.low), g.high)) if data.random_access else g.scan()
    if short == "BFS":
        return g.bfs(max(data.start, g.low))
    if short == "CC":
        return g.components()
    if short == "PR":
        return g.page_rank(data.rank_iterations)
    if short == "HITS":
        return g.hits(data.rank_iterations)
    return g.degree_centrality() if short == "DC" else g.color(max_rounds=data.color_rounds)
