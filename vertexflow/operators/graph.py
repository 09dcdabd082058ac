"""The graph model: a directed multigraph as an edge table, with dense vertex ids.

Edges have columns ``src``, ``dst`` and any values.  Vertices are all ids from 0 to
the largest one.  Self-loops never belong to a graph; parallel edges do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.functions.scalars import drawn
from vertexflow.plans.loop import Rounds
from vertexflow.storage import discard, materialize


class Graph:
    """``edges`` without self-loops and null ends; ``max_vertex`` keeps edges of ids up to it only."""

    def __init__(self, edges: DataFrame, max_vertex: int | None = None):
        edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")}).where("src is not null and dst is not null and src != dst")
        self.edges = edges if max_vertex is None else edges.where((F.col("src") <= max_vertex) & (F.col("dst") <= max_vertex))
        self._size: int | None = None

    @property
    def values(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def size(self) -> int:
        """Number of vertices: one more than the largest id."""
        if self._size is None:
            top = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            self._size = 0 if top is None else top + 1
        return self._size

    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.size()).select("id")

    def persist(self) -> Graph:
        self.edges.persist()
        return self

    def reversed(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *self.values))

    def undirected(self) -> Graph:
        """Every edge in both directions."""
        return Graph(self.edges.unionByName(self.reversed().edges))

    def where(self, condition: Column | str) -> Graph:
        return Graph(self.edges.where(condition))

    def without(self, vertices: DataFrame) -> Graph:
        """The graph without the edges that touch ``vertices`` (id)."""
        gone = vertices.select("id")
        return Graph(self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(self.edges.columns))

    def within(self, vertices: DataFrame) -> Graph:
        """The edges that have both ends among ``vertices`` (id)."""
        kept = vertices.select("id")
        return Graph(self.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(self.edges.columns))

    def dedupe(self, **aggregates: Column) -> Graph:
        """One edge for each pair of ends, with values by ``aggregates`` (say ``w=F.min("w")``)."""
        made = [a.alias(n) for n, a in aggregates.items()]
        return Graph(self.edges.groupBy("src", "dst").agg(*made) if made else self.edges.select("src", "dst").distinct())

    def prefer(self, *order: Column) -> Graph:
        """One edge for each pair of ends: the first in ``order``, with all its values."""
        pick = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *self.values))
        best = self.edges.groupBy("src", "dst").agg(pick.alias("_best"))
        return Graph(best.select("src", "dst", *[F.col(f"_best.{v}").alias(v) for v in self.values]))


def degrees(graph: Graph, isolated: bool = False) -> DataFrame:
    """``id, in_degree, out_degree``, counting parallel edges; with ``isolated``, for all ids."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    out = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    if not isolated:
        return out
    zero = F.lit(0).cast("long")
    return graph.vertices().join(out, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def neighbours(graph: Graph) -> DataFrame:
    """``id, neighbour``: distinct neighbours in either direction."""
    return graph.undirected().edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()


def reset_values(graph: Graph, **values) -> Graph:
    """The graph with its edge values set to constants."""
    return Graph(graph.edges.select("src", "dst", *[F.lit(v).alias(n) for n, v in values.items()]))


#: Most sources whose edges are dealt over several tasks.
LARGE = 100_000
#: Parts of a vertex's out-edges that are numbered apart, so that no hub is sorted in one task.
NUMBERED = 64


def edge_slots(graph: Graph) -> DataFrame:
    """``id, slot, neighbour, out_degree``: every out-edge, parallel ones too, numbered from 0 for each source."""
    part = F.pmod("dst", F.lit(NUMBERED)).cast("int")
    edges = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), part.alias("_part"))
    sizes = edges.groupBy("id", "_part").agg(F.count("*").alias("_n"))
    own = W.partitionBy("id")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("id", "_part", before.alias("_start"), F.sum("_n").over(own).alias("out_degree"))
    row = F.row_number().over(W.partitionBy("id", "_part").orderBy("neighbour"))
    return edges.withColumn("_row", row).join(starts, ["id", "_part"]).select("id", (F.col("_start") + F.col("_row") - 1).alias("slot"), "neighbour", "out_degree")


def _draw(walkers: DataFrame, slots: DataFrame, seed: int, step: int, who: str) -> DataFrame:
    """``walkers`` with the ``neighbour`` that each draws for itself; those on vertices without out-edges go."""
    sizes = slots.where("slot = 0").select("id", "out_degree")
    going = walkers.join(sizes, "id").withColumn("slot", drawn(seed, step, who) % F.col("out_degree")).drop("out_degree")
    return going.join(slots.drop("out_degree"), ["id", "slot"]).drop("slot")


def random_out_edge(graph: Graph, seed: int = 0, step: int = 0) -> DataFrame:
    """``id, neighbour``: for each vertex with out-edges the end of one of them, all being equally likely."""
    slots = edge_slots(graph)
    return _draw(graph.edges.select(F.col("src").alias("id")).distinct(), slots, seed, step, "id").select("id", "neighbour")


def random_walks(graph: Graph, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``start, step, id``: a walk over random out-edges from each ``starts.id``; it ends where there are none.

    Walks draw for themselves: those that meet at a vertex go on apart.
    """
    loop = Rounds("walks")
    slots = loop.keep(edge_slots(graph))
    at = loop.keep(starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id"))
    out = at
    for step in range(1, length + 1):
        moved = _draw(at, slots, seed, step, "start")
        at = loop.keep(moved.select("start", F.lit(step).alias("step"), F.col("neighbour").alias("id")))
        out = out.unionByName(at)
    return loop.result(out)


class Dealt:
    """Edges dealt by ``src`` once, to be joined with a value of every source in each round of a loop.

    The edges of a source with more than ``most``, and more than 1 / LARGE of all, are
    dealt over several tasks, to each of which the source's value is copied; so at
    most LARGE sources have copies, and their number of parts is broadcast.
    """

    def __init__(self, edges: DataFrame, most: int = 100_000):
        self._base = materialize(edges, "dealt")
        most = max(most, self._base.count() // LARGE)
        large = self._base.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most)
        self._held = materialize(large.select("src", F.ceil(F.col("n") / most).alias("_parts")), "large-sources")
        self._large = None if self._held.isEmpty() else F.broadcast(self._held)
        self.keys, edges = ["src"], self._base
        if self._large is not None:
            self.keys = ["src", "_part"]
            edges = edges.join(self._large, "src", "left")
            edges = edges.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("_parts"))).cast("long")).drop("_parts")
        self.edges = edges.repartition(*self.keys).persist()

    def join(self, values: DataFrame) -> DataFrame:
        """The edges with the columns of ``values`` (src and others) of their source."""
        if self._large is not None:
            values = values.join(self._large, "src", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0).cast("long"))))).drop("_parts")
        return self.edges.join(values, self.keys)

    def free(self) -> None:
        self.edges.unpersist()
        discard(self._base, self._held)
