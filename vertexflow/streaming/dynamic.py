"""Graphs that grow and shrink: batches of added and removed edges on a stored edge table.

Additions and removals are appended to logs, which costs in proportion to the
batch.  The graph is the base with the logs applied; when the logs are large
against the base, compaction writes a new base by ranges of ``dst``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexflow.operators.graph import Graph, degrees
from vertexflow.storage import new_path

#: Share of the base that the logs may reach before compaction.
BUFFERED, DELETED = 0.8, 0.1


class DynamicGraph:
    """``max_buffered``: edges that the log of additions may hold, in place of a share of the base."""

    def __init__(self, spark: SparkSession, edges: DataFrame, path: str | None = None, max_buffered: int | None = None):
        self.spark, self.root = spark, path or new_path(spark, "dynamic")
        self.schema, self.version, self.batch, self.max_buffered = edges.schema, 0, 0, max_buffered
        Graph(edges).edges.write.parquet(f"{self.root}/base-0")
        self.stop_after: int | None = None
        self.stopped = False

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}-{self.version}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _log(self, name: str, rows: DataFrame) -> None:
        """A batch has a folder of its own, so that writing it again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}-{self.version}/batch={self.batch}")

    def added(self) -> DataFrame:
        return self._table("added", f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema)}, batch long")

    def removed(self) -> DataFrame:
        return self._table("removed", "kind string, src long, dst long, batch long")

    def add_edges(self, edges: DataFrame) -> None:
        """Append edges; self-loops are left out."""
        self.batch += 1
        self._log("added", Graph(edges).edges.select(*self.schema.names))

    def _remove(self, kind: str, src, dst, rows: DataFrame) -> None:
        self.batch += 1
        self._log("removed", rows.select(F.lit(kind).alias("kind"), src.cast("long").alias("src"), dst.cast("long").alias("dst")))

    def remove_edges(self, edges: DataFrame) -> None:
        """Remove all edges between the ends of ``edges`` (src, dst) that are there by now."""
        self._remove("edge", F.col("src"), F.col("dst"), edges)

    def remove_out_edges(self, vertices: DataFrame) -> None:
        self._remove("out", F.col("id"), F.lit(None), vertices)

    def remove_in_edges(self, vertices: DataFrame) -> None:
        self._remove("in", F.lit(None), F.col("id"), vertices)

    def remove_all_edges(self, vertices: DataFrame) -> None:
        self.remove_out_edges(vertices)
        self.remove_in_edges(vertices)

    def edges(self) -> DataFrame:
        """The edges of now: those that no later removal names."""
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/base-{self.version}").withColumn("batch", F.lit(0).cast("long"))
        every, gone = base.unionByName(self.added()), self.removed()
        for kind, keys in (("edge", ["src", "dst"]), ("out", ["src"]), ("in", ["dst"])):
            last = gone.where(F.col("kind") == kind).groupBy(*keys).agg(F.max("batch").alias("_last"))
            every = every.join(last, keys, "left").where("_last is null or batch > _last").drop("_last")
        return every.select(*self.schema.names)

    def graph(self) -> Graph:
        return Graph(self.edges())

    def degrees(self) -> DataFrame:
        return degrees(self.graph())

    def info(self) -> dict:
        """Figures of the state: edges, buffered additions and removals, version, batches."""
        return {"edges": self.edges().count(), "buffered": self.added().count(), "removals": self.removed().count(), "version": self.version, "batches": self.batch}

    def compact_if_needed(self) -> bool:
        base = self.spark.read.parquet(f"{self.root}/base-{self.version}").count()
        most = self.max_buffered if self.max_buffered is not None else base
        due = self.added().count() >= BUFFERED * most > 0 or self.removed().count() >= DELETED * max(base, 1)
        if due:
            self.compact()
        return due

    def compact(self) -> None:
        """Write a new base, after which the logs begin anew.  Readers of the old version are not disturbed."""
        edges = self.edges()
        edges.repartitionByRange("dst").sortWithinPartitions("src").write.parquet(f"{self.root}/base-{self.version + 1}")
        self.version += 1

    def finish_after(self, batches: int) -> None:
        """Stop a running stream after so many more batches."""
        self.stop_after = batches

    def consume(self, stream: DataFrame, checkpoint: str, on_batch: Callable[[DynamicGraph, int], None] | None = None, **trigger) -> StreamingQuery:
        """Start a query that applies ``stream`` (op: add or remove, src, dst, values) batch by batch.

        ``on_batch`` runs after each, say to update ranks from the ranks before.  Back
        pressure is the source's: maxFilesPerTrigger and the like.
        """

        first = self.batch

        def apply(rows: DataFrame, number: int) -> None:
            if self.stopped:
                return
            rows = rows.persist()
            self.batch = first + 2 * number  # a batch that is applied again replaces its own logs
            self.add_edges(rows.where("op = 'add'").select(*self.schema.names))
            self.remove_edges(rows.where("op = 'remove'"))
            rows.unpersist()
            self.compact_if_needed()
            if on_batch:
                on_batch(self, number)
            if self.stop_after is not None:
                self.stop_after -= 1
                self.stopped = self.stop_after <= 0

        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_values(graph: Graph, vector: str, value) -> Graph:
    """Edges with one more element in their array ``vector``."""
    return Graph(graph.edges.withColumn(vector, F.array_append(vector, value)))
