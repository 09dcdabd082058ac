"""Readers for graph files: text edge lists, adjacency lists, METIS, Cassovary, binary.

All of them leave out self-loops and keep parallel edges.  Text readers split on
runs of the format's delimiters and skip lines that begin with ``#`` or ``%``.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.operators.graph import Graph
from vertexflow.storage import materialize

#: Binary records that are decoded together.
RECORDS = 50_000

#: Types of edge values by name, and the Spark types that hold them.
VALUE_TYPES = {"int": "int", "uint": "long", "short": "short", "float": "float", "double": "double", "char": "string", "boolean": "boolean", "long": "long"}


def parse_value(token: Column, kind: str) -> Column:
    """A value of a named type from its text; ``a-b`` names a pair, both halves from the same text."""
    if "-" in kind:
        left, right = kind.split("-")
        return F.struct(parse_value(token, left).alias("left"), parse_value(token, right).alias("right"))
    if kind == "char":
        return F.substring(token, 1, 1)
    if kind == "boolean":
        return token.try_cast("int") == 1
    return token.try_cast(VALUE_TYPES[kind])


def _lines(spark: SparkSession, path: str, delimiters: str) -> DataFrame:
    lines = spark.read.text(path).where("value not rlike '^[#%]' and trim(value) != ''")
    return lines.select(F.split(F.trim(F.regexp_replace("value", f"[{delimiters}\r]+", " ")), " ").alias("t"))


def read_edge_list(spark: SparkSession, path: str, value: str | None = None, default=None, base: int = 0) -> Graph:
    """Lines ``src dst [value]``, delimited by tabs, commas and blanks; ``default`` where there is no value."""
    lines = _lines(spark, path, "\t, ")
    cols = [(F.get("t", F.lit(i)).cast("long") - base).alias(c) for i, c in enumerate(("src", "dst"))]
    if value:
        cols.append(F.coalesce(parse_value(F.get("t", F.lit(2)), value), *([F.lit(default)] if default is not None else [])).alias("w"))
    return Graph(lines.select(*cols))


def read_multi_value(spark: SparkSession, path: str, value: str = "int") -> Graph:
    """Lines ``src dst a:b:c``; the values become an array."""
    lines = _lines(spark, path, "\t, ")
    parsed = F.transform(F.split(F.get("t", F.lit(2)), ":"), lambda v: parse_value(v, value))
    return Graph(lines.select(F.get("t", F.lit(0)).cast("long").alias("src"), F.get("t", F.lit(1)).cast("long").alias("dst"), F.coalesce(parsed, F.array()).alias("w")))


def read_adjacency(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Lines ``src n d1 ... dn``: the graph, and the lines (src, stated, found) whose n is wrong.

    Edges of such lines belong to the graph too.
    """
    lines = _lines(spark, path, "\t ")
    rows = lines.select(F.get("t", F.lit(0)).cast("long").alias("src"), F.coalesce(F.get("t", F.lit(1)).cast("int"), F.lit(0)).alias("stated"), F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))).alias("d"))
    wrong = rows.select("src", "stated", F.size("d").alias("found")).where("stated != found")
    return Graph(rows.select("src", F.explode(F.transform("d", lambda x: x.cast("long"))).alias("dst"))), wrong


def numbered_lines(spark: SparkSession, path: str, skip: str = "false") -> DataFrame:
    """``row, value``: the lines of text files numbered from 0, files by name, but for those that meet ``skip``.

    Every split of a file is numbered by itself and begins after the splits before
    it; what is put in order is one row for each split.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).withColumns({"file": meta.getField("file_path"), "block": meta.getField("file_block_start")})
    lines = lines.where(f"not ({skip})").withColumn("at", F.monotonically_increasing_id())
    lines = materialize(lines, "lines")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", "first", before.alias("start"))
    return lines.join(F.broadcast(splits), ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("row"), "value", "file", "block", "at")


def read_metis(spark: SparkSession, path: str, base: int = 1) -> Graph:
    """A header ``n m`` and then a line of neighbours for each vertex; each undirected edge is kept once.

    Several files are one graph, in the order of their names.
    """
    lines = numbered_lines(spark, path, "startswith(value, '%')").where("row > 0")
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    near = lines.select((F.col("row") - 1).alias("src"), F.explode(tokens).alias("t")).where("t != ''")
    return Graph(near.select("src", (F.col("t").cast("long") - base).alias("dst")).where("src < dst"))


def read_cassovary(spark: SparkSession, path: str) -> Graph:
    """Files of a directory or pattern, but those with ``.tmp``: ``src n``, then n lines with a target each.

    A line of two numbers begins a vertex.  Its number is carried down the lines of a
    split, and from the last such line before a split into it.
    """
    lines = numbered_lines(spark, path, "trim(value) = '' or contains(_metadata.file_path, '.tmp')")
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select("file", "block", "at", tokens.alias("t")).select("file", "block", "at", F.get("t", F.lit(0)).cast("long").alias("id"), (F.size("t") > 1).alias("head"))
    rows = rows.withColumn("owner", F.when(F.col("head"), F.col("id")))
    ends = rows.groupBy("file", "block").agg(F.max_by("owner", F.when(F.col("head"), F.col("at"))).alias("last"))
    carried = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("file", "block", carried.alias("carried"))
    within = F.last("owner", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("at"))
    owned = rows.withColumn("src", within).where("not head").join(F.broadcast(ends), ["file", "block"])
    return Graph(owned.select(F.coalesce("src", "carried").alias("src"), F.col("id").alias("dst")))


def read_binary(spark: SparkSession, path: str, value: str | None = None) -> Graph:
    """Little-endian records ``(uint32, uint32[, value])`` of one or more files; ``value`` is a numpy type such as ``<f4``.

    Records have a fixed size, so files of any size are read in splits.
    """
    record = np.dtype([("src", "<u4"), ("dst", "<u4"), *([("w", value)] if value else [])])
    kind = {None: "", "f": ", w double", "i": ", w long", "u": ", w long"}[np.dtype(value).kind if value else None]

    def together(records):
        while part := b"".join(islice(records, RECORDS)):
            yield Row(raw=bytearray(part))

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = np.frombuffer(raw.as_buffer(), record)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n].astype("float64" if n == "w" and kind.endswith("double") else "int64")) for n in record.names], list(record.names))

    blocks = spark.createDataFrame(spark.sparkContext.binaryRecords(path, record.itemsize).mapPartitions(together), "raw binary")
    return Graph(blocks.mapInArrow(parse, f"src long, dst long{kind}"))


def read_graph(spark: SparkSession, path: str, kind: str = "auto", value: str | None = None, **options) -> Graph:
    """The reader for ``kind``: edgelist (also ``auto``), adjlist, binedgelist, multivalueedgelist, metis, cassovary."""
    if kind in ("auto", "edgelist"):
        return read_edge_list(spark, path, value, **options)
    if kind == "multivalueedgelist":
        return read_multi_value(spark, path, value or "int")
    if kind == "adjlist":
        return read_adjacency(spark, path)[0]
    if kind == "metis":
        return read_metis(spark, path, **options)
    if kind == "cassovary":
        return read_cassovary(spark, path)
    if kind == "binedgelist":
        return read_binary(spark, path, value)
    raise ValueError(f"no reader for {kind!r}")


def cached_graph(spark: SparkSession, path: str, store: str, kind: str = "auto", value: str | None = None, check_time: bool = True) -> Graph:
    """The graph from Parquet in ``store``, which is made anew when the source is newer (unless not ``check_time``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def newest(p: str) -> int:
        at = hadoop.Path(p)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return max((f.getModificationTime() for f in found), default=-1) if found else -1

    made = newest(store)
    if made < 0 or (check_time and newest(path) > made):
        write_graph(read_graph(spark, path, kind, value), store)
    return Graph(spark.read.parquet(store))


def write_graph(graph: Graph, path: str, parts: int | None = None) -> None:
    """Parquet by ranges of ``dst``, sorted by ``src``: statistics of its row groups then prune both."""
    edges = graph.edges.repartitionByRange(parts, "dst") if parts else graph.edges.repartitionByRange("dst")
    edges.sortWithinPartitions("src").write.mode("overwrite").parquet(path)


def read_vertex_values(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Vertex values from Parquet for ids in [start, end); the range is pushed to the scan."""
    rows = spark.read.parquet(path).where(F.col("id") >= start)
    return rows if end is None else rows.where(F.col("id") < end)


def read_partition_file(spark: SparkSession, path: str) -> DataFrame:
    """``id, part`` from a file with one part on each line; the line's number is the vertex.  Several files are one, by name."""
    return numbered_lines(spark, path, "trim(value) = ''").select(F.col("row").alias("id"), F.trim("value").cast("int").alias("part"))


def read_vertex_map(spark: SparkSession, path: str) -> DataFrame:
    """``old_id, new_id`` from lines of two ids; lines that begin with ``#`` are skipped."""
    return _lines(spark, path, "\t, ").select(F.get("t", F.lit(0)).cast("long").alias("old_id"), F.get("t", F.lit(1)).cast("long").alias("new_id"))


def read_intervals(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(part, start, end) from lines ``start end``; a short file by nature."""
    rows = _lines(spark, path, "\t, ").select(F.get("t", F.lit(0)).cast("long").alias("s"), F.get("t", F.lit(1)).cast("long").alias("e")).orderBy("s").collect()
    return [(i, r.s, r.e) for i, r in enumerate(rows)]
