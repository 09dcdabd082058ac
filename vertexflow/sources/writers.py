"""Writers: line formats as text columns, and files of them."""

from __future__ import annotations

import json
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.operators.graph import Graph, neighbours


def edge_lines(graph: Graph, delimiter: str = "\t", value_format: str | None = None) -> DataFrame:
    """``line``: src, dst and values; ``value_format`` (such as ``%.3f``) for the values."""
    values = [F.format_string(value_format, v) if value_format else F.col(v).cast("string") for v in graph.values]
    return graph.edges.select(F.concat_ws(delimiter, F.col("src"), F.col("dst"), *values).alias("line"))


def value_lines(vertices: DataFrame, value: str, delimiter: str = "\t") -> DataFrame:
    return vertices.select(F.concat_ws(delimiter, F.col("id"), F.col(value).cast("string")).alias("line"))


def component_lines(histogram: DataFrame) -> DataFrame:
    """``label, vertices, line`` by size downwards, then label, of a label histogram."""
    return histogram.select("label", "vertices", F.concat_ws(",", "label", "vertices").alias("line")).orderBy(F.desc("vertices"), "label")


def metis_lines(graph: Graph) -> DataFrame:
    """``row, line``: row 0 is the header ``n m``, row v + 1 the neighbours of v, numbered from 1 and sorted."""
    near = neighbours(graph)
    lists = near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("neighbour")), lambda x: x + 1), " ").alias("line"))
    rows = graph.vertices().join(lists, "id", "left").select((F.col("id") + 1).alias("row"), F.coalesce("line", F.lit("")).alias("line"))
    head = near.agg(F.concat(F.lit(f"{graph.size()} "), F.floor(F.count("*") / 2).cast("string")).alias("line"))
    return head.select(F.lit(0).cast("long").alias("row"), "line").unionByName(rows)


def adjacency_lines(graph: Graph) -> DataFrame:
    """``row, line``: row 0 is ``#vnum=n enum=m``, row v + 1 ``v d1 d2 ...`` of each vertex with out-edges."""
    rows = graph.edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("d"))
    rows = rows.select((F.col("src") + 1).alias("row"), F.concat_ws(" ", "src", "d").alias("line"))
    head = graph.edges.agg(F.concat(F.lit(f"#vnum={graph.size()} enum="), F.count("*").cast("string")).alias("line"))
    return head.select(F.lit(0).cast("long").alias("row"), "line").unionByName(rows)


def cassovary_lines(graph: Graph) -> DataFrame:
    """``line``: of every vertex with out-edges ``v n`` and then n lines with a target each, in one row with line ends."""
    lists = graph.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("d"))
    return lists.select(F.concat_ws("\n", F.concat_ws(" ", "src", F.size("d")), F.col("d").cast("array<string>")).alias("line"))


def write_binary(graph: Graph, path: str, value: str | None = None) -> None:
    """Files of little-endian records ``(uint32, uint32[, value])``; ``value`` is a numpy type such as ``<f4`` for column ``w``.

    Each file ends with a record of zeros, which is a self-loop and so no edge.
    """
    record = np.dtype([("src", "<u4"), ("dst", "<u4"), *([("w", value)] if value else [])])

    def pack(batches):
        for batch in batches:
            rows = np.zeros(batch.num_rows, record)
            for n in record.names:
                rows[n] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["raw"])

    packed = graph.edges.select(*record.names).mapInArrow(pack, "raw binary")
    packed.select(F.col("raw").cast("string")).write.mode("overwrite").option("lineSep", "\0" * record.itemsize).text(path)


def write_lines(lines: DataFrame, path: str, ordered: bool = False) -> None:
    """Text files of ``line``; with ``ordered``, by ``row`` over the files' names."""
    out = lines.repartitionByRange("row").sortWithinPartitions("row") if ordered else lines
    out.select("line").write.mode("overwrite").text(path)


class Metrics:
    """Named figures of a run, reported as text, HTML, rows or not at all."""

    def __init__(self):
        self.figures: dict[str, object] = {}

    def set(self, name: str, value) -> None:
        self.figures[name] = value

    def add(self, name: str, value) -> None:
        self.figures[name] = self.figures.get(name, 0) + value

    def report(self, kind: str = "basic") -> str:
        if kind == "null":
            return ""
        if kind == "json":
            return json.dumps(self.figures, default=str)
        if kind == "html":
            return "<table>" + "".join(f"<tr><td>{escape(k)}</td><td>{escape(str(v))}</td></tr>" for k, v in self.figures.items()) + "</table>"
        return "\n".join(f"{k}\t{v}" for k, v in self.figures.items())

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in self.figures.items()], "name string, value string")
