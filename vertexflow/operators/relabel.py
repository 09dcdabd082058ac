"""Relabelings: new dense ids for vertices, as tables ``old_id, new_id``.

Ranks over all vertices come from counts by ordered key: the number of vertices
with a smaller key is a running sum over the distinct keys, the number within a key
one over that key's spans of ids, and ranks within a span are numbered in parallel.
So no window runs over the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph, degrees

#: Ids whose ranks one task numbers.
SPAN = 1 << 16


def ranked(rows: DataFrame, *keys: Column, id_col: str = "id") -> DataFrame:
    """``rows`` with ``rank`` from 0, in the order of ``keys`` and then of the whole-number id."""
    named = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)}).withColumn("_span", F.floor(F.col(id_col) / SPAN))
    own = [f"_k{i}" for i in range(len(keys))]
    by = [*own, "_span"]
    sizes = named.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*own).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if own:  # one row for each key is put in order, and each key's spans by themselves
        ahead = F.coalesce(F.sum("_all").over(W.orderBy(*own).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        totals = sizes.groupBy(*own).agg(F.sum("_n").alias("_all")).select(*own, ahead.alias("_ahead"))
        sizes, before = sizes.join(totals, own), before + F.col("_ahead")
    starts = sizes.select(*by, before.alias("_start"))
    within = named.withColumn("_row", F.row_number().over(W.partitionBy(*by).orderBy(id_col)))
    joined = within.join(starts, by)
    return joined.select(*rows.columns, (F.col("_start") + F.col("_row") - 1).alias("rank"))


def hash_relabel(vertices: DataFrame, size: int, parts: int) -> DataFrame:
    """Ids dealt by id modulo ``parts``, each part contiguous: a closed form of the id alone."""
    bucket = F.pmod(F.col("id"), F.lit(parts))
    start = bucket * (size // parts) + F.least(bucket, F.lit(size % parts))
    return vertices.select(F.col("id").alias("old_id"), (F.floor(F.col("id") / parts) + start).alias("new_id"))


def hash_intervals(spark, size: int, parts: int) -> DataFrame:
    """``part, start_id, end_id`` (closed) of :func:`hash_relabel`."""
    p = F.col("id")
    start = p * (size // parts) + F.least(p, F.lit(size % parts))
    length = F.lit(size // parts) + (p < size % parts).cast("long")
    return spark.range(parts).select(p.cast("int").alias("part"), start.alias("start_id"), (start + length - 1).alias("end_id"))


def degree_sort(graph: Graph) -> DataFrame:
    """``new_id, old_id, degree``: by total degree downwards, then id; the new ids are those of non-isolated vertices, upwards."""
    total = degrees(graph).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    by_degree = ranked(total, -F.col("degree")).withColumnRenamed("id", "old_id")
    by_id = ranked(total.select("id")).withColumnRenamed("id", "new_id")
    return by_degree.join(by_id, "rank").select("new_id", "old_id", "degree")


def order_by_degree(graph: Graph) -> DataFrame:
    """``old_id, new_id``: all ids from 0, by total degree upwards, then id."""
    every = degrees(graph, isolated=True).select("id", (F.col("in_degree") + F.col("out_degree")).alias("_d"))
    return ranked(every, F.col("_d")).select(F.col("id").alias("old_id"), F.col("rank").alias("new_id"))


def apply_map(graph: Graph, vmap: DataFrame) -> Graph:
    """The graph with both ends of every edge renamed by ``vmap`` (old_id, new_id)."""
    src = vmap.select(F.col("old_id").alias("src"), F.col("new_id").alias("_s"))
    dst = vmap.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_d"))
    moved = graph.edges.join(src, "src").join(dst, "dst")
    return Graph(moved.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *graph.values))


def group_relabel(members: DataFrame, *order: Column) -> DataFrame:
    """``old_id, new_id`` from 0: groups in the order of ``order``, ids within a group upwards."""
    return ranked(members, *order).select(F.col("id").alias("old_id"), F.col("rank").alias("new_id"))


def group_intervals(members: DataFrame, part: str) -> DataFrame:
    """``part, start_id, end_id`` (closed) of the ranges that :func:`group_relabel` gives to each part."""
    sizes = members.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("_n"))
    end = F.sum("_n").over(W.orderBy("part"))
    return sizes.select("part", (end - F.col("_n")).alias("start_id"), (end - 1).alias("end_id"))


def partition_file_map(parts: DataFrame, graph: Graph | None = None) -> DataFrame:
    """``old_id, new_id`` from a partition table (id, part); with ``graph``, of its non-isolated vertices only."""
    vmap = group_relabel(parts, F.col("part"))
    return vmap if graph is None else vmap.join(degrees(graph).select(F.col("id").alias("old_id")), "old_id", "left_semi")


def bow_tie_map(regions: DataFrame) -> DataFrame:
    """``old_id, new_id``: the left ids first, then the middle's, then the right's."""
    place = F.when(F.col("region") == "left", 0).when(F.col("region") == "middle", 1).otherwise(2)
    return group_relabel(regions, place)


def component_map(levels: DataFrame, top: int = 20) -> DataFrame:
    """``old_id, new_id`` from (id, component, level).

    Components go by size downwards; all but the ``top`` largest are pooled at
    level 0.  Within one, vertices go by level, unreached ones last.
    """
    sizes = levels.groupBy("component").agg(F.count("*").alias("_n"))
    largest = sizes.orderBy(F.desc("_n"), "component").limit(top)
    places = largest.withColumn("_place", F.row_number().over(W.orderBy(F.desc("_n"), "component")) - 1).select("component", "_place")
    placed = levels.join(F.broadcast(places), "component", "left").withColumn("_place", F.coalesce("_place", F.lit(top)))
    level = F.when(F.col("_place") == top, F.lit(0)).otherwise(F.coalesce("level", F.lit((1 << 62))))
    return group_relabel(placed.select("id", "_place", level.alias("_level")), F.col("_place"), F.col("_level"))


def block_map(blocks: DataFrame, assignment: DataFrame) -> DataFrame:
    """``old_id, new_id`` from (id, block) and (block, part): parts in order, blocks in order inside them."""
    return group_relabel(blocks.join(assignment, "block").select("id", "part", "block"), F.col("part"), F.col("block"))
