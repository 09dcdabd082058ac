"""Breadth-first search, shortest paths, level dumps and multi-source labelling.

Each round joins the edges with the frontier only, which is every vertex whose
value changed in the round before, and anti-joins what has been reached.  A graph
that was counted to have LOCAL_EDGES edges at most is worked through by one task
instead, with the same frontiers over arrays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.plans.loop import MERGE_EVERY, Rounds
from vertexflow.storage import discard, materialize

from .graph import Graph


#: Edges that one task takes: 24 bytes each.
LOCAL_EDGES = 2_000_000


class _Local:
    """A task's edges by source, and the starting vertices; ``src`` is null in the rows of the latter."""

    def __init__(self, frames):
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"src": [], "dst": [], "x": []})])
        starts = rows["src"].isna()
        own, edges = rows[starts], rows[~starts]
        src, dst = edges["src"].to_numpy("int64"), edges["dst"].to_numpy("int64")
        self.ids = np.unique(np.concatenate([src, dst, own["dst"].to_numpy("int64")]))
        order = np.argsort(src, kind="stable")
        self.dst, self.x = np.searchsorted(self.ids, dst[order]), edges["x"].to_numpy("float64")[order]
        self.first = np.searchsorted(src[order], self.ids)
        self.last = np.searchsorted(src[order], self.ids, "right")
        self.starts, self.values = np.searchsorted(self.ids, own["dst"].to_numpy("int64")), own["x"].to_numpy("float64")

    def out(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the frontier's edges, and for each the place of its source in the frontier."""
        n = self.last[frontier] - self.first[frontier]
        ends = np.cumsum(n)
        at = np.repeat(np.arange(len(frontier)), n)
        return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + self.first[frontier][at], at


def _in_one_task(edges: DataFrame, starts: DataFrame, run, schema: str) -> DataFrame:
    null = F.lit(None).cast("long")
    rows = edges.unionByName(starts.select(null.alias("src"), F.col("id").alias("dst"), F.col("x")))
    return materialize(rows.coalesce(1).mapInPandas(run, schema), "local")


def _levels_run(most: int | None):
    def run(frames):
        g = _Local(frames)
        level, label = np.full(len(g.ids), -1), np.full(len(g.ids), np.inf)
        np.minimum.at(label, g.starts, g.values)
        frontier, now = np.unique(g.starts), 0
        level[frontier] = 0
        while len(frontier) and (most is None or now < most):
            now += 1
            edge, at = g.out(frontier)
            fresh = level[g.dst[edge]] < 0
            to = g.dst[edge][fresh]
            np.minimum.at(label, to, label[frontier[at[fresh]]])
            frontier = np.unique(to)
            level[frontier] = now
        met = level >= 0
        yield pd.DataFrame({"id": g.ids[met], "level": level[met], "label": label[met].astype("int64")})

    return run


def _paths_run(frames):
    g = _Local(frames)
    distance = np.full(len(g.ids), np.inf)
    distance[g.starts] = 0
    frontier = np.unique(g.starts)
    while len(frontier):
        edge, at = g.out(frontier)
        before = distance.copy()
        np.minimum.at(distance, g.dst[edge], distance[frontier[at]] + g.x[edge])
        frontier = np.flatnonzero(distance < before)
    met = np.isfinite(distance)
    yield pd.DataFrame({"id": g.ids[met], "distance": distance[met]})


def blocks_in_one_task(edges: DataFrame, active: DataFrame, total: int, roots: int, levels: int, stop_ratio: float, rounds: int) -> DataFrame:
    """``id, block, level``: the rounds of ``partition.multi_source_blocks`` that are left, for ``active`` (id, in_degree) of ``total`` vertices."""

    def run(frames):
        g = _Local(frames)
        free = np.zeros(len(g.ids), bool)
        free[g.starts] = True
        order = g.starts[np.lexsort((g.starts, -g.values))]
        left, out = len(order), [pd.DataFrame({"id": [], "block": [], "level": []}, dtype="int64")]
        for _ in range(rounds):
            if not left or left < total * stop_ratio:
                break
            order = order[free[order]]
            frontier = np.sort(order[:roots])
            label, now = np.full(len(g.ids), np.iinfo("int64").max), 0
            label[frontier] = g.ids[frontier]
            while len(frontier):
                free[frontier] = False
                out.append(pd.DataFrame({"id": g.ids[frontier], "block": label[frontier], "level": np.full(len(frontier), now)}))
                left -= len(frontier)
                if now >= levels - 1:
                    break
                now += 1
                edge, at = g.out(frontier)
                fresh = free[g.dst[edge]]
                to = g.dst[edge][fresh]
                np.minimum.at(label, to, label[frontier[at[fresh]]])
                frontier = np.unique(to)
        yield pd.concat(out)

    return _in_one_task(edges.select("src", "dst", F.lit(0.0).alias("x")), active.select("id", F.col("in_degree").cast("double").alias("x")), run, "id long, block long, level long")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def spread(edges: DataFrame, roots: DataFrame, most: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """:func:`label_levels` by the distributed loop, over a table of edges; with ``among`` (id) through these vertices only."""
    loop = Rounds("levels")
    frontier = loop.keep(roots.groupBy("id").agg(F.min("label").alias("label")).select("id", F.lit(0).cast("long").alias("level"), "label"))
    layers, level = [frontier], 0
    while (most is None or level < most) and not frontier.isEmpty():
        level += 1
        reached = edges.join(frontier, edges.src == frontier.id).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label"))
        reached = reached.join(_union(layers).select("id"), "id", "left_anti")
        if among is not None:
            reached = reached.join(among.select("id"), "id", "left_semi")
        frontier = loop.keep(reached.select("id", F.lit(level).cast("long").alias("level"), "label"))
        layers.append(frontier)
        if len(layers) >= MERGE_EVERY:
            layers = [loop.result(_union(layers))]
            frontier = layers[0].where(F.col("level") == level)
    return loop.result(_union(layers))


def label_levels(graph: Graph, roots: DataFrame, most: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, level, label`` of all vertices that edges lead to from ``roots`` (id, label).

    A vertex takes the least label among those that reach it first.  ``most``: the
    deepest level.  Roots that repeat keep their least label.
    """
    edges = materialize(graph.edges.select("src", "dst").distinct(), "edges")
    if edges.count() <= local_edges:
        starts = roots.select("id", F.col("label").cast("double").alias("x"))
        out = _in_one_task(edges.withColumn("x", F.lit(0.0)), starts, _levels_run(most), "id long, level long, label long")
        discard(edges)
        return out
    out = spread(edges, roots, most)
    discard(edges)
    return out


def bfs(graph: Graph, roots: DataFrame, most: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, level``: fewest edges from any of ``roots`` (id)."""
    return label_levels(graph, roots.select("id", F.lit(0).cast("long").alias("label")), most, local_edges).select("id", "level")


def reach(graph: Graph, root: int, backward: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id``: vertices that ``root`` reaches, itself included; ``backward``: those that reach it."""
    start = graph.edges.sparkSession.range(root, root + 1)
    return bfs(graph.reversed() if backward else graph, start, local_edges=local_edges).select("id")


def shortest_paths(graph: Graph, root: int, weight: str = "w", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, distance`` of all vertices that ``root`` reaches, by non-negative edge weights."""
    loop = Rounds("paths")
    edges = materialize(graph.edges.groupBy("src", "dst").agg(F.min(weight).cast("double").alias("w")), "edges")
    known = frontier = edges.sparkSession.range(root, root + 1).select("id", F.lit(0.0).alias("distance"))
    if edges.count() <= local_edges:
        out = _in_one_task(edges.withColumnRenamed("w", "x"), known.withColumnRenamed("distance", "x"), _paths_run, "id long, distance double")
        discard(edges)
        return out
    while True:
        found = edges.join(frontier, edges.src == frontier.id).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        better = found.join(known, "id", "left").where("distance is null or new < distance").select("id", F.col("new").alias("distance"))
        better = loop.keep(better)
        if better.isEmpty():
            break
        before, known = known, loop.keep(known.join(better, "id", "left_anti").unionByName(better))
        loop.drop(before, frontier)
        frontier = better
    out = loop.result(known)
    discard(edges)
    return out


def level_edges(graph: Graph, root: int, levels: int = 3) -> DataFrame:
    """``src, dst`` of every edge that leaves a vertex at depth below ``levels`` from ``root``."""
    start = graph.edges.sparkSession.range(root, root + 1)
    near = bfs(graph, start, levels - 1).select(F.col("id").alias("src"))
    return graph.edges.join(near, "src", "left_semi").select("src", "dst")


def component_levels(graph: Graph, components: DataFrame, directed: bool = True) -> DataFrame:
    """``id, component, level``: distance from the least vertex of each component (id, component).

    With ``directed`` only along edges, so a level may be null: not reached.
    """
    roots = components.where("id = component").select("id", F.col("component").alias("label"))
    found = label_levels(graph if directed else graph.undirected(), roots)
    return components.join(found.select("id", "level"), "id", "left").select("id", "component", "level")
