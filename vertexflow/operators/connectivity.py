"""Weak and strong components, the giant component, and the bow-tie."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.plans.loop import Rounds

from .components import components
from .graph import Graph, degrees
from .rank import in_out_product_root
from .traversal import bfs, reach

#: Edges below which one task finishes a decomposition into strong components.
LOCAL_EDGES = 500_000


def weak_components(graph: Graph, isolated: bool = False) -> DataFrame:
    """``id, component``: the least id that undirected paths lead to; with ``isolated``, for all ids."""
    roots = components(graph.edges)
    every = graph.vertices() if isolated else degrees(graph).select("id")
    return every.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _strong_local(batches):
    """Tarjan's algorithm without recursion over all edges of one task: ``id, component``."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    edges = pd.concat(frames)
    out: dict[int, list[int]] = {}
    for a, b in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: set[int] = set()
    stack: list[int] = []
    found: list[tuple[int, int]] = []
    for start in out:
        if start in number:
            continue
        work = [(start, iter(out[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        open_.add(start)
        while work:
            v, ahead = work[-1]
            for w in ahead:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    open_.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in open_:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                    open_.difference_update(own)
                    least = min(own)
                    found += [(x, least) for x in own]
    yield pd.DataFrame(found, columns=["id", "component"], dtype="int64")


def _trim(loop: Rounds, edges: DataFrame) -> DataFrame:
    """Edges between vertices that have both in- and out-edges, until that holds for all ends."""
    count = edges.count()
    while count:
        both = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        edges = loop.keep(Graph(edges).within(both).edges)
        before, count = count, edges.count()
        if count == before:
            break
    return edges


def _colours(loop: Rounds, edges: DataFrame) -> DataFrame:
    """``id, colour``: the least id that reaches each vertex of ``edges``."""
    state = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("colour", F.col("id"))
    frontier = state = loop.keep(state)
    while True:
        found = edges.join(frontier, edges.src == frontier.id).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
        better = loop.keep(found.join(state, "id").where("new < colour").select("id", F.col("new").alias("colour")))
        if better.isEmpty():
            return state
        state = loop.keep(state.join(better, "id", "left_anti").unionByName(better))
        frontier = better


def strong_components(graph: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, component`` of all vertices with edges: the least id of the strong component.

    Vertices without in- or out-edges are trimmed.  Each vertex takes the least id
    that reaches it as its colour; those of a colour that lead back to its vertex
    are a component and leave.  Once fewer than ``local_edges`` edges are left, one
    task finishes them.
    """
    loop = Rounds("strong")
    every = degrees(graph).select("id")
    edges = loop.keep(graph.edges.select("src", "dst").distinct())
    done: DataFrame | None = None
    while True:
        left = edges.count()
        if left > local_edges:
            edges = _trim(loop, edges)
            left = edges.count()
        if not left:
            break
        if left <= local_edges:
            part = loop.keep(edges.coalesce(1).mapInPandas(_strong_local, "id long, component long"))
            done = part if done is None else done.unionByName(part)
            break
        colours = loop.keep(_colours(loop, edges))
        inner = edges.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        roots = colours.where("id = colour").select("id")
        members = bfs(Graph(inner.select("src", "dst")).reversed(), roots, local_edges=local_edges).select("id")
        part = loop.keep(colours.join(members, "id", "left_semi").select("id", F.col("colour").alias("component")))
        done = part if done is None else done.unionByName(part)
        edges = loop.keep(Graph(edges).without(part).edges)
    if done is None:
        return loop.result(every.withColumn("component", F.col("id")))
    return loop.result(every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def giant_component(graph: Graph, root: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (id) reached from the root, reaching it, and both: the root's strong component.

    Without ``root`` it is the vertex with the largest in-degree * out-degree.
    """
    root = in_out_product_root(graph) if root is None else root
    forward, backward = reach(graph, root), reach(graph, root, backward=True)
    return forward, backward, forward.join(backward, "id", "left_semi")


def split_giant(graph: Graph, root: int | None = None) -> tuple[Graph, Graph]:
    """The edges inside the giant strong component, and all others."""
    giant = giant_component(graph, root)[2]
    inside = graph.within(giant)
    flags = giant.withColumn("_in", F.lit(True))
    marked = graph.edges.join(flags.select(F.col("id").alias("src"), F.col("_in").alias("_a")), "src", "left").join(flags.select(F.col("id").alias("dst"), F.col("_in").alias("_b")), "dst", "left")
    return inside, Graph(marked.where("_a is null or _b is null").select(graph.edges.columns))


def bow_tie(graph: Graph, root: int | None = None) -> DataFrame:
    """``id, region`` of all vertices with edges.

    middle: the root's strong component; right: other vertices that it reaches;
    left: all that it doesn't reach.
    """
    forward, _, giant = giant_component(graph, root)
    marked = degrees(graph).select("id").join(forward.withColumn("_f", F.lit(1)), "id", "left").join(giant.withColumn("_g", F.lit(1)), "id", "left")
    region = F.when(F.col("_f").isNull(), "left").when(F.col("_g").isNull(), "right").otherwise("middle")
    return marked.select("id", region.alias("region"))


def bow_tie_counts(regions: DataFrame) -> DataFrame:
    """``region, vertices, ratio``."""
    total = regions.count()
    return regions.groupBy("region").agg(F.count("*").alias("vertices")).withColumn("ratio", F.col("vertices") / F.lit(max(total, 1)))
