"""Analyses over vertex values: top lists, histograms, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph, degrees


def top_vertices(vertices: DataFrame, value: str, n: int, where: Column | None = None, largest: bool = True) -> DataFrame:
    """The ``n`` rows of largest (or smallest) value, the least id on ties."""
    chosen = vertices if where is None else vertices.where(where)
    return chosen.orderBy(F.desc(value) if largest else F.asc(value), "id").limit(n)


def top_degree_vertices(graph: Graph, n: int, active: DataFrame | None = None) -> DataFrame:
    """``id, in_degree`` of the ``n`` vertices (among ``active``) of largest in-degree."""
    deg = degrees(graph).select("id", "in_degree")
    return top_vertices(deg if active is None else deg.join(active.select("id"), "id", "left_semi"), "in_degree", n)


def label_histogram(labels: DataFrame, label: str = "label", min_size: int = 1, visited_only: bool = False) -> DataFrame:
    """``label, vertices`` for labels of at least ``min_size`` vertices; ``visited_only`` leaves out null and negative ones."""
    rows = labels.where(F.col(label) >= 0) if visited_only else labels
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("vertices")).where(F.col("vertices") >= min_size)


def component_count(labels: DataFrame, label: str = "label") -> DataFrame:
    """``components``: distinct labels, with every unvisited (null or negative) vertex as one of its own."""
    lone = F.col(label).isNull() | (F.col(label) < 0)
    return labels.agg((F.count_distinct(F.when(~lone, F.col(label))) + F.coalesce(F.sum(lone.cast("long")), F.lit(0))).alias("components"))


def level_histogram(levels: DataFrame) -> DataFrame:
    """``component, level, vertices``."""
    return levels.groupBy("component", "level").agg(F.count("*").alias("vertices"))


def active_count(vertices: DataFrame, condition: Column) -> DataFrame:
    """``active, total``."""
    return vertices.agg(F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias("active"), F.count("*").alias("total"))


def fair_distinct(distinct: Column, draws: Column, below: int) -> Column:
    """Whether ``draws`` fair draws from ``below`` numbers give about this many different ones: within five deviations and five more."""
    free = F.exp(-draws / F.lit(float(below)))
    deviation = F.sqrt(below * free * F.greatest(F.lit(0.0), 1 - (1 + draws / F.lit(float(below))) * free))
    return F.abs(distinct - below * (1 - free)) <= 5 * deviation + 5


def inner_degree_check(graph: Graph, members: DataFrame) -> DataFrame:
    """``id, edges``: members of a strong component with fewer than two edges inside it; none are expected."""
    inside = degrees(graph.within(members)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("edges"))
    return members.select("id").join(inside, "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges")).where("edges < 2")
