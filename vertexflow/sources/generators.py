"""Graphs made by rule, and random weights, all from ``spark.range`` and hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.functions.scalars import drawn
from vertexflow.operators.graph import Graph


def _steps(spark: SparkSession, size: int, moves: list[tuple[Column, Column]]) -> Graph:
    """Edges from every id below ``size`` to each target whose condition holds."""
    targets = F.array(*[F.when(ok, to) for ok, to in moves])
    return Graph(spark.range(size).select(F.col("id").alias("src"), F.explode(targets).alias("dst")).where("dst is not null"))


def lattice(spark: SparkSession, n: int, dimensions: int) -> Graph:
    """An n ** dimensions lattice with an edge to the next vertex in each dimension."""
    v, moves = F.col("id"), []
    for d in range(dimensions):
        stride = n**d
        moves.append((F.pmod(F.floor(v / stride), F.lit(n)) < n - 1, v + stride))
    return _steps(spark, n**dimensions, moves)


def chain(spark: SparkSession, n: int) -> Graph:
    return lattice(spark, n, 1)


def grid(spark: SparkSession, n: int) -> Graph:
    return lattice(spark, n, 2)


def cube_grid(spark: SparkSession, n: int) -> Graph:
    return lattice(spark, n, 3)


def quad_grid(spark: SparkSession, n: int) -> Graph:
    return lattice(spark, n, 4)


def cross_grid(spark: SparkSession, n: int) -> Graph:
    """A grid with both diagonals to the right."""
    v = F.col("id")
    x, y = F.pmod(v, F.lit(n)), F.floor(v / n)
    right, down = x < n - 1, y < n - 1
    return _steps(spark, n * n, [(right, v + 1), (down, v + n), (right & down, v + n + 1), (right & (y > 0), v - n + 1)])


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Every pair i < j with probability ``floor(p * 10000) / 10000`` and either direction.

    Each i draws the gaps between its partners, so the work is in proportion to the
    edges.  Numbers depend on the seed and i alone.
    """
    p = math.floor(p * 10_000) / 10_000

    def draw(frames):
        for frame in frames:
            src, dst = [], []
            for i in frame["id"].tolist():
                rng, at = np.random.default_rng((seed, i)), i
                while p > 0 and at < n - 1:
                    j = at + np.cumsum(rng.geometric(p, int(min((n - 1 - at) * p * 1.2 + 16, 1 << 20))))
                    at, j = int(j[-1]), j[j < n]
                    ahead = rng.random(len(j)) < 0.5
                    src.append(np.where(ahead, i, j))
                    dst.append(np.where(ahead, j, i))
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return Graph(spark.range(max(0, n - 1)).mapInPandas(draw, "src long, dst long"))


def random_weights(graph: Graph, seed: int = 0, below: int = 100_000_000, name: str = "w") -> Graph:
    """A whole-number weight in [0, below) for every edge, by a hash of its ends and of its place among parallel ones."""
    place = F.row_number().over(W.partitionBy("src", "dst").orderBy(*[F.col(v) for v in graph.values] or [F.lit(0)]))
    edges = graph.edges.withColumn("_place", place)
    return Graph(edges.withColumn(name, drawn(seed, "src", "dst", "_place") % F.lit(below)).drop("_place"))


def vertex_sample(vertices: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Vertices drawn with probability ``rate``, by a hash of their ids."""
    return vertices.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(rate * 1_000_000))
