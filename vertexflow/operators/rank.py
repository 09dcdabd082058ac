"""PageRank, unnormalised: r(v) = 0.15 + 0.85 * sum of r(u) / out-degree(u) over in-edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.plans.loop import iterate

from .graph import Dealt, Graph, degrees

RESET, DAMPING = 0.15, 0.85


class Ranked(NamedTuple):
    ranks: DataFrame
    log: list[dict]


def _links(graph: Graph) -> Dealt:
    """``src, dst, share``: parallel edges together, share of the source's rank."""
    out = graph.edges.groupBy("src").agg(F.count("*").alias("n"))
    many = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    return Dealt(many.join(out, "src").select("src", "dst", (F.col("m") / F.col("n")).alias("share")))


def pagerank(graph: Graph, iterations: int = 10, epsilon: float | None = None, watch: tuple[int, ...] = (), audit: DataFrame | None = None, audit_epsilon: float = 1e-3, start: DataFrame | None = None) -> Ranked:
    """Ranks ``id, rank`` of all ids after ``iterations``, or once no rank moves by more than ``epsilon``.

    Every rank begins at 1, or as ``start`` (id, rank) has it.  The log has for each
    iteration the sum and the largest of the changes and the sum of ranks; with
    ``watch``, those vertices' ranks too; with ``audit`` (id, rank), the L1 distance
    from it and how many ranks differ from it by more than ``audit_epsilon``.
    """
    links = _links(graph)
    state = start.select("id", "rank") if start is not None else graph.vertices().withColumn("rank", F.lit(1.0))
    targets = graph.vertices()

    def step(state: DataFrame, _: int) -> DataFrame:
        sums = links.join(state.withColumnRenamed("id", "src")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("s"))
        return targets.join(sums, targets.id == sums.dst, "left").select("id", (RESET + DAMPING * F.coalesce("s", F.lit(0.0))).alias("rank"))

    def measure(new: DataFrame, old: DataFrame) -> dict:
        both = new.join(old.withColumnRenamed("rank", "old"), "id")
        change = F.abs(F.col("rank") - F.col("old"))
        made = [F.coalesce(F.sum(change), F.lit(0.0)).alias("delta"), F.coalesce(F.max(change), F.lit(0.0)).alias("largest"), F.coalesce(F.sum("rank"), F.lit(0.0)).alias("total")]
        made += [F.max(F.when(F.col("id") == v, F.col("rank"))).alias(f"rank_{v}") for v in watch]
        if audit is not None:
            both = both.join(audit.select("id", F.col("rank").alias("final")), "id")
            off = F.abs(F.col("rank") - F.col("final"))
            made += [F.sum(off).alias("l1"), F.sum((off > audit_epsilon).cast("long")).alias("active")]
        return both.agg(*made).first().asDict()

    tell = measure if epsilon is not None or watch or audit is not None else None
    ranks, progress = iterate(state, step, iterations, tell, (lambda m: m["largest"] <= epsilon) if epsilon is not None else None, "rank", fuse=5)
    links.free()
    return Ranked(ranks, progress.measures)


def delta_log(spark, log: list[dict]) -> DataFrame:
    """``iteration, delta, largest, total`` of a run, as a table."""
    return spark.createDataFrame([(m["iteration"], m["delta"], m["largest"], m["total"]) for m in log], "iteration int, delta double, largest double, total double")


def vertex_total(vertices: DataFrame, value: str, start: int = 0, end: int | None = None) -> DataFrame:
    """``total``: the sum of a vertex value over ids in [start, end)."""
    part = vertices.where(F.col("id") >= start)
    return (part if end is None else part.where(F.col("id") < end)).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def in_out_product_root(graph: Graph) -> int:
    """The vertex with the largest in-degree * out-degree, the least id on ties; 0 if all products are 0."""
    top = degrees(graph).select("id", (F.col("in_degree") * F.col("out_degree")).alias("p")).orderBy(F.desc("p"), "id").first()
    return top.id if top and top.p else 0
