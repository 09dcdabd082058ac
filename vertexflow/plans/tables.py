"""The graphs that the queries use, derived from the star-schema tables."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.operators.graph import Graph


_only: ContextVar[str | None] = ContextVar("only", default=None)


@contextmanager
def lines_where(condition: str):
    """Within this, co-purchase graphs have only the lines that meet ``condition``: small graphs of other shapes, for tests."""
    before = _only.set(condition)
    try:
        yield
    finally:
        _only.reset(before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """An edge from each part of an order to the next one, with its quantity; parallel edges are kept."""
    lines = table(spark, sf_dir, "lineitem")
    if _only.get():
        lines = lines.where(_only.get())
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return Graph(lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("w")))


def simple_copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """One edge for each pair, of the least quantity."""
    return copurchase(spark, sf_dir).dedupe(w=F.min("w"))


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """An edge from the customer's nation to the supplier's nation for every line of every order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph(joined.select("src", "dst"))
