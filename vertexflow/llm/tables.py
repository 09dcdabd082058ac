"""Bucketed tables in the shared folder: rows that are read again by the same key without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from vertexflow.storage import new_path

#: Most buckets of a table.
BUCKETS = 16_384


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """``df`` written in buckets of ``key``; for :func:`vertexflow.storage.discard` like any written table.

    Buckets need a catalog entry, which goes as soon as the scan is known.
    """
    spark, name, path = df.sparkSession, f"vertexflow_{uuid.uuid4().hex}", new_path(df.sparkSession, tag)
    buckets = max(1, min(BUCKETS, buckets))
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    table._vertexflow_path, table._buckets = path, buckets
    return table


def towards(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` dealt as the buckets of ``table`` are, so that a join by ``key`` moves ``df`` alone."""
    return df.repartition(table._buckets, key)
