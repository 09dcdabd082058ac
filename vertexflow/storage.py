"""Tables that cut lineage, in the folder which driver and executors share.

Loops and multi-pass operators write their intermediate tables below
``spark.checkpoint.dir`` and read them back.  Such a table survives the loss of
any executor, is compressed, and lets the optimizer start from true sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder.  Only in local mode, where none may be set, it is a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("vertexflow.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vertexflow-")
        spark.conf.set("vertexflow.shared.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/vertexflow/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._vertexflow_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_vertexflow_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
