"""Connected components of an undirected edge table.

Edges are first contracted inside each partition by union-find, so that a
partition passes on a spanning forest only.  Then large-star and small-star steps
alternate until nothing changes; the number of rounds grows with the logarithm of
the longest path, and no vertex's edges are gathered in one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

#: Vertices that one partition's forest may hold before it is passed on.
FOREST = 1_000_000


def _forest(batches):
    """Union-find over the edges of a partition; yields (vertex, smaller root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def flush() -> pd.DataFrame:
        rows = [(x, find(x)) for x in list(parent)]
        parent.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"], dtype="int64")

    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield flush()
    yield flush()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _roots(forest: DataFrame) -> DataFrame:
    out = forest.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out._vertexflow_path = forest._vertexflow_path
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst", contract: bool = True, local_edges: int = 0) -> DataFrame:
    """``id, root`` for every vertex that is not itself the smallest of its component.

    Edges with a null end and self-loops say nothing; an empty table has no rows.
    Contracted edges that were counted to be ``local_edges`` at most (of FOREST) are
    finished by union-find in one task.  The result is read from the shared folder.
    """
    pairs = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where(f"{src} is not null and {dst} is not null and u > v")
    now = materialize(pairs.mapInPandas(_forest, "u long, v long") if contract else pairs, "forest")
    if contract and 0 < now.count() <= min(local_edges, FOREST):
        before, now = now, materialize(now.coalesce(1).mapInPandas(_forest, "u long, v long"), "roots")
        discard(before)
        return _roots(now)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return _roots(now)
        mark, before = seen, now
        now = materialize(_small_star(_large_star(before)), "stars")
        discard(before)
