"""Joins by keys of which some may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most: those with 1 / HOT of the rows, or more.
HOT = 10_000


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``size`` how many rows of ``left`` have it.

    Keys with 1 / HOT of ``total`` rows are at most HOT and are broadcast, so that no
    task gets all rows of one; those of the other keys are shuffled.  ``how``: inner or left.
    """
    least = max(1, total // HOT)
    hot = F.broadcast(right.where(F.col(size) >= least).drop(size))
    rest = right.where(F.col(size) < least).drop(size)
    keys = [on] if isinstance(on, str) else on
    return left.join(hot, keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how))
