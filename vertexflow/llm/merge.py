"""Merging one summary of bounded size from each partition, as a tree."""

from __future__ import annotations

from functools import reduce

#: Summaries that one task merges.
FAN_IN = 8


def merged(rdd, merge, empty):
    """All values of ``rdd`` merged; no task and not the driver takes more than FAN_IN partitions' at once."""
    parts = rdd.getNumPartitions()

    def keyed(count: int):
        def key(index, values):
            values = list(values)
            return [(index % count, reduce(merge, values))] if values else []

        return key

    while parts > 1:
        parts = -(-parts // FAN_IN)
        rdd = rdd.mapPartitionsWithIndex(keyed(parts)).reduceByKey(merge, parts).values()
    found = rdd.collect()
    return reduce(merge, found) if found else empty
