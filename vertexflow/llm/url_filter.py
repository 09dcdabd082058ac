"""URL filter: a trie over reversed host labels, then path segments.

The trie is built from the rule list on the driver and broadcast; the list is an
argument, so its size is known.  One walk from the top-level label downwards
meets every rule that fits, and the deepest one met decides between allow and
block.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column


class Trie:
    """Nodes are dicts from a label or a path segment to a node.

    Path segments keep their closing slash.  What follows a rule's last slash may
    match a part of a segment, so it is kept as a prefix beside the node.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.hosts: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict!r}")
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(("label", label), {})
            *segments, rest = path.split("/")
            node = node.setdefault("paths", {})
            for segment in segments:
                node = node.setdefault(segment + "/", {})
            ends = node.setdefault("ends", [])
            ends.append((rest, host + path, verdict))
            ends.sort(key=lambda x: (-len(x[0]), x[2] != "block"))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest rule that fits; of equal ones, the blocking one."""
        found: tuple[str | None, str | None] = (None, None)
        node = self.hosts
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            if "paths" in node:
                found = self._in_path(node["paths"], path) or found
        return found

    @staticmethod
    def _in_path(node: dict, path: str) -> tuple[str, str] | None:
        found, at = None, 0
        while True:
            for rest, rule, verdict in node.get("ends", ()):
                if path.startswith(rest, at):
                    found = rule, verdict
                    break
            cut = path.find("/", at) + 1
            node = node.get(path[at:cut]) if cut else None
            if node is None:
                return found
            at = cut


def split_url(url: str) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` are (allow or block, host, path).  A rule fits its host and all
    subdomains, where the path begins with the rule's.  The rule with the longest
    host wins, then that with the longest path; between equal ones, block.  Urls
    that no rule fits get the verdict ``default`` and a null rule.  A null url and
    one without ``://`` have an empty host and path, which no rule fits.  Null and
    repeated ids stay; other columns are not looked at.
    """
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"))
    id_type = rows.schema["id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in column(batch, "url").to_pylist()]
            found = [trie.value.longest(h, p) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v or default for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
