"""Partitioning: intervals, quality reports, blocks, and their assignment to partitions."""

from __future__ import annotations

import bisect
import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.plans.loop import Rounds
from vertexflow.storage import discard, materialize

from .connectivity import bow_tie, weak_components
from .graph import Dealt, Graph, degrees
from .relabel import apply_map, group_relabel
from .traversal import LOCAL_EDGES, blocks_in_one_task, spread

#: Most blocks, and most pairs of them with edges between, that the greedy assignment takes to the driver.
MAX_BLOCKS, MAX_LINKS = 1_000_000, 5_000_000
#: Spans of ids whose costs come to the driver, and those that are fetched vertex by vertex at once.
SPANS, FETCHED = 65_536, 512


def interval_of(vertex: Column, intervals: list[tuple[int, int, int]]) -> Column:
    """The part of a vertex id, from disjoint (part, start, end) with closed ends; null outside all.

    ``intervals`` is a short list; it becomes a tree of comparisons, so an id meets the logarithm of their number.
    """
    own = sorted(intervals, key=lambda x: x[1])

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.when(vertex.between(own[lo][1], own[lo][2]), F.lit(own[lo][0]))
        mid = (lo + hi) // 2
        return F.when(vertex < own[mid][1], tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(own)).cast("int") if own else F.lit(None).cast("int")


def even_intervals(size: int, parts: int) -> list[tuple[int, int, int]]:
    """Intervals of equal length; the first ``size % parts`` hold one more id."""
    starts = [p * (size // parts) + min(p, size % parts) for p in range(parts + 1)]
    return [(p, a, b - 1) for p, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if b > a]


def budget_intervals(graph: Graph, budget: int, per_vertex: int = 256, per_edge: int = 16) -> list[tuple[int, int, int]]:
    """Intervals in id order, each cut where its cost would pass ``budget``.

    A vertex costs per_vertex + per_edge * degree.  The cut is sequential, so it
    runs over totals of spans of ids, of which there are SPANS at most, and only spans
    that may hold a cut are looked at one by one.  Such spans are known beforehand,
    as a cut lies at most one vertex's cost below the budget: one job fetches those
    of many cuts to come, FETCHED spans at a time.
    """
    cost = degrees(graph, isolated=True).select("id", (F.lit(per_vertex) + per_edge * (F.col("in_degree") + F.col("out_degree"))).cast("long").alias("c"))
    size = graph.size()
    span = max(1, size // SPANS)
    cost = materialize(cost.withColumn("span", F.floor(F.col("id") / span)).repartitionByRange("id"), "costs")
    sums = sorted((r.span, r.c, r.most) for r in cost.groupBy("span").agg(F.sum("c").alias("c"), F.max("c").alias("most")).collect())
    before = [0]
    for _, c, _ in sums:
        before.append(before[-1] + c)
    largest = max((most for *_, most in sums), default=0)

    def fetch(at: int, prefix: int) -> dict[int, list[tuple[int, int]]]:
        """Vertices and costs of the spans from number ``at`` that may hold a cut, where an interval begins at ``prefix`` of the cost."""
        wanted, low, high = {at}, prefix, prefix
        while len(wanted) < FETCHED and high < before[-1]:
            low, high = low + max(1, budget - largest), high + budget
            first = max(at, bisect.bisect_right(before, low) - 1)
            wanted.update(range(first, min(len(sums), bisect.bisect_left(before, high) + 1, first + FETCHED)))
        found: dict[int, list[tuple[int, int]]] = {s: [] for s in wanted}
        for s, v, c in cost.where(F.col("span").isin(*[sums[i][0] for i in wanted])).select("span", "id", "c").collect():
            found[number[s]].append((v, c))
        return found

    number = {s: i for i, (s, *_) in enumerate(sums)}
    out, start, total, detail = [], 0, 0, {}
    for i, (_, c, _) in enumerate(sums):
        if total + c <= budget:
            total += c
            continue
        if i not in detail:
            detail = fetch(i, before[i] - total)
        for v, one in sorted(detail[i]):
            if total and total + one > budget:
                out.append((len(out), start, v - 1))
                start, total = v, 0
            total += one
    discard(cost)
    return [*out, (len(out), start, size - 1)] if size else []


def range_partition(graph: Graph, parts: int) -> DataFrame:
    """The edges dealt by ranges of ``dst`` and sorted by ``src`` within each."""
    return graph.edges.repartitionByRange(parts, "dst").sortWithinPartitions("src")


def edge_balanced_intervals(graph: Graph, parts: int) -> list[tuple[int, int, int]]:
    """At most ``parts`` intervals of about equal numbers of in-edges.

    One ends at each vertex where the running count reaches the next of ``parts``
    equal shares.  The count runs over totals of spans of ids, and only spans that
    may hold a cut, one for each share at most, are looked at vertex by vertex.
    """
    size = graph.size()
    span = max(1, size // SPANS)
    counts = materialize(graph.edges.groupBy("dst").agg(F.count("*").alias("c")).withColumn("span", F.floor(F.col("dst") / span)), "in-edges")
    sums = sorted((r.span, r.c) for r in counts.groupBy("span").agg(F.sum("c").alias("c")).collect())
    total = sum(c for _, c in sums)
    held, run, met, due = [], 0, 0, 0
    for s, c in sums:
        run += c
        reached = min(parts - 1, run * parts // total)
        met, due = reached, due + reached - met
        if due:  # its last vertex ends an interval at least; a vertex that reaches several shares leaves the others to the next ones
            held.append((s, run - c))
            due -= 1
    cuts: list[int] = []
    for at in range(0, len(held), FETCHED):
        before = dict(held[at : at + FETCHED])
        for s, v, c in sorted(counts.where(F.col("span").isin(*before)).select("span", "dst", "c").collect()):
            before[s] += c
            if len(cuts) < parts - 1 and before[s] * parts >= total * (len(cuts) + 1):
                cuts.append(v + 1)
    discard(counts)
    ends = [c for c in cuts if c < size] + [size]
    return [(p, a, b - 1) for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


def cut_matrix(graph: Graph, src_part: Column, dst_part: Column) -> DataFrame:
    """``part, other, edges`` for every pair of different parts with crossing edges."""
    return graph.edges.select(src_part.alias("part"), dst_part.alias("other")).where("part != other").groupBy("part", "other").agg(F.count("*").alias("edges"))


def boundary(graph: Graph, part_of) -> DataFrame:
    """``part, vertices, boundary, ratio``: non-isolated vertices, and those with an out-edge to another part."""
    crossing = graph.edges.where(part_of(F.col("src")) != part_of(F.col("dst"))).select(F.col("src").alias("id")).distinct().withColumn("_b", F.lit(1))
    every = degrees(graph).select("id").join(crossing, "id", "left").select(part_of(F.col("id")).alias("part"), F.coalesce("_b", F.lit(0)).alias("_b"))
    out = every.groupBy("part").agg(F.count("*").alias("vertices"), F.sum("_b").cast("long").alias("boundary"))
    return out.withColumn("ratio", F.col("boundary") / F.col("vertices"))


def block_matrix(graph: Graph, blocks: DataFrame) -> DataFrame:
    """``block, other, edges``: edges between the blocks of their ends (id, block)."""
    a = blocks.select(F.col("id").alias("src"), F.col("block"))
    b = blocks.select(F.col("id").alias("dst"), F.col("block").alias("other"))
    return graph.edges.join(a, "src").join(b, "dst").groupBy("block", "other").agg(F.count("*").alias("edges"))


def multi_source_blocks(graph: Graph, roots: int = 64, levels: int = 6, stop_ratio: float = 0.1, rounds: int = 100, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, block, level`` by repeated breadth-first search from the active vertices of largest in-degree.

    Each round labels active vertices at levels below ``levels`` with the root that
    reaches them first, the least one on ties.  It ends when fewer than
    ``stop_ratio`` of the vertices are active or nothing is gained.  The edges are
    written once, and again whenever half of the vertices have gone; from
    ``local_edges`` edges on, one task does the rounds that are left.
    """
    edges = materialize(graph.dedupe(_n=F.count("*")).edges, "edges")
    ends = edges.select("src", F.lit(0).cast("long").alias("_n")).union(edges.select("dst", "_n")).groupBy(F.col("src").alias("id"))
    active = materialize(ends.agg(F.sum("_n").alias("in_degree")), "active")
    total = left = written = active.count()
    few, found = edges.count() <= local_edges, []
    for number in range(rounds):
        if not left or left < total * stop_ratio:
            break
        if left * 2 < written:
            before, edges, written = edges, materialize(Graph(edges).within(active).edges, "edges"), left
            discard(before)
            few = edges.count() <= local_edges
        if few:
            found.append(blocks_in_one_task(edges, active, total, roots, levels, stop_ratio, rounds - number))
            break
        tops = active.orderBy(F.desc("in_degree"), "id").limit(roots).select("id", F.col("id").alias("label"))
        found.append(spread(edges, tops, levels - 1, active).select("id", F.col("label").alias("block"), "level"))
        before, active = active, materialize(active.join(found[-1], "id", "left_anti"), "active")
        discard(before)
        last, left = left, active.count()
        if left == last:
            break
    discard(edges)
    if not found:
        return active.select("id", F.col("id").alias("block"), F.lit(0).cast("long").alias("level")).limit(0)
    discard(active)
    return reduce(DataFrame.unionByName, found)


def voronoi_blocks(graph: Graph, rate: float = 0.001, most: int = 1 << 20, growth: int = 10, seed: int = 0, rounds: int = 50, top_rate: float = 0.1, stall: float = 0.9) -> DataFrame:
    """``id, block`` by growing blocks from sampled sources, without direction.

    In each round active vertices become sources by a hash of seed, round and id.
    Blocks then grow ``growth`` steps: an active vertex next to labelled ones joins
    one that a hash picks, as long as the block has fewer than ``most`` members.
    The rate doubles after a round that leaves over ``stall`` of the active ones;
    the rounds end when it would pass ``top_rate`` or no vertex is active.
    """
    active = materialize(degrees(graph).select("id"), "active")
    edges = Dealt(graph.undirected().edges.select("src", "dst").distinct())
    out, number = None, 0
    left = active.count()
    while left and rate <= top_rate and number < rounds:
        number += 1
        loop = Rounds("blocks")
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "id"), F.lit(1_000_000)) < int(rate * 1_000_000)
        grown = loop.keep(active.where(drawn).select("id", F.col("id").alias("block")))
        frontier = grown
        for step in range(growth):
            if frontier.isEmpty():
                break
            sizes = grown.groupBy("block").agg(F.count("*").alias("_size"))
            met = edges.join(frontier.withColumnRenamed("id", "src")).select(F.col("dst").alias("id"), "block")
            pick = F.min_by("block", F.xxhash64(F.lit(seed), F.lit(number), F.lit(step), "id", "block"))
            met = met.join(active, "id", "left_semi").join(grown.select("id"), "id", "left_anti").groupBy("id").agg(pick.alias("block"))
            row = F.row_number().over(W.partitionBy("block").orderBy("id"))
            frontier = loop.keep(met.join(sizes, "block").withColumn("_row", row).where(F.col("_size") + F.col("_row") <= most).select("id", "block"))
            grown = loop.keep(grown.unionByName(frontier))
        grown = loop.result(grown)
        out = grown if out is None else out.unionByName(grown)
        active = materialize(active.join(grown, "id", "left_anti"), "active")
        before, left = left, active.count()
        if left > stall * before:
            rate *= 2
    edges.free()
    return out if out is not None else active.select("id", F.col("id").alias("block")).limit(0)


def residual_components(graph: Graph, blocks: DataFrame) -> DataFrame:
    """``id, block`` of vertices without a block: components of the edges that have no end in a block."""
    rest = degrees(graph).select("id").join(blocks, "id", "left_anti")
    found = weak_components(graph.within(rest)).withColumnRenamed("component", "block")
    return rest.join(found, "id", "left").select("id", F.coalesce("block", "id").alias("block"))


def lpt_assignment(sizes: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """(block, part) from (block, size): largest blocks first, each to the least loaded part, the first on ties."""
    loads = [(0, p) for p in range(parts)]
    out = []
    for block, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, part = heapq.heappop(loads)
        out.append((block, part))
        heapq.heappush(loads, (load + size, part))
    return out


def greedy_assignment(sizes: list[tuple[int, int]], links: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    """(block, part) from (block, size) and (block, other, edges).

    The largest blocks seed one part each.  Then the least loaded part takes the
    neighbouring block with the largest share of its crossing edges towards that
    part, or the largest block left where none is a neighbour.
    """
    size = dict(sizes)
    order = sorted(size, key=lambda b: (-size[b], b))
    near: dict[int, dict[int, int]] = {b: {} for b in size}
    for a, b, n in links:
        if a != b:
            near[a][b] = near[a].get(b, 0) + n
            near[b][a] = near[b].get(a, 0) + n
    crossing = {b: sum(n.values()) for b, n in near.items()}
    ties: list[dict[int, int]] = [{} for _ in range(parts)]
    best: list[list[tuple[float, int, int, int]]] = [[] for _ in range(parts)]  # heaps by share; entries that ties have outgrown are skipped
    loads, part_of = [0] * parts, {}

    def give(block: int, part: int) -> None:
        part_of[block] = part
        loads[part] += size[block]
        for other, n in near[block].items():
            if other not in part_of:
                ties[part][other] = now = ties[part].get(other, 0) + n
                heapq.heappush(best[part], (-now / crossing[other], -size[other], other, now))
        for t in ties:
            t.pop(block, None)

    for part, block in enumerate(order[:parts]):
        give(block, part)
    rest = iter(order[parts:])
    while len(part_of) < len(size):
        part = min(range(parts), key=lambda p: (loads[p], p))
        if ties[part]:
            while True:
                *_, block, now = heapq.heappop(best[part])
                if ties[part].get(block) == now:
                    break
        else:
            block = next(b for b in rest if b not in part_of)
        give(block, part)
    return sorted(part_of.items(), key=lambda x: x[0])


def assign_blocks(graph: Graph, blocks: DataFrame, parts: int, greedy: bool = True) -> DataFrame:
    """``block, part`` for (id, block).  The block graph, not the graph, comes to the driver; it may have MAX_BLOCKS blocks."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).limit(MAX_BLOCKS + 1).collect()
    if len(sizes) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks; make them larger")
    pairs = [(r.block, r.n) for r in sizes]
    if greedy:
        links = [(r.block, r.other, r.edges) for r in block_matrix(graph, blocks).where("block != other").limit(MAX_LINKS + 1).collect()]
        if len(links) > MAX_LINKS:
            raise ValueError(f"more than {MAX_LINKS} pairs of blocks with edges between; make the blocks larger")
        made = greedy_assignment(pairs, links, parts)
    else:
        made = lpt_assignment(pairs, parts)
    return graph.edges.sparkSession.createDataFrame(made, "block long, part int")


def dag_partition(graph: Graph, parts: int, roots: int = 64, levels: int = 6, root: int | None = None) -> tuple[DataFrame, DataFrame, Graph]:
    """Bow-tie sides and blocks of the middle as partitions: vmap, intervals, and the renamed graph.

    Left and right, where they are not empty, are partitions of their own; the
    middle is cut into blocks, which are assigned to the others.
    """
    graph = Graph(materialize(graph.edges, "edges"))
    regions = materialize(bow_tie(graph, root), "regions")
    present = {r.region for r in regions.select("region").distinct().collect()}
    left, right = "left" in present, "right" in present
    middle_parts = max(1, parts - left - right)
    middle = regions.where("region = 'middle'").select("id")
    inside = materialize(graph.within(middle).edges, "inside")
    inner = Graph(inside)
    found = multi_source_blocks(inner, roots, levels).select("id", "block")
    found = found.unionByName(residual_components(inner, found))
    blocks = materialize(middle.join(found, "id", "left").select("id", F.coalesce("block", "id").alias("block")), "blocks")
    part = assign_blocks(inner, blocks, middle_parts).withColumn("part", F.col("part") + int(left))
    placed = blocks.join(part, "block").select("id", "part", "block")
    sides = regions.where("region != 'middle'").select("id", F.when(F.col("region") == "left", 0).otherwise(int(left) + middle_parts).alias("part"), F.lit(0).cast("long").alias("block"))
    every = materialize(placed.unionByName(sides), "parts")
    discard(regions, inside, blocks)
    vmap = materialize(group_relabel(every, F.col("part"), F.col("block")), "vmap")
    sizes = every.groupBy("part").agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.orderBy("part"))
    intervals = sizes.select("part", (end - F.col("n")).alias("start_id"), (end - 1).alias("end_id"))
    return vmap, intervals, apply_map(graph, vmap)
