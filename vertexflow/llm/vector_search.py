"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted by splitting a bounded sample in two, again and again, until
every part is small, so lists are balanced.  Each vector goes to its nearest
centroid's list and, if it is near the boundary, to those of further centroids
that are about as near.  Centroids are found through an in-memory graph of their
own neighbours, by best-first search.  A query reads the lists whose centroids are
within a ratio of its nearest one's distance, and the next ones while these hold too
few vectors.  Candidates are scored exactly.

Lists and queries meet in a shuffle by shelf.  A shelf holds neighbouring lists up to
a number of vectors, so a query goes to few places and each answers with its ``k``
best.  A list that is longer than a shelf should be, as that of many equal vectors,
is cut into slices, to each of which its queries go.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

from .worker import state

#: Vectors that centroids are fitted on: those with the least hashes of their ids.
SAMPLE = 65_536
#: Most sampled vectors of one centroid; so there are at most SAMPLE / 32 centroids.
LEAF = 64
#: Neighbours of a centroid in the graph, and centroids that a search keeps in view.
DEGREE, VIEW = 16, 32
#: Centroids in view, and vectors together, where vectors are put into lists.
PLACED, TOGETHER = 12, 512
#: Most lists that hold a vector, and how much farther than the nearest they may be.
REPLICAS, BOUNDARY = 2, 1.1
#: How much farther than the nearest the lists that a query reads may be.  There is no limit to their number.
RATIO = 1.75
#: Vectors of one shelf, or of one slice of a long list.
SLICE = 4_096


def _level(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    largest = np.abs(x).max(1, initial=0.0)
    return np.ldexp(x, -np.frexp(largest)[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _level(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, leaf: int = LEAF, seed: int = 11) -> np.ndarray:
    """Unit centroids of parts of the sample, made by balanced splits at the median between two means."""
    rng = np.random.default_rng(seed)
    parts, out = [np.arange(len(sample))], []
    while parts:
        own = parts.pop()
        x = sample[own]
        if len(own) <= leaf:
            mean = x.mean(0)
            out.append(mean if np.linalg.norm(mean) > 1e-9 else x[0])
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            near = x @ (a - b)
            side = near >= np.median(near)
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
        order = np.argsort(x @ (a - b), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return _unit(np.array(out)) if out else np.zeros((0, sample.shape[1]))


class CentroidGraph:
    """Centroids with links to their nearest ones and to a few far ones, searched best-first."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, seed: int = 11):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        rng = np.random.default_rng(seed)
        links = []
        for lo in range(0, n, 1024):
            near = self.centroids[lo : lo + 1024] @ self.centroids.T
            k = min(degree + 1, n)
            links.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
        links = np.concatenate(links) if links else np.zeros((0, 1), np.int64)
        self.links = np.hstack([links, rng.integers(0, max(n, 1), (n, 4))])
        order = np.argsort(self.links, axis=1, kind="stable")
        ranked = np.take_along_axis(self.links, order, 1)
        self.doubles = np.zeros(self.links.shape, bool)  # a far link may be a near one too
        np.put_along_axis(self.doubles[:, :], order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        self.entries = rng.choice(n, min(n, 16), replace=False) if n else np.zeros(0, np.int64)

    def search(self, x: np.ndarray, view: int = VIEW, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Centroids by distance from the unit vector ``x``, and the distances.

        Best-first: about the ``view`` nearest are found, and those within
        ``ratio`` of the nearest's distance.
        """
        dist = np.full(len(self.centroids), np.inf)
        dist[self.entries] = 1 - self.centroids[self.entries] @ x
        ahead = [(dist[c], c) for c in self.entries.tolist()]
        heapq.heapify(ahead)
        best = heapq.nlargest(view, (-d for d, _ in ahead))  # of the nearest so far, the farthest on top
        heapq.heapify(best)
        least = min(d for d, _ in ahead)
        while ahead:
            d, c = heapq.heappop(ahead)
            if d > ratio * least and len(best) >= view and d > -best[0]:
                break
            new = self.links[c]
            new = new[dist[new] == np.inf]
            if not len(new):
                continue
            dist[new] = found = 1 - self.centroids[new] @ x
            for nd, nc in zip(found.tolist(), new.tolist(), strict=True):
                if nd <= ratio * least or len(best) < view or nd < -best[0]:
                    heapq.heappush(ahead, (nd, nc))
                    least = min(least, nd)
                    if len(best) < view:
                        heapq.heappush(best, -nd)
                    else:
                        heapq.heappushpop(best, -nd)
        order = np.argsort(dist, kind="stable")[: np.count_nonzero(dist < np.inf)]
        return order, dist[order]


    def search_many(self, x: np.ndarray, view: int = PLACED) -> tuple[np.ndarray, np.ndarray]:
        """About the ``view`` nearest centroids of each unit vector, by distance, and the distances.

        The same best-first search for many vectors in step: each looks along the
        links of the nearest centroid in its view that it hasn't left yet, until there is none.
        """
        m, every = len(x), np.arange(len(x))
        seen = np.zeros((m, len(self.centroids)), bool)
        seen[:, self.entries] = True
        view = min(view, len(self.centroids))
        ids = np.tile(self.entries, (m, 1))
        dist = 1 - x @ self.centroids[self.entries].T
        left = np.zeros(ids.shape, bool)
        while True:
            ahead = np.where(left, np.inf, dist)
            at = ahead.argmin(1)
            go = every[np.isfinite(ahead[every, at])]
            if not len(go):
                order = np.argsort(dist, axis=1, kind="stable")[:, :view]
                return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            left[go, at[go]] = True
            new = self.links[ids[go, at[go]]]
            found = 1 - np.matmul(self.centroids[new], x[go][:, :, None])[:, :, 0]
            found[seen[go[:, None], new]] = np.inf
            seen[go[:, None], new] = True
            found[self.doubles[ids[go, at[go]]]] = np.inf
            more_ids, more = np.zeros((m, new.shape[1]), np.int64), np.full((m, new.shape[1]), np.inf)
            more_ids[go], more[go] = new, found
            ids, dist, left = np.hstack([ids, more_ids]), np.hstack([dist, more]), np.hstack([left, np.zeros(more.shape, bool)])
            keep = np.argpartition(dist, view - 1, axis=1)[:, :view]
            ids, dist, left = (np.take_along_axis(v, keep, 1) for v in (ids, dist, left))


def _near_lists(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    """Lists that hold each unit vector: the nearest, and REPLICAS at most within BOUNDARY of its distance."""
    out = []
    for lo in range(0, len(x), TOGETHER):
        c, d = graph.search_many(x[lo : lo + TOGETHER])
        fine = d <= np.maximum(d[:, :1], 1e-6) * BOUNDARY
        fine[:, 0], fine[:, REPLICAS:] = True, False
        out += [own[f] for own, f in zip(c, fine, strict=True)]
    return out


def _read_lists(graph: CentroidGraph, x: np.ndarray) -> np.ndarray:
    """Lists that a query reads: those within RATIO of the nearest one's distance."""
    c, d = graph.search(x, VIEW, RATIO)
    return c[: max(1, int(np.searchsorted(d, max(d[0], 1e-6) * RATIO, "right")))]


def _valid(embedding: str) -> Column:
    """No null, no null or non-finite component, not zero."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(embedding).isNotNull() & fine & F.exists(embedding, lambda v: v != 0)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision of levelled vectors; equal rows get equal values whatever their places."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def _shelves(held: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Shelf, number of slices and vectors for each list; there are no more lists than centroids.

    Neighbouring lists share a shelf until it holds SLICE rows; a longer list has one
    of its own, in slices.
    """
    out, shelf, total = {}, 0, 0
    for c, n in sorted((r.list, r["count"]) for r in held.groupBy("list").count().collect()):
        if total and total + n > SLICE:
            shelf, total = shelf + 1, 0
        out[c] = shelf, -(-n // SLICE), n
        total += n
        if n > SLICE:
            shelf, total = shelf + 1, 0
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5, embedding: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each row where ``queries`` holds.

    Nearness is the cosine in double precision.  Every row is indexed; candidates
    are all rows but the query's own.  Ranks begin at 1, ties go to the smaller id.
    Rows without an id, and vectors that are null, zero, or hold null or non-finite
    components take no part; nor do vectors of another length than most rows'.
    Finite components may be as large or small as doubles go.
    With fewer candidates than ``k`` all that are found come back.  Rows that repeat
    an id are candidates each, but never of their own id, and queries each.  An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & _valid(embedding)).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common[0] if common else 1
    rows = rows.where(F.size("v") == dims)
    drawn = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    graph = CentroidGraph(fit_centroids(_unit(np.unique(_matrix(drawn), axis=0))) if len(drawn) else np.zeros((0, dims)))
    shared = spark.sparkContext.broadcast(graph)

    def hold(batches):
        state("vector_search")
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)) if len(batch) else np.zeros((0, dims))).astype(np.float32)
            own = _near_lists(shared.value, unit)
            at = np.repeat(np.arange(len(own)), [len(x) for x in own]) if own else np.zeros(0, np.int64)
            take = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate([np.zeros(0, np.int64), *own])), batch.column(2).take(take)], ["id", "v", "list", "row"])

    numbered = rows.select("id", "v", F.monotonically_increasing_id().alias("row"))
    held = materialize(numbered.mapInArrow(hold, f"id long, v {kind}, list long, row long"), "lists")
    shelves = _shelves(held)
    placed = held.join(F.broadcast(spark.createDataFrame([(c, s, n) for c, (s, n, _) in shelves.items()], "list long, shelf int, slices int")), "list")
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    where = spark.sparkContext.broadcast(shelves)

    enough = REPLICAS * (k + 1)  # k others with unique ids and the query's own, each in all its lists

    def read(u: np.ndarray) -> list[int]:
        lists = [c for c in _read_lists(shared.value, u).tolist() if c in where.value]
        total = sum(where.value[c][2] for c in lists)
        if total < enough:
            taken = set(lists)
            for c in np.argsort(-(shared.value.centroids @ u), kind="stable").tolist():
                if c in where.value and c not in taken:
                    lists.append(c)
                    total += where.value[c][2]
                    if total >= enough:
                        break
        return lists

    def ask(batches):
        state("vector_search")
        for batch in batches:
            at, shelf, slices, asked = [], [], [], []
            for i, u in enumerate(_unit(_matrix(batch.column(1)) if len(batch) else np.zeros((0, dims))).astype(np.float32)):
                by_shelf: dict[tuple[int, int], list[int]] = {}
                for c in read(u):
                    by_shelf.setdefault(where.value[c][:2], []).append(c)
                for (s, n), lists in by_shelf.items():
                    for k in range(n):
                        at.append(i)
                        shelf.append(s)
                        slices.append(k)
                        asked.append(lists)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(shelf, pa.int32()), pa.array(slices, pa.int32()), pa.array(asked, pa.list_(pa.int64()))], ["id", "v", "row", "shelf", "slice", "asked"])

    asking = rows.where("q").select("id", "v", F.monotonically_increasing_id().alias("row"))
    asks = asking.mapInArrow(ask, f"id long, v {kind}, row long, shelf int, slice int, asked array<long>").withColumn("list", F.lit(-1).cast("long"))
    both = placed.select("shelf", "slice", "id", "v", "list", "row", F.lit(None).cast("array<long>").alias("asked")).unionByName(asks)

    def search(key, table):
        state("vector_search")
        own = np.array([x is None for x in table.column("asked").to_pylist()], bool)
        every, x = table.column("id").to_numpy(), _level(_matrix(table.column("v").combine_chunks()))
        ids, numbers, stored, lists = every[own], table.column("row").to_numpy()[own], x[own], table.column("list").to_numpy()[own]
        order = np.lexsort((numbers, ids))
        ids, numbers, stored, lists = ids[order], numbers[order], stored[order], lists[order]
        unit, ask_ids, ask_rows, ask_x = _unit(stored), every[~own], table.column("row").to_numpy()[~own], x[~own]
        asked = [a for a in table.column("asked").to_pylist() if a is not None]
        wanted = np.zeros(int(lists.max(initial=-1)) + 1, bool)
        out: list[tuple[int, int, int, int, float]] = []
        for query, number, v, read in zip(ask_ids.tolist(), ask_rows.tolist(), ask_x, asked, strict=True):
            wanted[:] = False
            wanted[[c for c in read if c < len(wanted)]] = True
            other = np.flatnonzero(wanted[lists] & (ids != query))
            other = other[np.unique(numbers[other], return_index=True)[1]]  # a vector may be here once in each of its lists
            if len(other) > k:  # all that may be among the first, with room for the product's rounding
                rough = unit[other] @ (v / np.linalg.norm(v))
                other = other[rough >= np.partition(rough, -k)[-k] - 1e-9]
            best = sorted((-s, i, n) for s, i, n in zip(cosines(v, stored[other]).tolist(), ids[other].tolist(), numbers[other].tolist(), strict=True))[:k]
            out += [(query, number, i, n, -s) for s, i, n in best]
        kinds = [("query_id", pa.int64()), ("asking", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())]
        return pa.table({name: pa.array([o[c] for o in out], kind) for c, (name, kind) in enumerate(kinds)})

    # A vector comes back from each shelf that has one of its lists.
    found = both.groupBy("shelf", "slice").applyInArrow(search, "query_id long, asking long, vec_id long, row long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("asking").orderBy(F.desc("score"), "vec_id", "row"))
    out = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(held)
    return out
