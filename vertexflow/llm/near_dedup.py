"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

1.  Each document becomes its set of word shingles.  Documents with equal sets are
    one class from here on.
2.  A SuperMinHash signature: every shingle walks through its own random
    permutation of the registers and offers rank + noise to the register that it
    reaches; registers keep the least offer.  All shingles of all documents in a
    chunk take step j together, and a document leaves as soon as its registers
    are full, since later offers are larger.  Ranks of one shingle differ by
    design, which lowers the variance below that of independent hashes.
3.  Bands of the signature are bucket keys.  In each bucket every member is paired
    with the bucket's least member only, so pairs grow with members.
4.  Pairs are confirmed on whole shingle sets and grouped by union-find.
5.  Buckets that still hold more than one group are worked through in blocks: the
    members' whole sets go to one task for every two blocks of the bucket, which
    confirms pairs of different groups and passes on a spanning forest of links.
    So a link between members that are no partners of the least one is found
    too, without a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.operators.components import components
from vertexflow.storage import discard, materialize

from .joins import join_hot
from .text import chunks, column, lists, mix, shingles, words
from .worker import state

#: Chance that a pair at exactly the threshold shares no band.
MISS = 1e-5
#: Most registers.
REGISTERS = 336
#: Steps that all shingles take together before short documents get a table of permutations.
JOINT_STEPS = 12
#: Shingles that have such tables at once.
TABLE_ROWS = 16_384
#: Shingles that are walked together.
WALKED = 1 << 17
#: Rows of a few whole numbers that are broadcast at most, so that texts or sets are not shuffled to meet them.
FEW = 1_000_000
#: Documents for each file of a table of a few whole numbers.
FILE_ROWS = 200_000
#: Contracted links that one task finishes.
LOCAL_LINKS = 1_000_000
#: Bytes of a shingle's hash in whole sets.
SET_BYTES = 6
#: Pairs of one document for each copy of its set.
SPLIT = 1_000
#: Members of a bucket that meet those of another block in one task.
BLOCK = 512

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows that miss a pair at the threshold with chance MISS at most."""
    for rows in range(12, 0, -1):
        same = (percent / 100) ** rows
        bands = 1 if same >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-same)))
        if rows * bands <= REGISTERS:
            return bands, rows
    raise ValueError(f"no banding for a similarity of {percent} %")


def _draw(h: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of the shingles: the place to swap with, and noise below the rank."""
    r = mix(h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
    place = np.int64(j) + (((r & np.uint64(0xFFFFFF)) * np.uint64(k - j)) >> np.uint64(24)).astype(np.int64)
    return place, (np.uint64(j) << np.uint64(40)) | (r >> np.uint64(24))


def signatures(sets: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Registers of each document, from its distinct shingle hashes; all ones where it has none.

    Documents are taken up to WALKED shingles together.  A longer one goes in parts:
    its registers are the least of those of the parts.
    """
    out = np.full((len(first) - 1, k), _NONE)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + WALKED, "right")) - 1)
        for a in range(int(first[lo]), int(first[hi]), 2 * WALKED):
            b = min(int(first[hi]), a + 2 * WALKED)
            np.minimum(out[lo:hi], _registers(sets[a:b], np.clip(first[lo : hi + 1], a, b) - a, k), out=out[lo:hi])
        lo = hi
    return out


def _registers(sets: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    n = len(first) - 1
    best = np.full(n * k, _NONE)
    doc = np.repeat(np.arange(n), np.diff(first))
    h, swaps = sets, []
    for j in range(min(JOINT_STEPS, k)):
        if not len(h):
            break
        place, offer = _draw(h, j, k)
        at = place
        for step in range(j - 1, -1, -1):
            at = np.where(at == swaps[step], step, at)
        np.minimum.at(best, doc * k + at, offer)
        swaps.append(place)
        open_ = (best.reshape(n, k) == _NONE).any(1)[doc]
        if not open_.all():
            h, doc, swaps = h[open_], doc[open_], [s[open_] for s in swaps]
    lo = 0
    while lo < len(h):
        hi = min(len(h), lo + TABLE_ROWS)
        if hi < len(h):  # a document stays in one table
            hi = max(int(np.searchsorted(doc, doc[hi])), lo + 1) if doc[hi] != doc[lo] else int(np.searchsorted(doc, doc[lo], "right"))
        _by_table(best, h[lo:hi], doc[lo:hi], k)
        lo = hi
    return best.reshape(n, k)


def _by_table(best: np.ndarray, h: np.ndarray, doc: np.ndarray, k: int) -> None:
    """The same walk with whole permutations at hand, for documents of few shingles."""
    ranks = np.tile(np.arange(k, dtype=np.int16), (len(h), 1))
    row = np.arange(len(h))
    for j in range(k):
        place, offer = _draw(h, j, k)
        at = ranks[row, place].copy()
        ranks[row, place] = ranks[:, j]
        np.minimum.at(best, doc * k + at, offer)
        if j % 16 == 15:
            open_ = (best.reshape(-1, k)[doc] == _NONE).any(1)
            if not open_.any():
                return
            if not open_.all():
                h, doc, ranks = h[open_], doc[open_], ranks[open_]
                row = np.arange(len(h))


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(registers), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(registers), b + 1, np.uint64)
        for r in registers[:, b * rows : (b + 1) * rows].T:
            key = mix(key * _STEP + r)
        out[:, b] = key
    return out


def _set_marks(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that stand for each whole set."""
    marks = []
    for salt in (0x1234567, 0x89ABCDEF):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))])
        marks.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return marks[0], marks[1]


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def sign(batches):
        state("near_dedup")
        for batch in batches:
            bodies = column(batch, "body")
            for lo, hi in chunks(bodies):
                sets, first = shingles(words(bodies.slice(lo, hi - lo)), size)
                keys = band_keys(signatures(sets, first, bands * rows), bands, rows)
                some = np.flatnonzero(np.diff(first) > 0)
                cut = np.zeros(len(first), np.int64)
                cut[some + 1] = bands
                one, two = _set_marks(sets, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(one), pa.array(two), lists(keys[some].ravel().view(np.int64), np.cumsum(cut), pa.int64())], ["id", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(sign, "id long, n long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets: the first SET_BYTES bytes of their sorted hashes, packed."""

    def pack(batches):
        state("near_dedup")
        for batch in batches:
            bodies = column(batch, "body")
            for lo, hi in chunks(bodies):
                sets, first = shingles(words(bodies.slice(lo, hi - lo)), size)
                flat = np.ascontiguousarray(sets.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES])
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * SET_BYTES).astype(np.int32).tobytes()), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed], ["id", "packed"])

    return docs.mapInArrow(pack, "id long, packed binary")


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, SET_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :SET_BYTES] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * |intersection| >= percent * |union|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    ``size`` bounds the pairs of b; its set is copied for every SPLIT of them, so that
    those of one b are spread over tasks.
    """

    def check(batches):
        state("near_dedup")
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [similar(_unpacked(x), _unpacked(y), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salts = F.ceil(F.col("size") / SPLIT).cast("int")
    copies = pairs.groupBy("b").agg(F.max(salts).alias("salts"))
    one = sets.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    two = sets.select(F.col("id").alias("b"), F.col("packed").alias("pb")).join(copies, "b")
    two = two.select("b", "pb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    if pairs.count() <= FEW:  # then the sets of all ids are not shuffled to meet them
        salted = F.broadcast(salted)
    return salted.join(one, "a").join(two, ["b", "salt"]).select("a", "b", "pa", "pb").mapInArrow(check, "a long, b long")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets with several groups; ``members``: key, id, root, size of the bucket.

    Blocks x <= y of a bucket meet in one task.  A pair is confirmed unless its
    ends are in one group already, by earlier links or by those of the same task.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = placed.select("key", "id", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = members.agg(F.sum(blocks)).first()[0] or 0
    joined = sets.join(F.broadcast(met) if rows <= FEW else met, "id").select("key", "id", "root", "own", "x", "y", "packed")

    def link(key, table):
        ids, roots, own = (table.column(c).to_pylist() for c in ("id", "root", "own"))
        packed = [_unpacked(p) for p in table.column("packed")]
        order = sorted(range(len(ids)), key=lambda i: (len(packed[i]), ids[i]))
        x, y = key[1].as_py(), key[2].as_py()
        group = {r: r for r in roots}

        def find(r):
            while group[r] != r:
                group[r] = group[group[r]]
                r = group[r]
            return r

        out = []
        for p, i in enumerate(order):
            for q in range(p - 1, -1, -1):
                j = order[q]
                if 100 * len(packed[j]) < percent * len(packed[i]):
                    break  # all before are smaller still
                if x != y and own[i] == own[j]:
                    continue
                a, b = find(roots[i]), find(roots[j])
                if a != b and similar(packed[j], packed[i], percent):
                    group[a] = b
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return joined.groupBy("key", "x", "y").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked: ``id_col, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, shingles ``size`` words
    long; two documents are linked when 100 * intersection >= percent * union.  A
    text with fewer words has one shingle, its whole sequence; null and empty
    texts, and texts without words, have none and are linked with nothing.

    ``component_id`` is the smallest id that links lead to and ``kept`` says that
    a row has it.  Ids must be whole numbers.  A row without an id is linked with
    nothing, has a null component and is kept.  Rows that share an id count as one
    document: they are linked if any of their texts are, and are kept alike.  An
    empty table gives an empty result; other columns are not looked at.
    """
    bands, rows = bands_for(percent)
    bodies = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    signed = materialize(_signed(bodies, size, bands, rows), "signed")
    total = signed.count()

    def thin(df: DataFrame, tag: str) -> DataFrame:
        """Written in files by the number of documents, not of tasks; for each file on a local disk an executor may start a process."""
        return materialize(df.repartition(1 + total // FILE_ROWS), tag)

    some, alike = signed.where("n > 0 and id is not null"), ["s1", "s2", "n"]
    reps = thin(some.groupBy(*alike).agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    distinct = signed.where("n > 0").join(reps.select(*alike, F.col("rep").alias("id")), [*alike, "id"], "left_semi")
    distinct = materialize(distinct.select("id", "n", "keys"), "distinct")
    bucketed = distinct.select("id", "n", F.explode("keys").alias("key"))
    least = bucketed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.count("*").alias("size")).where("size > 1")
    heads = least.select("key", F.col("least.id").alias("head"), F.col("least.n").alias("m"), "size", F.col("size").alias("rows"))
    heads = thin(heads, "heads")
    members = thin(join_hot(bucketed, heads, "key", "rows", total * bands), "members")
    discard(distinct, heads)

    stars = members.where(f"id != head and 100 * least(n, m) >= {percent} * greatest(n, m)").groupBy(F.col("id").alias("a"), F.col("head").alias("b")).agg(F.max("size").alias("size"))
    stars = thin(stars, "stars")
    within = members.where("size > 2").select("id").union(stars.select(F.col("a").alias("id"))).union(stars.select(F.col("b").alias("id"))).distinct()
    within = thin(within, "within")
    few = within.count() <= FEW
    sets = materialize(_sets(bodies.join(F.broadcast(within) if few else within, "id", "left_semi"), size), "sets")
    links = thin(_confirm(stars, sets, percent), "links")
    discard(stars, within)
    roots = components(links, "a", "b", local_edges=LOCAL_LINKS)

    grouped = members.where("size > 2").select("key", "id", "head", "size").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    grouped = materialize(grouped, "grouped")
    discard(members, roots)
    mixed = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("key", "rows")
    loose = materialize(join_hot(grouped, mixed, "key", "rows", total * bands).where("id != head").select("key", "id", "root", "size"), "loose")
    discard(grouped)
    more = thin(_block_links(loose, sets, percent), "more")
    discard(loose, sets)
    own = join_hot(some, reps, alike, "rows", total).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    final = components(links.union(more).union(own.select("a", "b")), "a", "b", local_edges=LOCAL_LINKS)

    classes = materialize(reps.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(*alike, F.coalesce("root", "rep").alias("root"), "rows"), "roots")
    full = signed.select("id", *alike)
    joined = join_hot(full.where("n > 0"), classes, alike, "rows", total, "left").unionByName(full.where("n = 0").withColumn("root", F.lit(None).cast("long")))
    group = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    out = joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"))
    out = thin(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "near")
    discard(signed, reps, links, more, final, classes)
    return out
