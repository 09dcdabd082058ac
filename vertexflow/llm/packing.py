"""Best-fit packing of token pieces with certified bin counts.

Documents become token ids and, beyond the bin size, pieces of it.  Only the
pieces' lengths are packed; ids are needed for their checksum alone.  A full piece
is a bin of its own.  The others are packed in rounds:

*   Each partition runs best-fit decreasing on its pieces and computes a lower
    bound on its bins from dual feasible functions.  A partition that needed no
    more is certified: its bins stand, and only the emptiest goes on.
*   Partitions with a gap between bins and bound exchange documents: the pieces of
    all their bins that aren't full are dealt over fewer partitions, with the
    emptiest bins of the certified ones, and best-fit decreasing runs again.
*   The bound of all pieces together, from their histogram, ends the rounds as
    soon as it is met.  If it isn't when partitions have become one or grow no fewer,
    certified partitions that have room for a bin or more exchange theirs as well.
"""

from __future__ import annotations

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

from .pieces import encode, load, table
from .text import chunks, column, spaced
from .worker import release, state

#: Pieces that one partition packs.
PACKED = 200_000


def _split_safe(path: str) -> bool:
    """Whether texts can be cut before separators and stops, and A-Z taken as a-z.

    So it is where texts are lower-cased, only matches of the pattern count, white
    space matches nothing, and letters don't match together with stops.
    """
    if path.endswith(".model"):
        return False
    tok = load(path)
    if tok.normalizer is None or tok.pre_tokenizer is None:
        return False
    rule = bytes(tok.pre_tokenizer.__getstate__()).decode()
    return "Lowercase" in bytes(tok.normalizer.__getstate__()).decode() and all(x in rule for x in ('"Removed"', '"invert":true', r"[\\p{L}]+", r"[^\\s\\p{L}\\p{N}]+"))


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, crc`` of every piece; ``docs``: id, body."""
    run, safe = uuid.uuid4().hex, _split_safe(tokenizer)
    id_type = docs.schema["id"].dataType.simpleString()

    def ids_of(bodies: pa.Array) -> list[np.ndarray]:
        if not safe:
            return [np.array(x, np.uint32) for x in encode(tokenizer, bodies.to_pylist())]
        ids, first = table(tokenizer, run, keep_ids=True).token_ids(spaced(bodies, fold=True))
        out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        for i, body in enumerate(bodies):
            if b"<|" in memoryview(body.as_buffer()).tobytes():
                out[i] = np.array(encode(tokenizer, [body.as_py()])[0], np.uint32)
        return out

    def cut(batches):
        state("pieces")
        for batch in batches:
            bodies = column(batch, "body")
            at, piece, start, length, crc = [], [], [], [], []
            for lo, hi in chunks(bodies):
                for i, ids in enumerate(ids_of(bodies.slice(lo, hi - lo)), lo):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), size)):
                        part = ids[s : s + size]
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                release()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "crc"])

    return docs.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, crc long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing; ties go to the oldest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # sizes of room that some bin has
    made = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - room
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs, by dual feasible functions."""
    return _bound(np.bincount(lengths, minlength=size + 1), size)


def _bound(count: np.ndarray, size: int) -> int:
    """The bound from how many pieces have each length.

    One family raises lengths over size - k to a whole bin and drops those below
    k; the other rounds (m + 1) * length / size down to steps of 1 / m.  Both map a
    bin's content to one bin at most, so the sum is a bound for each parameter.
    """
    length = np.arange(size + 1)
    weight = count * length
    below = np.concatenate([[0], np.cumsum(weight)])  # below[x]: total of lengths < x
    large = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # large[x]: how many are >= x
    k = np.arange(0, size // 2 + 1)
    raised = large[size - k + 1] * size + below[size - k + 1] - below[k]
    best = int(-(-raised.max() // size))
    for m in range(1, 64):
        scaled = (m + 1) * length
        steps = np.where(scaled % size == 0, m * length, (scaled // size) * size)
        best = max(best, -(-int((count * steps).sum()) // (m * size)))
    return best


def bin_bound(pieces: DataFrame, size: int = 2048) -> int:
    """Bins that any packing of all pieces needs; at most ``size`` counts come to the driver."""
    rows = pieces.groupBy("length").count().collect()
    return _bound(np.bincount([r[0] for r in rows], [r[1] for r in rows], size + 1).astype(np.int64), size)


def _packer(size: int):
    """One partition's packing; ``open``: what is exchanged; ``roomy``: what a certified partition may exchange later."""

    def run(key, group):
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit(lengths, size)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(filled) == lower_bound(lengths, size)
        gaps = filled < size
        emptiest = gaps & (np.arange(len(filled)) == filled.argmin())
        opened = emptiest if certified else gaps
        roomy = gaps & ~opened & (len(filled) * size - int(filled.sum()) >= size)
        for name, values in (("bin", bins), ("offset", offsets), ("open", opened[bins]), ("roomy", roomy[bins]), ("certified", np.full(len(bins), certified))):
            group = group.append_column(name, pa.array(values))
        return group

    return run


def pack_pieces(pieces: DataFrame, size: int = 2048, packed: int = PACKED) -> DataFrame:
    """``pieces`` with ``sequence_id, offset, certified``; needs a column ``length`` of 1 to ``size``.

    ``certified`` says that the piece's partition used no more bins than any
    packing of its pieces must, or that all partitions together did.
    """
    names = pieces.columns
    bound = bin_bound(pieces, size)
    full = pieces.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    full = full.withColumns({"open": F.lit(False), "roomy": F.lit(False)})
    number, held = 0, []

    def rounds(left: DataFrame, done: DataFrame) -> DataFrame:
        nonlocal number
        parts, stood = None, _bins(done)
        while count := left.count():
            now = -(-count // packed)
            last = now == 1 or (parts is not None and now >= parts)
            parts, number = now, number + 1
            dealt = left.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", bin long, offset long, open boolean, roomy boolean, certified boolean"
            made = materialize(dealt.groupBy("group").applyInArrow(_packer(size), schema), "packed")
            held.append(made)
            made = made.withColumn("sequence_id", F.lit(number << 52) + F.col("group") * (1 << 24) + F.col("bin")).select(done.columns)
            if last or stood + _bins(made) == bound:
                return done.unionByName(made)
            done, left = done.unionByName(made.where("not open")), made.where("open").select(*names)
            stood = _bins(done)
        return done

    placed = rounds(pieces.where(F.col("length") < size), full)
    now = _bins(placed)
    if now > bound and _bins(placed.where("roomy")):
        again = rounds(placed.where("roomy or open").select(*names), placed.where("not roomy and not open"))
        if (fewer := _bins(again)) < now:
            placed, now = again, fewer
    out = materialize(placed.select(*names, "sequence_id", "offset", F.lit(True).alias("certified") if now == bound else "certified"), "sequences")
    discard(*held)
    return out


def _bins(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document's pieces and their places in sequences of at most ``size`` tokens.

    Columns: ``id_col, piece, start, length, ids_crc32, sequence_id, offset,
    certified``.  A document is its text's ids, without added special tokens, and
    then ``end_id``; only a longer one is cut, into pieces of ``size``.  A null text
    counts as empty and is one piece, the end id.  Rows with null or equal ids are
    packed like others, each as a document of its own.  An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    pieces = materialize(cut_documents(rows, tokenizer, size, end_id), "pieces")
    out = pack_pieces(pieces, size)
    discard(pieces)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", "certified")
