"""Exact dedup by an exchange of Golomb-coded fingerprints.

1.  Every partition of documents sorts the 64-bit fingerprints of its texts, cuts
    them by the owner of their range, and sends each owner the gaps between
    neighbours, Golomb-Rice-coded: about log2(gap) + 2 bits a document.
2.  An owner decodes what it was sent and answers every sender with a bitmap: bit i
    is set if that sender's i-th fingerprint occurs anywhere else too.
3.  Only suspects, the documents with a set bit, have their texts shuffled.  Texts
    themselves are the grouping key, so bytes decide and a chance match of
    fingerprints can't join two texts.  Copies are aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

from .tables import bucketed, towards
from .text import column, fresh
from .worker import state

#: Fingerprints that one owner should get.
OWNED = 1_000_000
#: Documents of one sender at most, and of a bucket of senders' tables.
SENT, BUCKET = 500_000, 20_000
#: Rows of 40 bytes that are broadcast; beyond, joins are shuffled with SALTS copies of the smaller side.
SMALL, SALTS = 250_000, 16


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values: their count, the Rice parameter, and the coded gaps."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    low = gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    tails = ((low[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    head = np.array([n, k, len(unary)], np.uint32).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(tails.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, size = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    bits = np.frombuffer(blob, np.uint8, offset=12)
    cut = (size + 7) // 8
    ends = np.flatnonzero(np.unpackbits(bits[:cut], count=size))
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    low = np.zeros(n, np.uint64)
    if k:
        tails = np.unpackbits(bits[cut:], count=n * k).reshape(n, k)
        low = (tails.astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return np.cumsum((high << np.uint64(k)) | low)


def _fingerprints(rows: DataFrame, owners: int) -> DataFrame:
    """One pass over the texts: a row for each document, and the blobs for the owners.

    A partition is a sender, a larger one several of SENT documents.  ``place`` is the
    document's position among those that the sender sends to ``owner``; rows with a
    ``blob`` are what it sends.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    fields = ["sender", "owner", "place", "id", "sha", "blob"]

    def sent(sender, ids, shas):
        every = pa.chunked_array(ids).combine_chunks()
        fingers = np.frombuffer(b"".join(shas), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        order = np.argsort(fingers, kind="stable")
        owner = ((fingers >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cut = np.searchsorted(owner[order], np.unique(owner))
        for own in np.split(order, cut[1:]):
            n, o = len(own), int(owner[own[0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sender)), pa.array(np.full(n, o)), pa.array(np.arange(n)), every.take(pa.array(own)), pa.array([shas[i] for i in own.tolist()], pa.binary()), pa.nulls(n, pa.binary())], fields)
            yield pa.RecordBatch.from_arrays([pa.array([sender]), pa.array([o]), pa.array([-1]), pa.nulls(1, every.type), pa.nulls(1, pa.binary()), pa.array([rice_encode(fingers[own])], pa.binary())], fields)

    def digest(batches):
        state("exact_dedup")
        sender = TaskContext.get().partitionId() << 32
        ids, shas = [], []
        for batch in batches:
            ids.append(batch.column(0))
            shas += [hashlib.sha256(x.as_buffer()).digest() for x in column(batch, "body").cast(pa.binary())]
            if len(shas) >= SENT:
                yield from sent(sender, ids, shas)
                sender, ids, shas = sender + 1, [], []
        if shas:
            yield from sent(sender, ids, shas)

    return rows.mapInArrow(digest, f"sender long, owner long, place long, id {id_type}, sha binary, blob binary")


def duplicate_bitmaps(sent: DataFrame) -> DataFrame:
    """The owners' answers to ``sender, owner, blob``: ``sender, owner, bits``."""

    def answer(key, table):
        own = [rice_decode(b) for b in table.column("blob").to_pylist()]
        every = np.sort(np.concatenate(own))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = [np.packbits(np.isin(x, twice)).tobytes() for x in own]
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("owner").applyInArrow(answer, "sender long, owner long, bits binary")


def _join_sha(left: DataFrame, right: DataFrame, how: str, small: bool) -> DataFrame:
    """Join on ``sha``; ``right`` is broadcast if its size was found small, else its rows are copied for salted hot keys."""
    if small:
        return left.join(F.broadcast(right), "sha", how)
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, ["sha", "salt"], how).drop("salt")


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", normalise=None) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, after ``normalise`` (a function from
    Column to Column) if one is given.  Of equal texts the row with the largest id
    stays; rows without an id lose to those with one, and all of a group without
    any id have a null ``keep_id`` and are kept.  Equal rows that share the
    largest id can't be told apart and are all kept.  Null counts as the empty
    text and is equal to it.  An empty table gives an empty result; other columns
    are not looked at.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(body) if normalise else body).alias("body"))
    total = rows.count()
    table = bucketed(_fingerprints(rows, max(1, -(-total // OWNED))), "sender", -(-total // BUCKET), "fingerprints")
    known = table.where("blob is null").drop("blob")
    bits = duplicate_bitmaps(table.where("blob is not null").select("sender", "owner", "blob"))

    # Rows stay in the buckets where their sender wrote them; bitmaps alone are shuffled.
    bits = towards(bits, table, "sender").groupBy("sender").agg(F.map_from_entries(F.collect_list(F.struct("owner", "bits"))).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits[owner], cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    flagged = known.join(bits.hint("merge"), "sender").withColumn("byte", byte).where("shiftright(byte, cast(7 - place % 8 as int)) % 2 = 1")
    suspects = materialize(flagged.groupBy("sha").agg(F.count("*").alias("n")).select("sha"), "suspects")
    small = suspects.count() <= SMALL

    texts = _join_sha(rows.withColumn("sha", F.unhex(F.sha2("body", 256))), suspects, "left_semi", small)
    groups = texts.groupBy("sha", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).drop("body")
    groups = materialize(groups.where("group_size > 1"), "copies")
    out = _join_sha(known, groups, "left", small)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    out = out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    out = materialize(out, "decided")
    discard(table, suspects, groups)
    return out


def without_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`exact_duplicates` decides.

    Of equal rows that share the largest id of a group, one stays.  Rows without an
    id stay only where no row with an id has their text, and then one of them.
    """
    sha, one, key, digest = fresh(docs, "sha", "one", "key", "digest")
    found = exact_duplicates(docs, text, id_col)
    ids = found.where("group_size > 1").select(F.struct(F.col(id_col).alias("i")).alias(key), F.col("text_sha256").alias(sha), F.col("kept").alias(one))
    hashed = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    keyed = docs.withColumns({sha: hashed, key: F.struct(F.col(id_col).alias("i"))})

    lost = ids.where(~F.col(one)).select(key, sha).distinct()
    twins = ids.where(one).groupBy(key, sha).agg(F.count("*").alias(digest)).where(F.col(digest) > 1).select(key, sha)
    twins = materialize(twins, "twins")
    gone = materialize(lost.union(twins), "lost")
    lone = keyed.join(F.broadcast(gone) if gone.count() <= SMALL else gone, [key, sha], "left_anti")
    discard(found)
    if twins.isEmpty():
        return lone.select(docs.columns)
    both = keyed.join(twins, [key, sha], "left_semi").groupBy(key, sha).agg(F.any_value(F.struct(*docs.columns)).alias(one))
    return lone.select(docs.columns).unionByName(both.select(F.col(one).alias(one)).select(f"{one}.*"))
