"""Language-model scores by a weighted backoff automaton.

States are the contexts of smoothed trigrams: two words, one word, or the root.  A
state has an arc for every word that was seen after its context, weighted with the
word's log-probability there, and a failure arc to the state without the first word
of the context.  A text is read from left to right; the state is the longest context
that was seen, and a word without an arc takes failure arcs until it finds one.  The
root has an arc for every word, with the add-one unigram probability.

Smoothing is hierarchical (Dirichlet): with c the counts, s the order's strength and
h' the context without its first word,

    p(w | h) = (c(hw) + s p(w | h')) / (c(h) + s),

so a failure arc weighs s / (c(h) + s), and each state's probabilities sum to 1.  All
n-grams of the training texts count, also those that occur once.

The automaton is as large as the corpus's n-grams, so no task holds it.  Texts are
put into chunks of bounded size.  A chunk sends its distinct n-grams, as sorted coded
hashes, to the owners of the hashes' ranges; owners add up the counts and answer each
chunk in its own order; and the chunk walks its texts with just the arcs that it
needs.  An n-gram goes to its owner once from each chunk, however often it occurs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

from . import sorted_keys as sk
from .tables import bucketed, towards
from .text import column, cut_text, mix, words
from .worker import state

#: Bytes of text of a chunk; n-grams that one owner should get from all chunks.
CHUNK, OWNED = 8 << 20, 2_000_000
#: Most partitions that owners are dealt to; each takes its owners one after the other.
PARTITIONS = 50_000
#: Strength of the lower order in bigrams and trigrams.
STRENGTH = (256.0, 4.0)
#: Bits of a word's hash, and of an n-gram's: these, or 20 more than a bigram's number in the corpus takes.
WORD_BITS, LEAST_BITS = 56, 44
#: Stands for the end of a text, before which a text also begins.
END = np.uint64(0x1EE7C0DE5EED1DEA)


class Tokens(NamedTuple):
    """``doc``: the row of a token; ``scored``: not one that only leads in; ``keys``: hashes of n-grams
    by order, of which ``has`` says where they are."""

    doc: np.ndarray
    scored: np.ndarray
    has: list[np.ndarray]
    keys: list[np.ndarray]


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(((before << np.uint64(21)) | (before >> np.uint64(43))) ^ word)


def _tokens(table: pa.Table, bits: int) -> Tokens:
    w = words(table.column("body").combine_chunks())
    last = table.column("last").to_numpy().astype(bool)
    lead = table.column("lead").to_numpy().astype(np.int64)
    hashes = np.insert(w.hashes, w.first[1:][last], END)
    first = w.first + np.concatenate([[0], np.cumsum(last)])
    doc = np.repeat(np.arange(len(lead)), np.diff(first))
    place = np.arange(len(hashes)) - first[doc]
    begins = lead[doc] < 2  # the piece's first token is its text's
    before = np.concatenate([[END], hashes])[:-1]
    before[place == 0] = END
    two = _joined(before, hashes)
    three = _joined(np.concatenate([[END], two])[:-1], hashes)
    every = np.ones(len(hashes), bool)
    keys = [hashes >> np.uint64(64 - WORD_BITS), two >> np.uint64(64 - bits), three >> np.uint64(64 - bits)]
    return Tokens(doc, place >= lead[doc], [every, begins | (place > 0), (place > 0) & (begins | (place > 1))], keys)


def _distinct(t: Tokens, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of an order, and the place there of each token that has one; the end is always a word."""
    own = t.keys[order][t.has[order]]
    if order == 0:
        own = np.append(own, END >> np.uint64(64 - WORD_BITS))
    return np.unique(own, return_inverse=True)


def _pieces(rows: DataFrame, id_type: str) -> DataFrame:
    """Rows with their chunk; a text beyond CHUNK bytes is cut into rows that repeat the two words before."""

    def place(batches):
        state("language_model")
        chunk, held = TaskContext.get().partitionId() << 31, 0
        names = ["chunk", "row", "id", "train", "body", "lead", "last"]
        for batch in batches:
            bodies = column(batch, "body")
            chunks, long_rows = [], []
            for i, n in enumerate(pc.binary_length(bodies).to_pylist()):
                if n > CHUNK:
                    long_rows.append(i)
                elif held + n > CHUNK:
                    chunk, held = chunk + 1, 0
                held += n + 8 if n <= CHUNK else 0
                chunks.append(chunk)
            keep = np.ones(len(bodies), bool)
            keep[long_rows] = False
            n = int(keep.sum())
            short = pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column(0), batch.column(1), batch.column(3), bodies, pa.array(np.zeros(len(bodies), np.int32)), pa.array(np.ones(len(bodies), bool))], names)
            yield short if n == len(bodies) else short.filter(pa.array(keep))
            for i in long_rows:
                parts = list(cut_text(bodies[i].as_py().encode(), CHUNK, 2))
                for k, (part, lead) in enumerate(parts):
                    chunk, held = chunk + 1, 0
                    own = [pa.array([chunk], pa.int64()), batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(3).slice(i, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([part.decode()]), pa.array([lead], pa.int32()), pa.array([k + 1 == len(parts)])], names)
                chunk += 1

    schema = f"chunk long, row long, id {id_type}, train boolean, body string, lead int, last boolean"
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "body", "train").mapInArrow(place, schema)


def _counted(texts: DataFrame, bits: int, owners: int) -> DataFrame:
    """Counts in training texts of every chunk's n-grams: ``chunk, owner, counts`` in the order of its keys.

    Rows without a chunk have the ``tokens`` and distinct ``words`` of an owner's range.
    """

    def send(table):
        state("language_model")
        t = _tokens(table, bits)
        train = t.scored & table.column("train").to_numpy().astype(bool)[t.doc]
        out: list[list] = [[], [], []]
        for order in range(3):
            keys, place = _distinct(t, order)
            times = np.bincount(place[: len(t.doc)], train[t.has[order]], len(keys)).astype(np.int64)
            owner, bounds = sk.cut(keys, bits if order else WORD_BITS, owners)
            out[0] += (owner + order * owners).tolist()
            out[1] += sk.encode(keys, bounds, bits if order else WORD_BITS)
            out[2] += [sk.encode_counts(times[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        chunk = pa.array(np.full(len(out[0]), table.column("chunk")[0].as_py()), pa.int64())
        return pa.table({"owner": pa.array(out[0], pa.int64()), "chunk": chunk, "keys": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary())})

    def answer(key, table):
        state("language_model")
        blobs = [sk.decode(b.as_py()) for b in table.column("keys")]
        keys = np.concatenate(blobs)
        counts = np.concatenate([sk.decode_counts(b.as_py()) for b in table.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts[order], cut)
        counts[order] = np.repeat(sums, np.diff(np.append(cut, len(keys))))
        own = np.split(counts, np.cumsum([len(b) for b in blobs])[:-1])
        n, is_word = len(blobs), key[0].as_py() < owners
        made = {"chunk": [*table.column("chunk").to_pylist(), None], "owner": [key[0].as_py()] * (n + 1), "counts": [*map(sk.encode_counts, own), None]}
        made |= {"tokens": [0] * n + [int(sums.sum()) * is_word], "words": [0] * n + [int((sums > 0).sum()) * is_word]}
        return pa.table(made, pa.schema([("chunk", pa.int64()), ("owner", pa.int64()), ("counts", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())]))

    sent = texts.groupBy("chunk").applyInArrow(send, "owner long, chunk long, keys binary, counts binary")
    sent = sent.repartition(min(owners, PARTITIONS), "owner")
    return sent.groupBy("owner").applyInArrow(answer, "chunk long, owner long, counts binary, tokens long, words long")


def probabilities(counts: list[np.ndarray], context: list[np.ndarray], has: np.ndarray, total: int, strength: tuple[float, float]) -> np.ndarray:
    """log10 p of each token along its path.

    ``counts``: of the word, bigram and trigram that end in it; ``context``: of the
    one and two words before; ``has``: whether there are two.  Without an arc the
    count is 0, and what is left is the failure arc's weight times the lower
    state's probability; a context that was never seen is no state and weighs 1.
    """
    p = (counts[0] + 1) / total
    p = (counts[1] + strength[0] * p) / (context[0] + strength[0])
    return np.log10(np.where(has, (counts[2] + strength[1] * p) / (context[1] + strength[1]), p))


def score_texts(docs: DataFrame, training: Column, text: str = "text", id_col: str = "doc_id", strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """Scores of all texts by a model of those where ``training`` holds.

    Columns: ``id_col, training, n_tokens, n_known, train_tokens, base_score,
    score``.  Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, and one
    end.  ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), with c the
    token's count in the training texts, N all their tokens and V the distinct
    ones; ``n_known`` counts tokens with c > 0.  ``score`` is the automaton's log10
    probability.  A null text counts as empty, which has one token, the end.  A null
    ``training`` is false.  Without training texts every token has probability 1 /
    (0 + 0 + 1).  Null and repeated ids stay, each row is scored; texts of any length
    are scored whole; other columns are not looked at.

    N-grams are told apart by hashes of so many bits that one in a million shares
    its hash with another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"), F.coalesce(training, F.lit(False)).alias("train"))
    id_type = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(64, max(LEAST_BITS, 20 + math.ceil(math.log2(size / 4 + 1))))
    texts = bucketed(_pieces(rows, id_type), "chunk", -(-size // CHUNK), "texts")
    answers = materialize(_counted(texts, bits, max(1, -(-size // (4 * OWNED)))), "counts")
    found = answers.where("chunk is null").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, total = found[0] or 0, (found[0] or 0) + (found[1] or 0) + 1

    def walk(left, right):
        state("language_model")
        t = _tokens(left, bits)
        right = right.sort_by("owner")
        every = np.concatenate([sk.decode_counts(b.as_py()) for b in right.column("counts")])
        counts, at = [], 0
        for order in range(3):
            keys, place = _distinct(t, order)
            c = every[at : at + len(keys)][place]
            at += len(keys)
            full = np.zeros(len(t.doc), np.int64)
            full[t.has[order]] = c[: int(t.has[order].sum())]
            counts.append(full)
            if order == 0:
                end = c[-1]
        begins = np.diff(t.doc, prepend=-1) != 0
        one, two = (np.concatenate([[0], c])[:-1] for c in counts[:2])
        one[begins] = end
        logs = probabilities(counts, [one, two], t.has[2], total, strength)
        doc, n = t.doc[t.scored], len(left)
        base = np.log10((counts[0] + 1) / total)
        cols = [left.column("row"), left.column("id"), left.column("train"), np.bincount(doc, minlength=n), np.bincount(doc, counts[0][t.scored] > 0, n).astype(np.int64), *(np.bincount(doc, x[t.scored], n).astype(np.float64) for x in (base, logs))]
        return pa.table(cols, ["row", "id", "train", "n", "known", "base", "score"])

    schema = f"row long, id {id_type}, train boolean, n long, known long, base double, score double"
    walked = texts.groupBy("chunk").cogroup(towards(answers.where("chunk is not null"), texts, "chunk").groupBy("chunk")).applyInArrow(walk, schema)
    walked = materialize(walked, "walked")
    discard(texts, answers)
    out = walked.groupBy("row").agg(F.first("id").alias("id"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("train").alias("training"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("score"),
    )
