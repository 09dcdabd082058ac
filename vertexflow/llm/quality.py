"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a fixed sparse random index vector, which a seed determines.  A
word's vector is the sum of the index vectors of its neighbours and of the shapes
(case, symbols, length, repetition) that it and they have.  A document is the mean
of its words' vectors beside the mean of its shapes' index vectors.  A network of
two layers scores that; its probabilities are calibrated by one temperature.

Words are hashed to a fixed number of rows, so the model has the same size
whatever the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import merged
from .text import Words, chunks, column, words
from .worker import state

#: Rows of word vectors, their dimensions, and non-zero places of an index vector.
ROWS, DIMS, PLACES = 1 << 14, 64, 4
#: Most labelled rows that a model is fitted on: those with the least hashes of their ids.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 256, 3e-3, 1e-4
_SHAPES = 256
#: Words to each side that are neighbours; words whose vectors are held at once.
REACH, BLOCK = 2, 1 << 13

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors: ROWS for words, then one for each shape."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS + _SHAPES, DIMS), np.float32)
    at = rng.random((len(out), DIMS)).argpartition(PLACES, axis=1)[:, :PLACES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return out


def _shapes(w: Words) -> np.ndarray:
    """A number below _SHAPES for each word, from flags of its bytes and of the word before."""
    out = np.empty(len(w.hashes), np.int16)
    for lo in range(0, len(out), BLOCK):
        starts, ends = w.starts[lo : lo + BLOCK], w.ends[lo : lo + BLOCK]
        base = int(starts[0])
        data = w.data[base : int(ends[-1])]

        def count(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int32)])  # noqa: B023
            return total[ends - base] - total[starts - base]  # noqa: B023

        upper, lower, symbols = count(_UPPER), count(_LOWER), count(_SYMBOL)
        length = np.digitize(ends - starts, [3, 7, 13])
        out[lo : lo + BLOCK] = (upper > lower + 1) + 2 * (symbols == 1) + 4 * (symbols > 1) + 8 * (count(_DIGIT) > 0) + 32 * length + 128 * (upper + lower == 0)
    same = np.zeros(len(out), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[(w.first > 0) & (w.first < len(out))]] = False
    return out + 16 * same.astype(np.int16)


class Tokens(NamedTuple):
    first: np.ndarray
    rows: np.ndarray
    shapes: np.ndarray


def _tokens(bodies: pa.Array) -> Tokens:
    w = words(bodies)
    return Tokens(w.first, (w.hashes & np.uint64(ROWS - 1)).astype(np.int32), _shapes(w))


def _contexts(t: Tokens, index: np.ndarray, total: np.ndarray) -> None:
    """Add to each row of ``total`` what its word's occurrences have around them."""
    n = len(t.rows)
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = max(0, lo - REACH), min(n, hi + REACH)  # with the neighbours of the block's words
        around = index[ROWS + t.shapes[a:b]]
        both = index[t.rows[a:b]] + around
        for step in range(1, REACH + 1):
            near = (doc[a + step : b] == doc[a : b - step])[:, None]
            around[step:] += both[:-step] * near
            around[:-step] += both[step:] * near
        rows = t.rows[lo:hi]
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total[rows[cut]] += np.add.reduceat(around[lo - a + order], cut, axis=0)


def _pooled(bodies: pa.Array, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Means over each text's words, summed by blocks of words."""
    t = _tokens(bodies)
    docs = len(t.first) - 1
    sums, shapes = np.zeros((docs, DIMS)), np.zeros((docs, DIMS))
    for lo in range(0, len(t.rows), BLOCK):
        first = np.clip(t.first, lo, lo + BLOCK) - lo
        some = np.flatnonzero(np.diff(first))
        own = np.repeat(np.arange(len(some)), np.diff(first)[some])
        sums[some] += np.add.reduceat(vectors[t.rows[lo : lo + BLOCK]], first[some], axis=0)
        count = np.bincount(own * _SHAPES + t.shapes[lo : lo + BLOCK], minlength=len(some) * _SHAPES)
        shapes[some] += count.reshape(-1, _SHAPES) @ index[ROWS:]
    n = np.diff(t.first)[:, None]
    return np.hstack([sums / np.maximum(n, 1), shapes / np.maximum(n, 1), np.log1p(n)]).astype(np.float32)


class QualityModel:
    """Word vectors, the network, and the temperature.  ``prior`` is used where there was nothing to fit."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors, self.seed = vectors.astype(np.float16), seed
        self.prior, self.temperature, self.layers = 0.5, 1.0, None

    def features(self, bodies: pa.Array) -> np.ndarray:
        if not hasattr(self, "_index"):
            self._index, self._wide = index_vectors(self.seed), self.vectors.astype(np.float32)
        return np.concatenate([_pooled(bodies.slice(lo, hi - lo), self._wide, self._index) for lo, hi in chunks(bodies)] or [np.zeros((0, 2 * DIMS + 1), np.float32)])

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("_index", "_wide")}

    def _logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(x.astype(np.float64)) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> QualityModel:
        """Train on four fifths of the rows, calibrate on the last fifth."""
        self.prior = (float(y.sum()) + 1) / (len(y) + 2)
        if len(y) < 10 or y.min() == y.max():
            return self
        rng = np.random.default_rng(self.seed)
        x, order = x.astype(np.float64), rng.permutation(len(y))
        kept, apart = order[len(y) // 5 :], order[: len(y) // 5]
        mean, scale = x[kept].mean(0), x[kept].std(0) + 1e-3
        z = (x - mean) / scale
        params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        one, two, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            rng.shuffle(kept)
            for lo in range(0, len(kept), BATCH):
                at = kept[lo : lo + BATCH]
                h = np.tanh(z[at] @ params[0] + params[1])
                err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -500, 500))) - y[at]) / len(at)
                back = err[:, None] * params[2] * (1 - h * h)
                grads = [z[at].T @ back + DECAY * params[0], back.sum(0), h.T @ err + DECAY * params[2], np.array([err.sum()])]
                step += 1
                for p, g, m, v in zip(params, grads, one, two, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.layers = (mean, scale, params[0], params[1], params[2], params[3][0])
        logits, truth = self._logits(x[apart]), y[apart]
        grid = np.geomspace(0.25, 16, 97)
        loss = [np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 7) -> QualityModel:
    """A model from ``labels`` (id_col, label 0/1) of ``docs``.

    Word vectors are gathered from all of ``docs``.  For the network at most
    ``sample`` labelled ids count, those with the least hashes; rows with a null id
    or label don't, and an id that has several labels counts once, with the
    largest.  Documents that share a labelled id are all used.  Texts stay on the
    executors: what comes to the driver is one table of word vectors and a row of
    features for each sampled document.  With fewer than 10 rows or one label only,
    the model scores every text by the smoothed share of label 1.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body")).join(F.broadcast(chosen), "id").select("id", "body", "y")

    def gather(batches):
        state("quality")
        index, total = index_vectors(seed), np.zeros((ROWS, DIMS), np.float32)
        for batch in batches:
            bodies = column(batch, "body")
            for lo, hi in chunks(bodies):
                _contexts(_tokens(bodies.slice(lo, hi - lo)), index, total)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([some.astype(np.int32).tobytes()]), pa.array([total[some].tobytes()])], ["at", "sums"])

    def unpack(row) -> np.ndarray:
        total = np.zeros((ROWS, DIMS), np.float32)
        total[np.frombuffer(row.at, np.int32)] = np.frombuffer(row.sums, np.float32).reshape(-1, DIMS)
        return total

    every = docs.select(F.col(text).cast("string").alias("body"))
    sums = every.mapInArrow(gather, "at binary, sums binary").rdd.map(unpack)
    total = merged(sums, np.add, np.zeros((ROWS, DIMS), np.float32))
    model = QualityModel(total / (np.linalg.norm(total, axis=1, keepdims=True) + 1), seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches):
        state("quality")
        for batch in batches:
            x = shared.value.features(column(batch, "body")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(pool, f"id {id_type}, y int, x binary").toArrow().sort_by("id")
    x = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in found.column("x")]).reshape(-1, 2 * DIMS + 1)
    return model.fit(x, found.column("y").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the probability of label 1, and 1 if it is 0.5 or more, in columns ``names``.

    Every row is scored by its whole text alone; null counts as empty, which has
    a score too.  Old columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def judge(batches):
        state("quality")
        for batch in batches:
            p = shared.value.probabilities(shared.value.features(column(batch, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(judge, schema)
