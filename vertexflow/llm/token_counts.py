"""Token counts: a two-tier lookup of pre-token lengths on the map side.

A pre-token here is a run of separators with the word after it, where a full
stop or comma after a letter begins another.  The library's byte-level pattern
never joins text across those places, so a text has as many tokens as its
pre-tokens have together.

Tier one is a broadcast hash table of the pre-tokens that are frequent in the
whole corpus, with their lengths.  It comes from bounded summaries of every
partition that are merged as a tree, so no pre-token is shuffled.  Tier two is a
bounded cache in each Python worker; what neither tier knows is encoded by the
library in one call for each chunk.  The tiers decide speed only: any table, an
empty one too, gives the same counts.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import merged
from .pieces import encode, load, table
from .text import chunks, column, spaced

#: Entries of the broadcast table; at 12 bytes each it stays below 1 MB.
FREQUENT = 65_536
#: Counters that a summary may hold, and those that it passes on.
HELD, SENT = 400_000, FREQUENT

# The characters outside ASCII with the Unicode property White_Space.
WIDE_SPACE = "\x85\xa0                　"
_WIDE = "[" + "".join(WIDE_SPACE) + "]"


def splits(path: str) -> bool:
    """Whether a tokenizer's texts can be cut before white space: byte-level, nothing normalised."""
    if path.endswith(".model"):
        return False
    tok = load(path)
    return tok.normalizer is None and re.search(rb'"type":\s*"ByteLevel".*"use_regex":\s*true', bytes(tok.pre_tokenizer.__getstate__()), re.S) is not None


def _summary(texts) -> Counter:
    """Counts of a partition's pre-tokens; those met once in a chunk don't enter, the least go when there are too many."""
    seen: Counter = Counter()
    for bodies in texts:
        for lo, hi in chunks(bodies):
            w = spaced(bodies.slice(lo, hi - lo))
            _, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            often = np.flatnonzero(n > 1)
            data, at = w.data.tobytes(), first[often]
            for s, e, k in zip(w.starts[at].tolist(), w.ends[at].tolist(), n[often].tolist(), strict=True):
                seen[data[s:e]] += k
            if len(seen) > HELD:
                seen = _largest(seen)
    return _largest(seen)


def _largest(seen: Counter, n: int = SENT) -> Counter:
    return Counter(dict(heapq.nlargest(n, seen.items(), key=lambda x: (x[1], x[0]))))


def frequent_table(docs: DataFrame, text: str, path: str, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the corpus's most frequent pre-tokens, and their lengths in tokens.

    All rows count.  A partition's summary and each merged one have at most SENT
    entries, whatever the input's size.
    """

    def summarise(batches):
        seen = _summary(column(b, text) for b in batches)
        yield pa.RecordBatch.from_pydict({"w": pa.array([list(seen)], pa.list_(pa.binary())), "n": [list(seen.values())]})

    def merge(a, b):
        return _largest(Counter(a) + Counter(b))

    parts = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(summarise, "w array<binary>, n array<long>")
    rdd = parts.rdd.map(lambda r: Counter(dict(zip(map(bytes, r.w), r.n, strict=True))))
    texts = pa.array([w.decode() for w in _largest(merged(rdd, merge, Counter()), size)], pa.string())
    w = spaced(texts)
    whole = np.flatnonzero(np.diff(w.first) == 1)
    hashes = w.hashes[w.first[whole]]
    counts = np.array([len(x) for x in encode(path, texts.take(pa.array(whole)).to_pylist())], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order].astype(np.uint32)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text: ``id_col, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is a tokenizer file: .json for tokenizers, .model for
    sentencepiece.  Nothing is truncated, padded or added; special strings in a
    text count as the library has them by default.  A null text counts as empty:
    0 bytes, 0 tokens.  Null and repeated ids are kept as they are, an empty
    table gives an empty result, other columns are not looked at.  Tokenizers
    that normalise texts, and texts with white space outside ASCII, are given to
    the library whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    cut = splits(tokenizer)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_table(rows, "body", tokenizer) if cut else None)
    id_type, run = rows.schema["id"].dataType.simpleString(), uuid.uuid4().hex

    def totals(bodies: pa.Array) -> np.ndarray:
        wide = pc.match_substring_regex(bodies, _WIDE).to_numpy(zero_copy_only=False) if cut else np.ones(len(bodies), bool)
        out = np.zeros(len(bodies), np.int64)
        if cut:
            out = table(tokenizer, run, lambda: frequent.value).totals(spaced(bodies))
        for i in np.flatnonzero(wide).tolist():
            out[i] = len(encode(tokenizer, [bodies[i].as_py()])[0])
        return out

    def count(batches):
        for batch in batches:
            bodies = column(batch, "body")
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *(totals(bodies.slice(lo, hi - lo)) for lo, hi in chunks(bodies))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(bodies).cast(pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
