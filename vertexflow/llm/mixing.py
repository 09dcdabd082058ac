"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised.  The
exponent is bisected: 1 keeps the natural mix, 0 gives every source the same
weight.  It is the least that keeps within a repetition limit, or the one that
meets a target entropy.  The weights are then realised as a budget of tokens for
each source, spent on whole passes over the source and on a part of one more.
That part is the beginning of a fixed random permutation: blocks of documents in
the order of their hashes, whole blocks first, then single documents of the block
where the budget ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexflow.storage import discard, materialize

from .joins import join_hot
from .text import fresh

#: Sources whose rows in a table are broadcast; if there are more, only those with many documents are.
MAX_SOURCES = 100_000
#: Exponents that one pass over the sources' totals tries, and passes: 33 ** -11 is beyond a double's bits.
TRIED, PASSES = 32, 11
#: Hex digits of a document's hash that name its block: 4096 blocks a source.
BLOCK_DIGITS = 3


def least_exponent(fits: Callable[[list[float]], list[bool]]) -> float:
    """The least exponent in [0, 1] that fits, where all above one that fits do; ``fits`` judges many at once."""
    if fits([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        tried = [lo + (hi - lo) * i / (TRIED + 1) for i in range(1, TRIED + 1)]
        first = next((i for i, fine in enumerate(fits(tried)) if fine), TRIED)
        lo, hi = (tried[first - 1] if first else lo), (tried[first] if first < TRIED else hi)
    return hi


def entropies(totals: DataFrame, tokens: int, exponents: list[float]) -> list[float]:
    """Entropy (nats) of the tempered weights of ``totals`` (column ``n``) for each exponent, in one aggregation."""
    share = F.col("n") / F.lit(float(tokens))
    sums = [f(F.pow(share, F.lit(e))) for e in exponents for f in (F.sum, lambda x: F.sum(x * F.log(share)))]
    row = totals.where("n > 0").agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
    return [math.log(row[2 * i]) - e * row[2 * i + 1] / row[2 * i] for i, e in enumerate(exponents)]


def exponent_for(totals: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None) -> float:
    """The exponent that meets a target entropy (nats), else the least within a repetition limit.

    ``totals``: one row for each source, its tokens in ``n``.  The limit holds for
    the most repeated source against the least repeated one.  A target beyond what
    exponents 0 to 1 reach gives the nearer end.
    """
    tokens, least, most = totals.where("n > 0").agg(F.sum("n"), F.min("n"), F.max("n")).first()
    if not tokens:
        return 1.0
    if target_entropy is not None:
        return least_exponent(lambda tried: [h <= target_entropy for h in entropies(totals, tokens, tried)])
    # A source's rate is share ** (exponent - 1) but for a factor, so the least source is repeated most.
    spread, limit = math.log(most / least), math.log(repetition_limit) if repetition_limit else math.inf
    return least_exponent(lambda tried: [(1 - e) * spread <= limit for e in tried])


def source_plan(totals: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> DataFrame:
    """``totals`` with each source's ``weight``, token ``quota``, whole ``passes``, and tokens of the last, partial pass (``rest``)."""
    exponent = exponent_for(totals, target_entropy, repetition_limit)
    tokens = totals.agg(F.sum("n")).first()[0] or 1
    raw = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(tokens)), F.lit(exponent))).otherwise(0.0)
    scale, most = totals.agg(F.sum(raw), F.max(F.when(F.col("n") > 0, F.col("n") / raw))).first()
    weight = raw / F.lit(scale or 1.0)
    out = totals.withColumn("weight", weight)
    quota = F.round(F.col("weight") * F.lit(float(budget if budget is not None else (most or 0.0) * (scale or 1.0))), 3)
    out = out.withColumn("quota", quota)
    out = out.withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(1).cast("long"))
    return out.withColumn("rest", F.when(F.col("n") > 0, F.round(F.col("quota") - F.col("passes") * F.col("n"), 3)).otherwise(0.0))


def mix_sources(docs: DataFrame, tokens: str, source: str = "source", id_col: str = "doc_id", target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: float | None = None, seed: int = 0, names: tuple[str, str] = ("weight", "copies")) -> DataFrame:
    """``docs`` with the source's weight, and how often the mix holds the row, in columns ``names``.

    ``tokens`` names the column of token counts; null counts as 0.  Without
    ``budget`` it is the least that passes over every source once at least, so
    no row is left out.  A document belongs to the partial pass if the tokens before
    it in its source's permutation are fewer than those left.  The permutation goes
    by the md5 of seed and id; rows without an id come last, equal ids are taken
    together.  Null is a source like any other; there may be any number of sources.
    A source without tokens has weight 0 and each of its rows once.  An empty table
    gives an empty result.  Columns of ``docs`` stay as they are, whatever their
    names, but old ones of these names are replaced.
    """
    docs = docs.drop(*names)
    key, order, block, own, weight, passes, cut, edge = fresh(docs, "key", "order", "block", "own", "weight", "passes", "cut", "edge")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumn(order, F.when(F.col(id_col).isNull(), F.lit("g")).otherwise(hashed))
    rows = rows.withColumns({block: F.substring(order, 1, BLOCK_DIGITS), own: F.coalesce(F.col(tokens).cast("long"), F.lit(0)), key: F.struct(F.col(source).alias("s"))})
    few = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(block).alias("block"), F.col(own).alias("n"))
    blocks = materialize(few.groupBy("key", "block").agg(F.sum("n").alias("n"), F.count("*").alias("size")), "blocks")
    totals = materialize(blocks.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "totals")
    sources, total = totals.agg(F.count("*"), F.sum("size")).first()
    small = sources <= MAX_SOURCES

    def beside(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
        return left.join(F.broadcast(right.drop("size")), on, how) if small else join_hot(left, right, on, "size", total, how)

    shares = materialize(source_plan(totals, target_entropy, repetition_limit, budget).select("key", "weight", "passes", "rest", "size"), "shares")
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("n") >= F.col("rest"))
    ended = starts.drop("size").join(shares.select("key", "rest", "size"), "key").where(ends).select("key", "block", "start", "rest", "size")
    ended = materialize(ended, "cut")

    # Of each source, only the documents of the block where the budget ends are put in order.
    inside = few.join(F.broadcast(ended.drop("size")) if small else ended.drop("size"), ["key", "block"])
    inside = inside.groupBy("key", "block", "order", "start", "rest").agg(F.sum("n").alias("n"))
    run = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("order").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = inside.withColumn("run", F.col("start") + run).where("run < rest").groupBy("key", "block").agg(F.max("order").alias("edge"))

    choice = shares.join(taken, "key", "left").select(F.col("key").alias(key), F.col("weight").alias(weight), F.col("passes").alias(passes), F.col("block").alias(cut), F.col("edge").alias(edge), "size")
    choice = materialize(choice, "choice")
    out = beside(rows, choice, key, "left")
    extra = (F.col(block) < F.col(cut)) | ((F.col(block) == F.col(cut)) & (F.col(order) <= F.col(edge)))
    copies = (F.col(passes) + F.coalesce(extra, F.lit(False)).cast("long")).cast("long")
    out = out.select(*docs.columns, F.col(weight).alias(names[0]), copies.alias(names[1]))
    discard(blocks, totals, shares, ended)
    return out
