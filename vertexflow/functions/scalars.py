"""Column functions: vectors, log-domain factors over arrays, and seeded random values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_set(v: Column, at: int, value) -> Column:
    """The array with element ``at`` (from 0) replaced."""
    return F.transform(v, lambda x, i: F.when(i == at, F.lit(value)).otherwise(x))


def vector_get(v: Column, at: int) -> Column:
    """Element ``at`` from 0, null beyond the end."""
    return F.get(v, F.lit(at))


def factor_uniform(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def factor_log_sum(f: Column) -> Column:
    """log of the sum of exp, by the largest element."""
    top = F.array_max(f)
    return top + F.log(F.aggregate(f, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def factor_normalize(f: Column) -> Column:
    total = factor_log_sum(f)
    return F.transform(f, lambda x: x - total)


def factor_times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def factor_divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def factor_convolve(matrix: Column, other: Column) -> Column:
    """c(x) = log of the sum over y of exp(matrix[x][y] + other[y])."""
    return F.transform(matrix, lambda row: factor_log_sum(factor_times(row, other)))


def factor_convolve_distance(seen: Column, other_seen: Column, other: Column, step: float, colours: int, scale: float) -> Column:
    """:func:`factor_convolve` with -|x - y| / scale, where x and y are offsets of ``step`` around two observations."""
    places = F.sequence(F.lit(0), F.size(other) - 1)

    def row(i: Column) -> Column:
        x = seen + step * (i - colours)
        return F.transform(places, lambda j: -F.abs(x - (other_seen + step * (j - colours))) / scale + F.get(other, j))

    return F.transform(places, lambda i: factor_log_sum(row(i)))


def factor_residual(a: Column, b: Column) -> Column:
    """The largest absolute difference."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def factor_norm(f: Column) -> Column:
    """The largest distance from the normalised uniform factor."""
    flat = -F.log(F.size(f).cast("double"))
    return F.array_max(F.transform(f, lambda x: F.abs(x - flat)))


def factor_damp(f: Column, other: Column, damping: float) -> Column:
    """log(damping * exp(other) + (1 - damping) * exp(f))."""
    if damping == 0:
        return f
    return F.zip_with(f, other, lambda x, y: F.log(damping * F.exp(y) + (1 - damping) * F.exp(x)))


def factor_max_assignment(f: Column) -> Column:
    """The place of the largest element, the first on ties."""
    return F.array_position(f, F.array_max(f)) - 1


def uniform(seed: int, *keys: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A value in [low, high) that seed and keys determine."""
    return low + (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)) * (high - low)


def gaussian(seed: int, *keys: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    u = F.greatest(uniform(seed, F.lit("radius"), *keys), F.lit(1e-300))
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, F.lit("angle"), *keys))


def gamma(seed: int, *keys: Column, alpha: int = 1) -> Column:
    """A gamma variate of whole-number shape: a sum of exponential ones."""
    parts = [-F.log(F.greatest(uniform(seed, F.lit(i), *keys), F.lit(1e-300))) for i in range(alpha)]
    return sum(parts[1:], parts[0])


def bernoulli(seed: int, *keys: Column, p: float = 0.5) -> Column:
    return uniform(seed, *keys) < p


def multinomial(seed: int, weights: list[float], *keys: Column) -> Column:
    """An index drawn in proportion to ``weights``."""
    total, run, u = sum(weights), 0.0, uniform(seed, *keys)
    out = F.lit(len(weights) - 1)
    cuts = []
    for w in weights[:-1]:
        run += w
        cuts.append(run / total)
    for i in reversed(range(len(cuts))):
        out = F.when(u < cuts[i], F.lit(i)).otherwise(out)
    return out


def permuted(items: Column, seed: int, *keys: Column) -> Column:
    """The array in an order that seed and keys determine."""
    tagged = F.transform(items, lambda x, i: F.struct(F.xxhash64(F.lit(seed), i, *keys).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def drawn(*parts: Column | str | int) -> Column:
    """A whole number in [0, 2**52) that looks random, from the md5 of ``parts`` (strings name columns): the same in any SQL engine."""
    own = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *own)), 1, 13), 16, 10).cast("long")
