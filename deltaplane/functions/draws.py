"""Random numbers as functions of a row's key: reproducible on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: P(X <= k) of a Poisson variable of mean 1; beyond the last the probability is below 1e-6.
POISSON_CDF = [math.fsum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def portable_uniform(key: Column, draw: Column) -> Column:
    """In [0, 1), from the md5 of `key:draw`; other SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fast_uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), from a 64-bit hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def poisson(uniform: Column) -> Column:
    """A Poisson(1) count from a uniform number: how many values of the distribution function it has passed."""
    out = F.when(uniform < POISSON_CDF[0], 0)
    for k, p in enumerate(POISSON_CDF[1:], 1):
        out = out.when(uniform < p, k)
    return out.otherwise(len(POISSON_CDF))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = fast_uniform(seed, F.lit("radius"), *keys), fast_uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(-2 * F.log(u + F.lit(0.5 / (1 << 52)))) * F.cos(F.lit(2 * math.pi) * v)


def fold(folds: int, seed: int, *keys: Column) -> Column:
    """A fold number from 0."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int")


def hash_split(df, weights: list[float], *keys: str, seed: int = 0) -> list:
    """Disjoint parts of df in the proportions of the weights; a key is always in the same part."""
    u, at, total, out = fast_uniform(seed, *[F.col(k) for k in keys]), 0.0, sum(weights), []
    for i, w in enumerate(weights):
        to = at + w / total if i < len(weights) - 1 else 1.0
        out.append(df.where((u >= at) & (u < to)))
        at = to
    return out
