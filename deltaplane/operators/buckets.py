"""Quantile buckets of a score."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The accuracy of the sketches that bracket splits, at most.
SKETCH = 10_000


def ranks(rows: int, buckets: int) -> list[int]:
    """Of so many sorted rows, the places from 1 that hold the inner splits: the first with at least a share i / buckets
    up to it. The share is what its decimal digits say, as in SQL's quantile_disc, so no rounding moves a place."""
    return [max(1, math.ceil(Fraction(repr(i / buckets)) * rows)) for i in range(1, buckets)] if rows else []


def _value(column: str) -> Column:
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))


def sketched(df: DataFrame, columns: list[str], shares: list[float], accuracy: int) -> list[list[float]]:
    """The values of each column at the shares, to within 1 / accuracy of the rows, in one pass; nulls and NaN don't count.

    Sketches merge, so memory is bounded by the accuracy, whatever the rows.
    """
    row = df.agg(*[F.percentile_approx(_value(c), shares, accuracy).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [row[i] or [] for i in range(len(columns))]


def near_splits(df: DataFrame, columns: list[str], buckets: int, accuracy: int) -> dict[str, list[float]]:
    """As splits, but each to within 1 / accuracy of the rows: one pass."""
    if buckets < 2:
        return {c: [] for c in columns}
    found = sketched(df, columns, [i / buckets for i in range(1, buckets)], accuracy)
    return {c: sorted(set(x)) for c, x in zip(columns, found, strict=True)}


def splits(df: DataFrame, columns: list[str], buckets: int, accuracy: int = 1_000_000) -> dict[str, list[float]]:
    """The distinct inner splits of each column, exact whatever the rows; nulls and NaN don't count.

    Two passes: a sketch brackets each split, then the rows between brackets are counted and the values within them
    counted one by one. Values within a bracket are some 4 / accuracy of the rows and meet in one task; an accuracy
    beyond SKETCH makes the sketches larger without need and counts as that.
    """
    if buckets < 2 or not columns:
        return {c: [] for c in columns}
    accuracy, out = min(accuracy, SKETCH), {}
    margin, open_ = 2 / accuracy, list(columns)
    while open_:
        out |= _bracketed(df, open_, buckets, accuracy, margin)
        # Should a sketch be worse than it promises: a split outside of its bracket.
        open_, margin = [c for c in open_ if out[c] is None], margin * 8
    return {c: out[c] for c in columns}


def _bracketed(df: DataFrame, columns: list[str], buckets: int, accuracy: int, margin: float) -> dict[str, list[float] | None]:
    """The splits of each column, none if one lies outside of its bracket."""
    ends = sketched(df, columns, [min(1.0, max(0.0, i / buckets + d)) for i in range(1, buckets) for d in (-margin, margin)], accuracy)
    # A value has passed an odd number of edges if it is within a bracket.
    edges = [_edges(list(zip(x[::2], x[1::2], strict=True))) for x in ends]
    cell = [bucket_of(_value(c), e).cast("int") for c, e in zip(columns, edges, strict=True)]
    parts = [F.struct(F.lit(i).alias("f"), x.alias("c"), F.when(x % 2 == 1, _value(c)).alias("v")) for i, (c, x) in enumerate(zip(columns, cell, strict=True))]
    rows = df.select(F.explode(F.array(*parts)).alias("x")).where("x.c is not null")
    found = rows.groupBy("x.f", "x.c", "x.v").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        before, out, wanted = [0] * len(columns), {c: [] for c in columns}, []
        cells = sorted((r["f"], r["c"], r["n"]) for r in found.groupBy("f", "c").agg(F.sum("n").alias("n")).collect())
        places = [ranks(sum(n for f, _, n in cells if f == i), buckets) for i in range(len(columns))]
        for f, c, n in cells:
            own = [r - before[f] for r in places[f] if before[f] < r <= before[f] + n]
            before[f] += n
            if c % 2:
                wanted += [(f, c, r) for r in own]
            elif own:
                out[columns[f]] = None
        if wanted:
            places = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({f}, {c}, {r}L)' for f, c, r in wanted)} AS t(f, c, r)")
            up = Window.partitionBy("f", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            upto = found.where("v is not null").withColumn("upto", F.sum("n").over(up))
            for r in upto.join(F.broadcast(places), ["f", "c"]).where("r <= upto and r > upto - n").select("f", "v").distinct().orderBy("f", "v").collect():
                if out[columns[r["f"]]] is not None:
                    out[columns[r["f"]]].append(r["v"])
    finally:
        found.unpersist()
    return out


def _edges(brackets: list[tuple[float, float]]) -> list[float]:
    """The lower ends of the brackets and what follows their upper ends, joined where they overlap."""
    out: list[float] = []
    for low, high in sorted(brackets):
        after = math.nextafter(high, math.inf)
        if out and low <= out[-1]:
            out[-1] = max(out[-1], after)
        else:
            out += [low, after]
    # Nothing follows infinity.
    return out[:-1] if out and out[-1] == math.inf else out


def bucket_of(column: Column, inner: list[float]) -> Column:
    """How many splits are at or below the value; null for null and NaN. A binary decision tree, so deep CASEs are avoided."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(float(a))
        m = (a + b) // 2
        return F.when(column < F.lit(inner[m]), tree(a, m)).otherwise(tree(m + 1, b))

    return F.when(column.isNotNull() & ~F.isnan(column), tree(0, len(inner)))


def threshold_of(bucket: Column, inner: list[float]) -> Column:
    """The lower split of a bucket, -inf for the first."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in [float("-inf"), *inner]]), bucket.cast("int") + 1)


def label_of(bucket: Column, inner: list[float]) -> Column:
    """`[low, high)` with two decimals."""
    edges = [float("-inf"), *inner, float("inf")]
    return F.element_at(F.array(*[F.lit(f"[{a:.2f}, {b:.2f})") for a, b in zip(edges, edges[1:], strict=False)]), bucket.cast("int") + 1)


def quantile_buckets(df: DataFrame, score: str, buckets: int = 30, name: str = "bucket", accuracy: int = 1_000_000) -> tuple[DataFrame, list[float]]:
    """The rows of df that have a score, with their bucket (a double from 0) as `name`; and the inner splits.

    Equal splits are one, so there can be fewer buckets than asked for.
    """
    inner = splits(df, [score], buckets, accuracy)[score]
    out = df.withColumn(name, bucket_of(F.col(score).cast("double"), inner))
    return out.where(F.col(name).isNotNull()), inner
