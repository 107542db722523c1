"""Splits are exact, whatever the rows and their order: by the places that SQL's quantile_disc takes."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import functions as F

from deltaplane.operators import selection as se
from deltaplane.operators.buckets import quantile_buckets, ranks, splits


def places(rows: int, buckets: int) -> list[int]:
    return [math.ceil(Fraction(repr(i / buckets)) * rows) for i in range(1, buckets)]


def test_many_rows_in_one_partition(spark):
    """Sketches of a million count on, from half a million rows in a partition on, with ranks that are off by one."""
    df = spark.range(0, 700_000, 1, 1).select(F.pmod(F.col("id") * 7919, F.lit(700_000)).cast("double").alias("s"))
    for buckets in (7, 30):
        assert quantile_buckets(df, "s", buckets)[1] == [float(p - 1) for p in places(700_000, buckets)]


def test_places_by_decimal_digits(spark):
    """2 / 30 of 15,000 rows is beyond the thousandth by its digits, at it by doubles."""
    df = spark.range(15_000).select(F.col("id").cast("double").alias("s"))
    assert quantile_buckets(df, "s", 30)[1] == [float(p - 1) for p in places(15_000, 30)]
    assert ranks(15_000, 30)[1] == 1001 and ranks(10, 2) == [5] and ranks(1, 3) == [1, 1] and ranks(0, 3) == []


def test_few_values_at_low_accuracy(spark):
    """A split where two values meet: a sketch takes the wrong one."""
    df = spark.range(0, 200_000, 1, 3).select(F.floor(F.col("id") / F.when(F.col("id") < 100_000, 9_999).otherwise(10_001)).cast("double").alias("f"))
    values = sorted(r[0] for r in df.collect())
    want = sorted({values[p - 1] for p in places(200_000, 10)})
    assert splits(df, ["f"], 10, 50)["f"] == want
    binned = se.discretise(df.withColumn("n", F.col("f")), ["f"], accuracy=50)
    assert binned.where(F.col("f") != sum((F.col("n") >= w).cast("int") for w in want)).isEmpty()


def test_odd_values(spark):
    """Nulls and NaN don't count, infinities do; columns of no or of one value have their splits as well."""
    rows = [(x, None, 3.0) for x in (None, math.nan, math.inf, math.inf, -math.inf, 1.0, 2.0, 0.0, -0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert splits(df, ["a", "b", "c"], 8) == {"a": [-math.inf, 0.0, 1.0, 2.0, math.inf], "b": [], "c": [3.0]}
    assert splits(df.limit(0), ["a"], 7) == {"a": []} and splits(df, ["a"], 1) == {"a": []}


def test_a_bad_sketch(spark, monkeypatch):
    """A split outside of its bracket is looked for in a wider one."""
    from deltaplane.operators import buckets as own

    real, seen = own.sketched, []

    def off(df, columns, shares, accuracy):
        seen.append(columns)
        return real(df, columns, shares, accuracy) if len(seen) > 1 else [[0.0] * len(shares) for _ in columns]

    monkeypatch.setattr(own, "sketched", off)
    df = spark.range(1000).select(F.col("id").cast("double").alias("s"), F.lit(0).alias("z"))
    assert own.splits(df, ["s", "z"], 4) == {"s": [249.0, 499.0, 749.0], "z": [0.0]} and seen == [["s", "z"], ["s"]]
